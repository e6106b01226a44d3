"""What a cohort and a run consist of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import count_if, first_of, ratio
from tallyframe.functions.ordered import Grouped


def scalar(df: DataFrame, agg: Column) -> Column:
    """A whole-table aggregate as a scalar subquery."""
    return df.select(agg).scalar()


def composition(rows: DataFrame, cluster: list[str], label: str, region: Column, order: list[str], special: dict[str, int]) -> DataFrame:
    """Sorted label set, its size, regions in a fixed order, and has-this-label facts per cluster.

    Labels come from a fixed vocabulary, so a set stays short however many rows a cluster has.
    """
    per = rows.select(*cluster, label, region.alias("__r")).groupBy(*cluster).agg(
        F.array_sort(F.collect_set(label)).alias("__l"), F.collect_set("__r").alias("__g")
    )
    text = F.concat(*[F.when(F.array_contains("__g", r), F.lit(r)).otherwise(F.lit("")) for r in order])
    return per.select(
        *cluster,
        F.size("__l").cast("bigint").alias("n_labels"),
        F.array_join(F.transform("__l", lambda v: v.cast("string")), ",").alias("labels"),
        text.alias("regions"),
        *[F.array_contains("__l", v).alias(n) for n, v in special.items()],
    )


def pair_availability(rows: DataFrame, cluster: list[str], label: str, pairs: list[tuple]) -> DataFrame:
    """Clusters offering each adjacent pair: strictly (both labels) or leniently
    (the second may be a label the reference never marks)."""
    per = rows.groupBy(*cluster).agg(F.collect_set(label).alias("__l"))

    def has(v) -> Column:
        return F.array_contains("__l", v)

    options = F.array(
        *[
            F.struct(
                F.lit(name).alias("pair"),
                (has(a) & has(b)).alias("strict"),
                (has(a) & (has(b) | F.lit(not marked))).alias("lenient"),
            )
            for name, a, b, marked in pairs
        ]
    )
    rows = per.select(F.explode(options).alias("__p")).select("__p.*")
    counted = rows.groupBy("pair").agg(
        count_if(F.col("strict")).alias("n_strict"), count_if(F.col("lenient")).alias("n_lenient"),
        F.count(F.lit(1)).cast("bigint").alias("n_clusters"),
    )
    listed = per.select(F.transform(options, lambda p: p["strict"]).alias("s"), F.transform(options, lambda p: p["lenient"]).alias("l"))
    none = listed.agg(
        F.lit("(none)").alias("pair"),
        count_if(~F.array_contains("s", True)).alias("n_strict"),
        count_if(~F.array_contains("l", True)).alias("n_lenient"),
        F.count(F.lit(1)).cast("bigint").alias("n_clusters"),
    )
    return counted.unionByName(none)


def prevalence(rows: DataFrame, cluster: str, category: str) -> DataFrame:
    """Share of clusters that contain each category."""
    pairs = rows.select(cluster, category).distinct()
    n = scalar(rows, F.count_distinct(cluster))
    return (
        pairs.groupBy(category)
        .agg(F.count(F.lit(1)).cast("bigint").alias("n_clusters"))
        .withColumn("of", n.cast("bigint"))
        .withColumn("share", ratio(F.col("n_clusters"), F.col("of")))
    )


def top_common(rows: DataFrame, tuple_of: list[str], k: int = 8) -> DataFrame:
    """The k commonest tuples; equal counts are listed in tuple order."""
    counts = rows.groupBy(*tuple_of).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return counts.orderBy(F.desc("n"), *tuple_of).limit(k)


def count_mismatch(a: DataFrame, b: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return a.join(b, keys, "full_outer").filter(~F.col(x).eqNullSafe(F.col(y)))


def run_progress(latest: DataFrame, case: str, status: str, wall: str, total: Column) -> DataFrame:
    """Status counts and shares of a run, its wall times, and the remaining work at the median rate.

    One row per status; the run-wide columns repeat on each.
    """
    flat = latest.select(F.col(case).alias("case"), F.col(status).alias("status"), F.col(wall).alias("wall"))
    counts = flat.groupBy("status").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    whole = flat.agg(F.count(F.lit(1)).alias("n"), F.avg("wall").alias("mean"), F.max("wall").alias("max"))
    mid = Grouped(flat.select("wall"), []).quantiles("wall", {"median": 0.5})
    done = whole.select("n").scalar()
    median = mid.select("median").scalar()
    left = F.greatest(F.lit(0), total - done)
    return counts.select(
        "status",
        "n",
        ratio(F.col("n"), F.greatest(F.lit(1), done)).alias("share"),
        whole.select("mean").scalar().alias("mean_wall"),
        median.alias("median_wall"),
        whole.select("max").scalar().alias("max_wall"),
        left.cast("bigint").alias("remaining"),
        (left * median / F.lit(3600.0)).alias("remaining_hours"),
    )


def error_profile(rows: DataFrame, cluster: str, wrong: str) -> DataFrame:
    """Items per cluster, clusters with no error and with nothing but errors, overall accuracy."""
    per = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("w"))
    return per.agg(
        F.count(F.lit(1)).cast("bigint").alias("clusters"),
        F.avg("n").alias("mean_items"),
        F.min("n").cast("bigint").alias("min_items"),
        F.max("n").cast("bigint").alias("max_items"),
        count_if(F.col("w") == 0).alias("clusters_no_error"),
        count_if(F.col("w") == F.col("n")).alias("clusters_all_wrong"),
        ratio(F.sum(F.col("n") - F.col("w")), F.sum("n")).alias("accuracy"),
    )


def rule_disagreement(rows: DataFrame, keys: list[str], a: Column, b: Column) -> DataFrame:
    """How often two rules differ where both are defined."""
    known = a.isNotNull() & b.isNotNull()
    return rows.groupBy(*keys).agg(
        count_if(known).alias("n"),
        count_if(known & (a != b)).alias("n_differ"),
        ratio(F.count_if(known & (a != b)), F.count_if(known)).alias("rate"),
    )


def resume_todo(cases: DataFrame, records: DataFrame, key: str, status: str, partial: bool = False) -> DataFrame:
    """Cases not finished yet; a partial success counts as done only when that mode is asked for."""
    done = ["ok", "ok_step1_only"] if partial else ["ok"]
    return cases.join(records.filter(F.col(status).isin(done)).select(key), key, "left_anti")


def drop_reason(written: Column, valid: Column, small_box: Column) -> Column:
    return first_of([(written, "written"), (~valid, "invalid name"), (small_box, "small box")], "other")


def outcome(transport_error: Column, code: Column, duplicate: Column, stored: Column) -> Column:
    return first_of(
        [(transport_error, "transport error"), (code >= 400, "rejected"), (duplicate, "duplicate"), (stored, "accepted")],
        "error",
    )


def violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows breaking each range check, counted in one pass."""
    counted = rows.agg(*[count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("n_bad")) for n in checks])
    return counted.select(F.explode(pairs).alias("__p")).select("__p.*")


def drop_out_of_range(rows: DataFrame, label: str, least: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows with a usable label, and how often each unusable label was dropped."""
    inside = F.coalesce(F.col(label).between(least, most), F.lit(False))
    dropped = rows.filter(~inside).groupBy(label).agg(F.count(F.lit(1)).cast("bigint").alias("n_dropped"))
    return rows.filter(inside), dropped


def isotropic(rows: DataFrame, steps: list[str]) -> DataFrame:
    """How many rows have equal steps along every axis."""
    same = F.size(F.array_distinct(F.array(*steps))) == 1
    return rows.agg(count_if(same).alias("n_isotropic"), F.count(F.lit(1)).cast("bigint").alias("of"))


def require_clean(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Pass rows through, failing the job on the first row that breaks a check."""
    out = rows
    for name, bad in checks.items():
        out = out.filter(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(f"out of range: {name}")).cast("boolean")).otherwise(True))
    return out


def regressions(got: DataFrame, expected: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """(keys, want, got) of recomputed values that are missing or differ from the published ones."""
    pair = expected.select(*keys, F.col(value).alias("want")).join(got.select(*keys, F.col(value).alias("got")), keys, "left")
    return pair.filter(F.col("got").isNull() | (F.abs(F.col("got") - F.col("want")) > tolerance))


def regression_gate(got: DataFrame, expected: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> None:
    """Refuse to go on when there are regressions."""
    shown = regressions(got, expected, keys, value, tolerance).select(*keys).take(5)
    if shown:
        raise ValueError(f"values do not reproduce: {shown}")
