"""Cells to items: summaries, centroids, modes, overlaps, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import count_if, defined, ratio
from tallyframe.functions.ordered import Grouped, Ordered
from tallyframe.session import cut


def channel_statistics(cells: DataFrame, keys: list[str], value: str, high: float) -> DataFrame:
    """Mean, median, p75, p95, max, min, population deviation and count above `high`, to six places."""
    base = cells.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.max(value).alias("max"),
        F.min(value).alias("min"),
        F.stddev_pop(value).alias("std"),
        count_if(F.col(value) > high).alias("n_high"),
    )
    spots = Grouped(cells.select(*keys, value), keys).quantiles(value, {"median": 0.5, "p75": 0.75, "p95": 0.95})
    joined = base.join(spots, keys)
    rounded = [F.round(c, 6).alias(c) for c in ("mean", "median", "p75", "p95", "max", "min", "std")]
    return joined.select(*keys, *rounded, "n_high")


def centroids(cells: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """Size and mean place per item."""
    return cells.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_cells"), *[F.avg(a).alias(f"c_{a}") for a in axes]
    )


def modal_class(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Commonest non-zero class; a tie goes to the larger class."""
    counts = rows.filter(F.col(value) != 0).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    best = counts.groupBy(*keys).agg(F.max(F.struct("c", value)).alias("__b"))
    return best.select(*keys, F.col(f"__b.{value}").alias("modal"), F.col("__b.c").cast("bigint").alias("n_modal"))


def mapping_free(cells: DataFrame, keys: list[str], probs: str) -> DataFrame:
    """Certainty of the per-cell channel vector without naming channels.

    Clipped to [1e-12, 1] and renormalised per cell: mean margin of the two largest, one minus
    mean normalised entropy, mean of the largest, share of cells agreeing with the commonest
    argmax (ties take the lowest channel).
    """
    clipped = F.transform(probs, lambda p: F.greatest(F.lit(1e-12), F.least(F.lit(1.0), p.cast("double"))))
    rows = cells.select(*keys, clipped.alias("__c"))
    rows = rows.withColumn("__t", F.aggregate("__c", F.lit(0.0), lambda a, v: a + v))
    rows = rows.withColumn("__q", F.transform("__c", lambda v: v / F.col("__t")))
    size = F.size("__q")
    ranked = F.sort_array("__q", asc=False)
    entropy = -F.aggregate("__q", F.lit(0.0), lambda a, v: a + v * F.ln(v)) / F.ln(size)
    per = rows.select(
        *keys,
        F.get(ranked, F.lit(0)).alias("top1"),
        F.coalesce(F.get(ranked, F.lit(1)), F.lit(0.0)).alias("top2"),
        entropy.alias("entropy"),
        (F.array_position("__q", F.array_max("__q")) - 1).cast("int").alias("arg"),
    )
    # one pass per (key, argmax), then combine the handful of argmax values
    part = per.groupBy(*keys, "arg").agg(
        F.count(F.lit(1)).alias("c"),
        F.sum(F.col("top1") - F.col("top2")).alias("m"),
        F.sum("entropy").alias("e"),
        F.sum("top1").alias("t"),
    )
    n = F.sum("c")
    return part.groupBy(*keys).agg(
        ratio(F.sum("m"), n).alias("margin"),
        (F.lit(1.0) - ratio(F.sum("e"), n)).alias("entropy_inv"),
        ratio(F.sum("t"), n).alias("top1"),
        ratio(F.max("c"), n).alias("agree"),
        F.max(F.struct(F.col("c"), (-F.col("arg")).alias("down")))["down"].alias("__d"),
    ).withColumn("modal_channel", -F.col("__d")).drop("__d")


def dice(truth: DataFrame, pred: DataFrame, cluster: list[str], cell: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """Foreground overlap per cluster and overlap per reference label; background cells are absent.

    Foreground ignores labels.  Only labels of the reference are scored, so both empty never
    arises per label; an empty pair of masks scores 1.
    """
    keys = [*cluster, *cell]
    a = truth.select(*keys, F.col(label).alias("__a"))
    b = pred.select(*keys, F.col(label).alias("__b"))
    marks = F.array_distinct(F.array_compact(F.array("__a", "__b")))
    # outer: a cluster whose cells carry no label keeps its row
    rows = a.join(b, keys, "full_outer").withColumn(label, F.explode_outer(marks))
    in_a, in_b = F.col("__a") == F.col(label), F.col("__b") == F.col(label)
    # a cell marked on both sides counts towards the foreground once, under its reference label
    per = rows.groupBy(*cluster, label).agg(
        F.count_if(in_a).alias("in_a"),
        F.count_if(in_b).alias("in_b"),
        F.count_if(in_a & in_b).alias("in_both"),
        F.count_if(in_a & F.col("__b").isNotNull()).alias("marked_twice"),
    )
    per = cut(per)
    size = F.sum("in_a") + F.sum("in_b")
    fore = per.groupBy(*cluster).agg(F.coalesce(ratio(F.sum("marked_twice") * 2, size), F.lit(1.0)).alias("dice_fg"))
    per = per.filter("in_a > 0").select(
        *cluster, label, ratio(F.col("in_both") * 2, F.col("in_a") + F.col("in_b")).alias("dice")
    )
    return fore, per


def bounding_boxes(cells: DataFrame, keys: list[str], first: str, second: str, least: int) -> DataFrame:
    """Box of two coordinates per slice and label, small boxes left out."""
    return (
        cells.groupBy(*keys)
        .agg(
            F.min(first).alias("first_min"),
            F.max(first).alias("first_max"),
            F.min(second).alias("second_min"),
            F.max(second).alias("second_max"),
            F.count(F.lit(1)).cast("bigint").alias("n_cells"),
        )
        .filter(F.col("n_cells") >= least)
    )


def pooled_rates(hits: DataFrame, fore: DataFrame, per: DataFrame, cluster: str, category: str) -> DataFrame:
    """Hit rate, distance and overlap over everything, per cluster and per category; undefined values skipped.

    `fore` and `per` are what `dice` returns.  The row over everything also has means and medians over the clusters,
    and its two overlaps are such means; a cluster known by its masks alone is one of them, with no rate.
    """
    dist = defined("dist")
    sets = hits.groupingSets([[F.col(cluster)], [F.col(category)]], cluster, category).agg(
        F.grouping_id().alias("grain"),
        F.count("hit").cast("bigint").alias("n"),
        F.coalesce(F.sum("hit"), F.lit(0)).cast("bigint").alias("hits"),
        F.count(dist).alias("n_dist"),
        F.sum(dist).alias("sum_dist"),
    )
    sets = cut(sets)
    rates = {"rate": ratio(F.col("hits"), F.col("n")), "mean_dist": ratio(F.col("sum_dist"), F.col("n_dist"))}
    # a union instead of joins: a NULL cluster is a case like any other
    parts = sets.filter("grain = 1").drop(category)
    for overlap in (fore, per.groupBy(cluster).agg(F.avg("dice").alias("dice_label"))):
        parts = parts.unionByName(overlap, allowMissingColumns=True)
    cases = parts.groupBy(cluster).agg(
        F.lit(1).cast("bigint").alias("grain"),
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("n", "hits", "n_dist")],
        *[F.max(c).alias(c) for c in ("sum_dist", "dice_fg", "dice_label")],
    )
    cases = cut(cases.withColumns(rates))
    group = Grouped(cases, [])

    def median(value: str) -> Column:
        return group.quantiles(value, {"mid": 0.5}).select("mid").scalar().alias(f"median_{value}")

    whole = cases.agg(
        F.lit(3).cast("bigint").alias("grain"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "hits")],
        ratio(F.sum("hits"), F.sum("n")).alias("rate"),
        ratio(F.sum("sum_dist"), F.sum("n_dist")).alias("mean_dist"),
        F.count(F.lit(1)).alias("n_cases"),
        F.avg("rate").alias("mean_rate"),
        F.avg("mean_dist").alias("mean_case_dist"),
        *[F.avg(c).alias(c) for c in ("dice_fg", "dice_label")],
        *[median(c) for c in ("rate", "dice_fg", "dice_label")],
    )
    levels = sets.filter("grain = 2").drop(cluster).withColumns(rates)
    out = cases.unionByName(levels, allowMissingColumns=True).unionByName(whole, allowMissingColumns=True)
    means = [c for c in whole.columns if c not in ("grain", "n", "hits", *rates)]
    return out.select(cluster, category, "grain", "n", "hits", *rates, *means)


def index_quartiles(values: DataFrame, value: str) -> DataFrame:
    """Order statistics at n div 4, n div 2 and 3n div 4 of the sorted list, with mean and total.

    Values are counted first, so the ordered pass sees distinct values only.
    """
    counts = cut(values.groupBy(value).agg(F.count(F.lit(1)).alias("c")))
    run = Ordered(counts, [], [value]).prefix({"upto": F.col("c")})
    total = counts.agg(F.sum("c").alias("n")).scalar()
    rows = run.withColumn("__n", total)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("upto") - F.col("c") <= place) & (place < F.col("upto")), F.col(value)))

    n = F.col("__n")
    return rows.agg(
        F.max(n).cast("bigint").alias("n"),
        F.min(value).alias("least"),
        at(F.floor(n / 4)).alias("q1"),
        at(F.floor(n / 2)).alias("q2"),
        at(F.floor(n * 3 / 4)).alias("q3"),
        F.max(value).alias("most"),
        ratio(F.sum(F.col(value) * F.col("c")), F.max(n)).alias("mean"),
        F.sum(F.col(value) * F.col("c")).cast("bigint").alias("total"),
    )
