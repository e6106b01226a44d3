"""Any score judged as an error detector: low scores should mark the errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import count_if, defined, first_of, ratio
from tallyframe.functions.ordered import Ordered, small
from tallyframe.session import cut


def score_counts(scored: DataFrame, keys: list[str], extra: list[str] | None = None) -> DataFrame:
    """Errors and correct rows per distinct score: all a rank statistic needs.

    Combines map-side, so copies and ties collapse before any shuffle.
    """
    ready = scored.withColumn("score", defined("score")).filter("score IS NOT NULL AND wrong IS NOT NULL")
    return ready.groupBy(*keys, *(extra or []), "score").agg(
        count_if(F.col("wrong")).alias("p"), count_if(~F.col("wrong")).alias("n")
    )


def auc_of_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """P(error scores below correct) with half ties, from running totals over distinct scores."""
    run = Ordered(cut(counts), keys, ["score"]).prefix({"upto": F.col("n")})
    above = F.sum(F.col("p") * (F.lit(0.5) * F.col("n") - F.col("upto")))
    out = run.groupBy(*keys).agg(
        above.alias("__a"), F.sum("p").cast("bigint").alias("n_wrong"), F.sum("n").cast("bigint").alias("n_right")
    )
    pairs = F.col("n_wrong").cast("double") * F.col("n_right")
    return out.withColumn("auc", F.try_divide(F.col("__a") + pairs, pairs)).drop("__a")


def auc(scored: DataFrame, keys: list[str]) -> DataFrame:
    return auc_of_counts(score_counts(scored, keys), keys)


def hanley_mcneil(aucs: DataFrame, z: float = 1.96) -> DataFrame:
    """Closed-form interval for an AUC of independent rows, clipped to [0, 1]."""
    a, p, n = F.col("auc"), F.col("n_wrong"), F.col("n_right")
    q1 = a / (F.lit(2.0) - a)
    q2 = F.lit(2.0) * a * a / (F.lit(1.0) + a)
    var = F.try_divide(
        a * (F.lit(1.0) - a) + (p - 1) * (q1 - a * a) + (n - 1) * (q2 - a * a), p.cast("double") * n
    )
    se = F.sqrt(F.greatest(var, F.lit(0.0)))
    known = a.isNotNull()
    return aucs.withColumn("lo", F.when(known, F.greatest(F.lit(0.0), a - z * se))).withColumn(
        "hi", F.when(known, F.least(F.lit(1.0), a + z * se))
    )


def verdict(a: Column) -> Column:
    return F.when(
        a.isNotNull(),
        first_of(
            [((a < 0.55) & (a > 0.45), "no signal"), (a <= 0.45, "inverted"), (a >= 0.70, "usable")], "weak"
        ),
    )


def average_rank(scored: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rank of each distinct value, ties sharing the mean of their places."""
    counts = cut(scored.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("ties")))
    run = Ordered(counts, keys, [value]).prefix({"upto": F.col("ties")})
    return run.withColumn("avg_rank", F.col("upto") - (F.col("ties") - 1) / F.lit(2.0)).drop("upto")


def common_subset(scored: DataFrame, item: list[str], n_rules: int) -> DataFrame:
    """Rows of the items on which every rule is defined."""
    whole = scored.groupBy(*item).agg(F.count("score").alias("__k")).filter(F.col("__k") == n_rules)
    return scored.join(whole.select(*item), item, "left_semi")


def scenarios(scored: DataFrame, matched: Column, present: Column) -> DataFrame:
    """The four readings of unmatched items, each row sent to the readings that include it."""
    wrong = F.coalesce(F.col("wrong"), F.lit(False))

    def case(name: str, keep: Column, err: Column) -> Column:
        return F.when(keep, F.struct(F.lit(name).alias("scenario"), err.alias("wrong")))

    options = F.array_compact(
        F.array(
            case("as_published", matched, wrong),
            case("worst_case", F.lit(True), F.when(matched, wrong).otherwise(True)),
            case("best_case", F.lit(True), F.when(matched, wrong).otherwise(False)),
            case("absent_level", matched | ~present, F.when(matched, wrong).otherwise(True)),
        )
    )
    rest = [c for c in scored.columns if c != "wrong"]
    return scored.withColumn("__o", F.explode(options)).select(*rest, "__o.scenario", "__o.wrong")


def flag_metrics(rows: DataFrame, keys: list[str], flag: Column, wrong: Column, checked: Column) -> DataFrame:
    """Firing rate, sensitivity, specificity, predictive values with their counts."""
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        count_if(flag).alias("n_flag"),
        count_if(wrong).alias("n_wrong"),
        count_if(flag & wrong).alias("n_hit"),
        count_if(~flag & ~wrong).alias("n_rest"),
        count_if(~checked).alias("not_checked"),
    )
    n, f, w, h, r = (F.col(c) for c in ("n", "n_flag", "n_wrong", "n_hit", "n_rest"))
    return out.select(
        *keys,
        "n",
        "n_flag",
        "n_wrong",
        "n_hit",
        "n_rest",
        "not_checked",
        ratio(f, n).alias("firing_rate"),
        ratio(h, w).alias("sensitivity"),
        ratio(r, n - w).alias("specificity"),
        ratio(h, f).alias("ppv"),
        ratio(r, n - f).alias("npv"),
        ratio(w, n).alias("prevalence"),
    )


def flag_agreement(rows: DataFrame, keys: list[str], a: Column, b: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(
        count_if(a & b).alias("both_flags"),
        count_if(a & ~b).alias("only_a"),
        count_if(~a & b).alias("only_b"),
        count_if(~a & ~b).alias("neither"),
    )


def clusters_flagged(rows: DataFrame, cluster: str, flag: Column) -> DataFrame:
    per = rows.groupBy(cluster).agg(F.bool_or(flag).alias("any_flag"))
    return per.agg(count_if(F.col("any_flag")).alias("num"), F.count(F.lit(1)).alias("den"))


def roc_points(scored: DataFrame, keys: list[str]) -> DataFrame:
    """One ROC / precision-recall point per distinct score, high score first, plus the origin.

    Here the positive class is the error and a high score marks it.
    """
    counts = cut(score_counts(scored, keys))
    total = cut(counts.groupBy(*keys).agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg")))
    run = Ordered(counts, keys, ["-score"])
    steps = run.on(run.prefix({"tp": F.col("p"), "fp": F.col("n")})).position("place")
    joined = steps.join(small(total), keys) if keys else steps.select(
        "*", total.select("n_pos").scalar().alias("n_pos"), total.select("n_neg").scalar().alias("n_neg")
    )
    tp, fp = F.col("tp"), F.col("fp")
    curve = joined.select(
        *keys,
        (F.col("place") + 1).alias("place"),
        F.col("score").alias("threshold"),
        "p",
        "n",
        ratio(tp, F.col("n_pos")).alias("tpr"),
        ratio(fp, F.col("n_neg")).alias("fpr"),
        ratio(tp, tp + fp).alias("precision"),
        "n_pos",
        "n_neg",
    )
    zero = total.select(
        *keys,
        F.lit(0).cast("bigint").alias("place"),
        F.lit(None).cast("double").alias("threshold"),
        F.lit(0).cast("bigint").alias("p"),
        F.lit(0).cast("bigint").alias("n"),
        F.lit(0.0).alias("tpr"),
        F.lit(0.0).alias("fpr"),
        F.lit(1.0).alias("precision"),
        "n_pos",
        "n_neg",
    )
    return curve.unionByName(zero)


def pr_summary(points: DataFrame, keys: list[str], operating: float) -> DataFrame:
    """Trapezoid ROC area, average precision, prevalence and the point at score > operating.

    A point's step back is known from its own p and n, so no neighbour lookup is needed.
    """
    pos, neg = F.col("n_pos"), F.col("n_neg")
    up = F.coalesce(ratio(F.col("p"), pos), F.lit(0.0))
    right = F.coalesce(ratio(F.col("n"), neg), F.lit(0.0))
    over = F.col("threshold") > operating
    hits, falls = F.sum(F.when(over, F.col("p"))), F.sum(F.when(over, F.col("n")))
    return points.groupBy(*keys).agg(
        F.sum(right * (F.col("tpr") - up / F.lit(2.0))).alias("auc"),
        F.sum(up * F.col("precision")).alias("average_precision"),
        F.max(ratio(pos, pos + neg)).alias("prevalence"),
        F.max(pos).cast("bigint").alias("n_pos"),
        F.max(neg).cast("bigint").alias("n_neg"),
        ratio(F.coalesce(hits, F.lit(0)), F.max(pos)).alias("op_tpr"),
        ratio(F.coalesce(falls, F.lit(0)), F.max(neg)).alias("op_fpr"),
        ratio(hits, hits + falls).alias("op_ppv"),
    )


def thin(points: DataFrame, keys: list[str], place: str, keep: int = 400) -> DataFrame:
    """Every k-th point of each curve, k = max(1, points div keep)."""
    n = cut(points.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")))
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / keep))
    return points.join(small(n), keys).filter(F.pmod(F.col(place), step) == 0).drop("__n")
