"""Labels of documents, and thresholds calibrated on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import running, written


def verdicts(labels: DataFrame) -> DataFrame:
    """``doc_id, clean``: one row per labelled document. clean: of good quality and not toxic, by every row it has.

    Rows without an id, or with neither label, say nothing.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull()))
    clean = (F.coalesce("quality", F.lit(1)) > 0) & (F.coalesce("toxic", F.lit(0)) == 0)
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(clean).alias("clean"))


def lower_bound(scores: DataFrame, false_alarms: float) -> float | None:
    """The score below which documents are rejected, from all rows of ``score, clean``; None without clean rows.

    Rejects most rows that are not clean while at most the share ``false_alarms`` of the clean ones goes; in the middle
    between two scores. Counts of the distinct scores are summed up in score order by Spark, so the labels may be any
    number and outlying scores make the bound no coarser.
    """
    counts = scores.groupBy("score").agg(F.count_if("clean").alias("clean"), F.count_if(~F.col("clean")).alias("other"))
    counts = written(counts)
    total = counts.agg(F.sum("clean")).first()[0]
    if not total:
        return None
    # at each score everything below it is rejected
    edges = running(counts, ["score"], {"gone": "clean", "caught": "other"}).filter(F.col("gone") <= false_alarms * total)
    edge = edges.agg(F.max(F.struct((F.col("caught") - F.col("gone")).alias("gain"), (-F.col("score")).alias("down"))).alias("best"))
    high = -edge.select("best.down").first()[0]
    low = counts.filter(F.col("score") < high).agg(F.max("score")).first()[0]
    middle = high if low is None else low + (high - low) / 2
    return float(high if middle == low else middle)  # low itself is rejected
