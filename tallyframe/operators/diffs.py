"""Comparing what was sent with what came back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import count_if

def dataset_diff(sent: DataFrame, got: DataFrame, item: str, key: str, value: str) -> DataFrame:
    """One row per removed, added or changed key of the top level, and per key lost below it.

    Keys below the top level are paths with a slash. ``nested`` marks values that are structures: these are removed or
    added like any other, but never count as changed.
    """
    a = sent.select(item, key, F.col(value).alias("__a"), F.col("nested").alias("__na"), F.lit(True).alias("__ia"))
    b = got.select(item, key, F.col(value).alias("__b"), F.lit(True).alias("__ib"))
    both = a.join(b, [item, key], "full_outer")
    below = F.contains(F.col(key), F.lit("/"))
    kind = (
        F.when(below, F.when(F.col("__ib").isNull(), "nested_lost"))
        .when(F.col("__ib").isNull(), "removed")
        .when(F.col("__ia").isNull(), "added")
        .when(~F.col("__na") & ~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    )
    return both.withColumn("kind", kind).filter("kind IS NOT NULL").select(item, key, "kind")


def diff_report(diff: DataFrame, item: str, key: str) -> DataFrame:
    """Sorted key lists per object and kind, and how many there are: as many as the object has keys."""
    return diff.groupBy(item, "kind").agg(
        F.array_join(F.array_sort(F.collect_list(key)), ",").alias("listed"), F.count(F.lit(1)).alias("n")
    )


def roundtrip(sent: DataFrame, got: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Cells compared, cells that differ and the largest error; missing cells report -1 as error."""
    a = sent.select(*keys, F.col(value).alias("__a"), F.lit(1).alias("__ia"))
    b = got.select(*keys, F.col(value).alias("__b"), F.lit(1).alias("__ib"))
    both = a.join(b, keys, "full_outer")
    shape = F.count_if(F.col("__ia").isNull() | F.col("__ib").isNull())
    return both.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_cells"),
        count_if(~F.col("__a").eqNullSafe(F.col("__b"))).alias("n_differ"),
        F.when(shape > 0, F.lit(-1.0)).otherwise(F.max(F.abs(F.col("__a") - F.col("__b")))).alias("max_error"),
    )


def digest_classes(rows: DataFrame, item: str, content: Column) -> DataFrame:
    """Outputs sharing a digest: size of the class and its first member."""
    return (
        rows.select(item, F.sha2(content, 256).alias("digest"))
        .groupBy("digest")
        .agg(F.count(F.lit(1)).cast("bigint").alias("members"), F.min(item).alias("first_member"))
    )


def difference_profile(cells: DataFrame, row: str, value: str) -> DataFrame:
    """Cells that differ, rows they occupy, mean per occupied row, distinct values."""
    per = cells.filter(F.col(value) != 0).groupBy(row).agg(F.count(F.lit(1)).alias("c"))
    values = cells.filter(F.col(value) != 0).agg(F.count_distinct(value).alias("v"))
    return per.agg(
        F.sum("c").cast("bigint").alias("cells"),
        F.count(F.lit(1)).cast("bigint").alias("rows_occupied"),
        F.avg("c").alias("mean_per_row"),
    ).withColumn("distinct_values", values.scalar().cast("bigint"))
