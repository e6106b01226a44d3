"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import released, written


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """``node, label``: for each end of a link ``a, b`` the smallest node it is connected with.

    With ``rounds``, some node it is connected with, after so many rounds: equal labels are connected, different ones
    may be.

    A node's least neighbour is an aggregate, so a hub of any size is combined before it is shuffled; each round is
    written to the shared folder.
    """
    edges = written(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before, done = None, 0
    while rounds is None or done < rounds:
        done += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = least.select("u", F.col("m").alias("v")).unionByName(moved)
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
        new = written(small)
        released(edges)
        edges = new
        if rounds is not None:
            continue
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    if rounds is not None:
        edges = edges.groupBy("u").agg(F.min("v").alias("v"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
    return found if rounds is None else found.groupBy("node").agg(F.min("label").alias("label"))
