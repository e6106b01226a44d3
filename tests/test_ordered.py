"""The oversized-group ways must give exactly what the ordinary windows give."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.functions.ordered import Grouped, Ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 300
    key = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 6, n))
    pdf = pd.DataFrame(
        {
            "k": key,
            "t": np.where(rng.random(n) < 0.3, 5, rng.integers(0, 20, n)),
            "id": np.arange(n),
            "v": rng.integers(0, 9, n).astype(float),
        }
    )
    pdf["h"] = np.where(rng.random(n) < 0.1, pdf["id"].astype(float), np.nan)
    df = spark.createDataFrame(pdf)
    return df.withColumn("h", F.nanvl("h", F.lit(None).cast("double")))


def both(make):
    usual = sorted(make(None).collect())
    forced = sorted(make(7).collect())
    return usual, forced


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("order", [["t", "id"], ["-t", "id"]])
def test_prefix_and_position(rows, keys, order):
    for op in (
        lambda o: o.prefix({"s": F.col("v")}).select("id", "s"),
        lambda o: o.position().select("id", "pos"),
        lambda o: o.neighbours({"a": ("v", -2), "b": ("v", 1)}).select("id", F.coalesce("a", F.lit(-1.0)), F.coalesce("b", F.lit(-1.0))),
    ):
        usual, forced = both(lambda lim: op(Ordered(rows, keys, order, lim)))
        assert usual == forced and len(usual) == 300


def test_carry(rows):
    usual, forced = both(
        lambda lim: Ordered(rows, ["k"], ["t", "id"], lim).carry("h", "c").select("id", F.coalesce("c", F.lit(-1.0)))
    )
    assert usual == forced


def test_stats_and_quantiles(rows):
    usual, forced = both(
        lambda lim: Grouped(rows, ["k"], lim).with_stats({"m": F.avg("v")}, ["id"]).select("id", F.round("m", 9))
    )
    assert usual == forced
    usual, forced = both(
        lambda lim: Grouped(rows, ["k"], lim).quantiles("v", {"q": 0.5, "r": 0.9}).select("k", F.round("q", 9), F.round("r", 9))
    )
    assert usual == forced
    usual, forced = both(
        lambda lim: Grouped(rows, ["k"], lim).with_quantiles("v", {"q": 0.25}, ["id"]).select("id", F.round("q", 9))
    )
    assert usual == forced


def test_quantiles_of_one_oversized_table(rows):
    usual, forced = both(lambda lim: Grouped(rows, [], lim).quantiles("v", {"q": 0.5, "r": 0.9}).select(F.round("q", 9), F.round("r", 9)))
    assert usual == forced


def test_pieces_of_long_prefixes_null_keys_and_one_sort_column(spark):
    """Strings with a common start, a NULL key and a single sort column are all cut within the limit."""
    urls = spark.range(4000).select(F.lit("u").alias("k"), F.concat(F.lit("https://x/"), F.format_string("%06d", "id")).alias("t"), F.lit(1).alias("v"))
    nulls = spark.range(2000).select(F.lit(None).cast("string").alias("k"), F.format_string("%05d", "id").alias("t"), F.lit(1).alias("v"))
    few = spark.range(9).select(F.lit("s").alias("k"), F.format_string("%05d", "id").alias("t"), F.lit(1).alias("v"))
    df = urls.unionByName(nulls).unionByName(few)
    o = Ordered(df, ["k"], ["t"], 100)
    most = o.pieced.groupBy("k", "__piece").count().agg(F.max("count")).first()[0]
    assert most <= 100
    usual = sorted(map(repr, Ordered(df, ["k"], ["t"]).prefix({"s": F.col("v")}).collect()))
    assert sorted(map(repr, o.prefix({"s": F.col("v")}).collect())) == usual
