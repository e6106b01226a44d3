"""Word n-grams of whole texts as DataFrame expressions, matched against a small table of wanted ones."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import KEY

# Everything between words: ASCII characters other than digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Rows of a table of wanted n-grams that may be broadcast; it is counted first.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.array_remove(F.split(lowered, BETWEEN), "")


def grams(of: Column, size: int) -> Column:
    """The n-grams from each word on, words apart by one space; the last ones are shorter."""
    return F.transform(of, lambda x, i: F.concat_ws(" ", x, *[F.get(of, i + j) for j in range(1, size)]))


def wanted(table: DataFrame) -> DataFrame:
    """``table``, broadcast if it was counted to be small; otherwise Spark shuffles both sides."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def bare(docs: DataFrame) -> DataFrame:
    """``__key, words`` of keyed documents."""
    return docs.select(KEY, words(F.col("text").cast("string")).alias("words"))


def exploded(parts: DataFrame, value: Column) -> DataFrame:
    """``__key, n_words, place, value``: a row per element of ``value``, places from 0, and one row with place -1."""
    all_values = F.concat(F.array(F.lit(None)), value)
    n_words = F.size("words").cast("long").alias("n_words")
    rows = parts.select(KEY, n_words, F.posexplode(all_values).alias("place", "value"))
    return rows.withColumn("place", F.col("place") - 1)
