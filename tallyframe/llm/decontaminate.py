"""Benchmark decontamination as a prefix-filtered join of word shingles.

Each item is cut into windows of ``window`` consecutive words (a shorter item is one window). A window's shingles are
ordered by how often they occur in the documents; for a window to be contained whole, its rarest shingle must be, so
that one is its prefix, and only it is joined for candidates. The place of the shingle bounds where the window starts;
start and length must lie within the document. Candidates are verified: every shingle of the window at its own place.

Only DataFrame operations. One pass over the documents matches all benchmark shingles, which is where the frequencies
come from; everything after it works on those matches.

Defined cases: null and empty texts have no words and no hits; items without an id or words are ignored; an item given
twice counts once; repeated document rows and null ids are documents of their own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import KEY, keyed, written
from tallyframe.llm.grams import bare, exploded, grams, wanted, words

WINDOW = 10
SHINGLE = 3


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """``item, words, text``: each item's windows."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text").cast("string")).alias("all"))
    items = items.filter(F.col("item").isNotNull() & (F.size("all") > 0))
    first = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - window + 1))).alias("first")
    cut = items.select("item", "all", first).select("item", F.slice("all", F.col("first"), window).alias("words"))
    return cut.withColumn("text", F.concat_ws(" ", "words")).distinct()


def window_shingles(windows: DataFrame, size: int) -> DataFrame:
    """``text, length, size, count, offset, shingle`` of each distinct window; short ones have shorter shingles."""
    distinct = windows.select("text", "words").distinct()
    out = None
    for n in range(1, size + 1):
        fits = (F.size("words") == n) if n < size else (F.size("words") >= n)
        count = F.size("words") - n + 1
        part = distinct.filter(fits).select(
            "text",
            F.size("words").alias("length"),
            F.lit(n).alias("size"),
            count.alias("count"),
            F.posexplode(F.slice(grams(F.col("words"), n), F.lit(1), count)).alias("offset", "shingle"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, size: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(``__key, n_words`` of all documents; ``__key, start, length, text`` of windows found; ``text, item``)."""
    windows = written(item_windows(benchmark, window))
    shingles = written(window_shingles(windows, size))
    parts = bare(docs)
    scan = None
    for row in shingles.groupBy("size").count().orderBy(F.desc("size")).collect() or [{"size": size}]:  # at most three sizes
        n = row["size"]
        mine = shingles.filter(F.col("size") == n).select(F.col("shingle").alias("value"), F.lit(True).alias("there")).distinct()
        found = exploded(parts, grams(F.col("words"), n)).join(wanted(mine), "value", "left")
        found = found.filter((F.col("place") < 0) | F.col("there")).withColumn("size", F.lit(n))
        found = found.filter((F.col("place") + n <= F.col("n_words")) | (F.col("place") < 0))
        scan = found if scan is None else scan.unionByName(found.filter("place >= 0"))
    scan = written(scan.select(KEY, "n_words", "place", "size", "value"))
    counted = scan.filter("place < 0").select(KEY, "n_words")
    hits = scan.filter("place >= 0")

    often = hits.groupBy("value").agg(F.count(F.lit(1)).alias("often"))
    known = shingles.join(often, shingles["shingle"] == often["value"]).drop("value")
    rarest = F.min(F.struct("often", "offset", "shingle")).alias("rarest")
    prefix = known.groupBy("text", "length", "count").agg(rarest, F.count(F.lit(1)).alias("present"))
    prefix = prefix.filter(F.col("present") == F.col("count"))  # every shingle occurs somewhere
    prefix = prefix.select("text", "length", "count", F.col("rarest.offset").alias("offset"), F.col("rarest.shingle").alias("value"))
    start = (F.col("place") - F.col("offset")).alias("start")
    candidates = hits.join(wanted(written(prefix)), "value").select(KEY, "n_words", start, "length", "count", "text")
    candidates = candidates.filter((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n_words")))
    parts_of = shingles.select("text", "offset", F.col("shingle").alias("value"))
    needed = candidates.join(wanted(parts_of), "text").withColumn("place", F.col("start") + F.col("offset"))
    there = needed.join(hits.select(KEY, "place", "value"), [KEY, "place", "value"])
    verified = there.groupBy(KEY, "start", "length", "text", "count").agg(F.count(F.lit(1)).alias("n"))
    verified = verified.filter(F.col("n") == F.col("count")).select(KEY, "start", "length", "text")
    return counted, written(verified), windows.select("text", "item")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, size: int = SHINGLE) -> DataFrame:
    """``__key, n_words, n_hit, items`` (sorted strings) of keyed documents."""
    counted, found, of_items = occurrences(docs, benchmark, window, size)
    places = found.select(KEY, F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("place")).distinct()
    n_hit = places.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_hit"))
    items = found.select(KEY, "text").distinct().join(of_items, "text").select(KEY, "item").distinct()
    items = items.groupBy(KEY).agg(F.sort_array(F.collect_list("item")).alias("items"))
    whole = counted.join(n_hit, KEY, "left").join(items, KEY, "left")
    return whole.select(
        KEY,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def op9_prefix_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = keyed(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    found = contamination(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    return docs.select(KEY, "doc_id").join(found, KEY).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i : i + 9], ' ') AS t
  FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS u(i) WHERE len(w) > 0 AND item IS NOT NULL),
pos AS (
  SELECT doc_id, s.size, i, array_to_string(w[i : i + s.size - 1], ' ') AS t
  FROM d, (SELECT DISTINCT size FROM win) AS s, unnest(range(1, len(w) - s.size + 2)) AS u(i)),
occ AS (SELECT doc_id, i, pos.size, item FROM pos JOIN win ON pos.t = win.t AND pos.size = win.size),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM occ)) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
