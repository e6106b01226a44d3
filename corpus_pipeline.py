"""A training corpus from raw documents: five stages, each on all that the one before kept.

Stages take documents (``doc_id, text`` and any other columns) and return the same columns; the last returns packed
pieces. Rows are told apart by a key of their own, so repeated ids, null ids and columns of any name are safe: a stage
decides on rows, and the row's other columns go with it. No documents in, none out.

* quality_classifier: documents that importance resampling does not draw go.
* near_duplicates: of each component of near duplicates (five-word shingles, similarity 0.8) the first row stays.
* repeated_substrings: bytes of 100-byte strings that also start earlier are cut out. Bytes of a character broken by
  that are dropped, whole characters stay, U+FFFD too; ``n_chars``, if there, is counted anew. Null texts stay null.
* decontamination: documents that hold ten consecutive words of a benchmark item, or a whole shorter one, go.
* packing: pieces of the documents' token ids in windows of 4096.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import KEY, keyed, written
from tallyframe.llm.decontaminate import contamination
from tallyframe.llm.minhash import NearDuplicates, near_duplicates
from tallyframe.llm.packing import pack
from tallyframe.llm.resampling import resample
from tallyframe.llm.substrings import without_repeats
from tallyframe.llm.tokens import tokenizer_path

ROW = "__row"
# Bytes, one letter each, of characters broken at the edges of a piece of UTF-8: their ends in front, beginnings behind.
BROKEN = r"^[\x80-\xBF]{1,3}|(?:[\xC2-\xDF]|[\xE0-\xEF][\x80-\xBF]?|[\xF0-\xF4][\x80-\xBF]{0,2})\z"


def rows_of(docs: DataFrame) -> DataFrame:
    """``__row`` (all columns), ``doc_id, text, __key``."""
    return keyed(docs.select(F.struct("*").alias(ROW), F.col("doc_id").cast("long"), F.col("text").cast("string")))


def only(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(keys.select(KEY), KEY, "left_semi").select(f"{ROW}.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = rows_of(docs)
    return only(rows, resample(rows, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("kept"))


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = rows_of(docs)
    return only(rows, near_duplicates(rows, NearDuplicates()).filter(F.col(KEY) == F.col("component")))


def between(text: Column, starts: Column, ends: Column) -> Column:
    """The whole characters of ``text`` outside the removed runs of bytes; pieces are read alone, so none joins another."""
    data = text.cast("binary")

    def whole(low: Column, high: Column) -> Column:
        piece = F.decode(F.substring(data, (low + 1).cast("int"), (high - low).cast("int")), "ISO-8859-1")
        return F.encode(F.regexp_replace(piece, BROKEN, ""), "ISO-8859-1").cast("string")

    lows = F.concat(F.array(F.lit(0).cast("long")), ends)
    highs = F.concat(starts, F.array(F.octet_length(data).cast("long")))
    return F.array_join(F.zip_with(lows, highs, whole), "")


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = rows_of(docs)
    cut = without_repeats(rows).filter(F.size("starts") > 0).select(KEY, "starts", "ends")
    text = between(F.col(f"{ROW}.text").cast("string"), F.col("starts"), F.col("ends"))
    both = rows.select(ROW, KEY).join(cut, KEY, "left").withColumn("__text", text)
    value = F.when(F.col("starts").isNull(), F.col(f"{ROW}.text").cast("string")).otherwise(F.col("__text"))
    row = F.col(ROW).withField("text", value)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        n_chars = F.when(F.col("starts").isNull(), F.col(f"{ROW}.n_chars")).otherwise(F.length("__text").cast(kind))
        row = row.withField("n_chars", n_chars)
    return both.select(row.alias(ROW)).select(f"{ROW}.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = rows_of(docs)
    return only(rows, contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("n_hit = 0"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicate_removal),
    ("repeated_substrings", repeated_substrings),
    ("decontamination", decontamination),
    ("packing", packing),
]

# Trained weights, components of links and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
