"""Token ids in ORC: run-length coded integers in stripes, row indexes and Bloom filters on document ids.

``write_tokens`` encodes whole texts and writes ``doc_id, seq, part, ids`` sorted by document id; Spark's ORC writer
codes the integers by run length, keeps minimum and maximum per stripe and per row group, and a Bloom filter on
``doc_id``. ``read_tokens`` reads stripes in parallel; ``find_tokens`` lets ORC skip stripes and row groups by those.

Defined cases: a null or empty text is the end id alone. Rows that repeat a doc_id, or have none, are documents of
their own; they follow each other in the order of their texts' hashes, null ids last. No rows give no files to read
but a table without rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import KEY, keyed, list_array, shuffle_partitions
from tallyframe.llm.tokens import END_ID, encoded, shared_encoder, tokenizer_path
from tallyframe.session import shared_path, ship

ship(__name__)

STRIPE_BYTES = 16 << 20
ROW_GROUP = 1000
FILE_COLUMNS = "doc_id bigint, seq bigint, part int, ids array<int>"


def token_rows(docs: DataFrame, tokenizer: str, end_id: int = END_ID, packed: bool = False) -> DataFrame:
    """``__key, doc_id, n, ids``: the ids of each whole text and ``end_id``; ``docs`` are keyed.

    packed: ``ids`` as bytes, two or four per id as the vocabulary needs, for rows that are shuffled.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared_encoder(tokenizer)
        kind = id_type(held.tokenizer.get_vocab_size())
        for batch in batches:
            for low, high, ids, offsets in encoded(batch.column(2), held, end_id):
                rows = batch.slice(low, high - low)
                if packed:
                    data = pa.py_buffer(ids.astype(kind))
                    ends = pa.py_buffer((offsets * np.dtype(kind).itemsize).astype(np.int32))
                    values = pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, ends, data])
                else:
                    values = list_array(pa.array(ids), offsets)
                columns = [rows.column(0), rows.column(1), pa.array(np.diff(offsets).astype(np.int64)), values]
                yield pa.RecordBatch.from_arrays(columns, [KEY, "doc_id", "n", "ids"])

    chosen = docs.select(KEY, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(encode, f"{KEY} bigint, doc_id bigint, n bigint, ids {'binary' if packed else 'array<int>'}")


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    rows = keyed(docs.select("doc_id", "text"))
    ranged = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), KEY).sortWithinPartitions(KEY)
    out = token_rows(ranged, tokenizer, end_id).select(
        "doc_id", F.col(KEY).alias("seq"), F.spark_partition_id().alias("part"), "ids"
    )
    (
        out.write.option("orc.compress", "ZSTD")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", ROW_GROUP)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, seq, part, ids`` of all files."""
    return spark.read.schema(FILE_COLUMNS).orc(path)


def find_tokens(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents; stripes and row groups without them are skipped by their metadata."""
    return read_tokens(spark, path).filter(F.col("doc_id").isin(list(doc_ids)))


def starts(lengths: DataFrame) -> DataFrame:
    """Adds ``start``: ids of all documents before, from ``part, seq, n_tokens``. Parts are summed alone first."""
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = lengths.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    parts = parts.select("part", F.coalesce(F.sum("total").over(earlier.orderBy("part")), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n_tokens").over(earlier.partitionBy("part").orderBy("seq")), F.lit(0))
    # One row per file part: far fewer than documents, joined as Spark sees fit.
    return lengths.withColumn("inside", inside).join(parts, "part").withColumn("start", F.col("base") + F.col("inside"))


def crc_of_ids(ids: pa.Array) -> pa.Array:
    """CRC-32 of each list's ids as little-endian unsigned 32-bit integers."""
    offsets = ids.offsets.to_numpy()
    data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4").view(np.uint8))
    return pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.int64())


def with_crc(df: DataFrame) -> DataFrame:
    """``df`` with its last column, ``ids``, replaced by ``n_tokens`` and ``ids_crc32``."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            lengths = pa.array(np.diff(ids.offsets.to_numpy()).astype(np.int64))
            columns = [*batch.columns[:-1], lengths, crc_of_ids(ids)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "n_tokens", "ids_crc32"])

    assert df.columns[-1] == "ids"
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1])
    return df.mapInArrow(digest, f"{head}, n_tokens bigint, ids_crc32 bigint")


def op2_token_orc(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{folder}/documents.parquet"), path, tokenizer_path("byte_bpe_50k.json"))
    digests = with_crc(read_tokens(spark, path))
    return starts(digests).select("doc_id", "start", "n_tokens", "ids_crc32")
