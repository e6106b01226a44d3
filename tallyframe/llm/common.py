"""What the training-data operators share: keyed documents, written tables, running totals, words as arrays.

Documents are rows with a long ``doc_id`` and a string ``text``; every other column is ignored unless an operator says
otherwise. ``keyed`` gives each row a key of its own, so repeated rows and null ids need no special care further on.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.session import shared_path, ship

ship(__name__)

KEY = "__key"
# Bytes of text that a task turns into arrays at once; a longer document is a block of its own.
BLOCK = 1 << 20


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """The same rows, written as Parquet to the shared checkpoint folder and read back: lineage ends here."""
    spark = df.sparkSession
    path = shared_path(spark, "llm")
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def released(*tables: DataFrame) -> None:
    """Delete written tables that no later step reads."""
    for df in tables:
        path = getattr(df, "_llm_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def keyed(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` and a unique long key whose order is that of (id, nulls last, text).

    Unique, non-null ids are the key themselves. Otherwise the rows are sorted once and numbered, so each repeated row
    stays a document of its own.
    """
    odd = docs.groupBy(id_column).count().filter((F.col("count") > 1) | F.col(id_column).isNull())
    if not odd.take(1):
        return docs.withColumn(KEY, F.col(id_column).cast("long"))
    order = [F.col(id_column).isNull(), F.col(id_column), F.xxhash64(text)]
    ranged = docs.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return written(ranged.withColumn(KEY, F.monotonically_increasing_id()))


def running(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """``df`` with, for each ``new: column`` in ``sums``, the total of the rows before it in ``order``.

    Range partitions are summed alone and only their totals, one row per partition, are added up.
    """
    spark = df.sparkSession
    ranged = written(
        df.repartitionByRange(shuffle_partitions(spark), *order).withColumn("__part", F.spark_partition_id())
    )
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    totals = totals.select("__part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in sums.items()])
    out = out.join(F.broadcast(totals), "__part")  # one row per range partition
    return out.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop("__part", *[f"__{n}" for n in sums])


# -- text as arrays ----------------------------------------------------------------------------------------------


def byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


# Bytes between words: white space; or every ASCII character that is no digit and no lower-case letter.
SPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)])
NON_WORD = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


GLUE = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())


def text_blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets): whole documents, each followed by one space. Nulls are empty."""
    for low, high in cuts(column, limit):
        part = pc.binary_join_element_wise(column.slice(low, high - low).cast(pa.large_string()).fill_null(""), *GLUE)
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        yield low, high, data, offsets - offsets[0]


def cuts(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(ends):
        base = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield low, high
        low = high


def spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in a block, and for each document the number of the first word (and the total)."""
    inside = ~between[data]
    inside[offsets[1:] - 1] = False  # the space after each document
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


def kept(name: str, make):
    """What ``make`` returned first in this Python process; shipped modules are rebuilt for each task, this is not."""
    held = sys.__dict__.setdefault("_tallyframe_kept", {})
    if name not in held:
        held[name] = make()
    return held[name]


def hash_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    return kept("hash tables", draw_tables)


def draw_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    draw = np.random.default_rng(20240607).integers(0, 2**63, 257, dtype=np.int64).astype(np.uint64)
    return (draw[:256] << np.uint64(1)) ^ draw[:256] >> np.uint64(11) | np.uint64(1), [np.ones(1, np.uint64)] * 2


FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    held = hash_tables()[1]
    if len(held[0]) < size:
        for i, base in enumerate((FACTOR, INVERSE)):
            factors = np.full(size + 1, base, np.uint64)
            factors[0] = 1
            held[i] = np.multiply.accumulate(factors)
    return held[0], held[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ h >> np.uint64(33)
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(33)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever it stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(hash_tables()[0][data] * up[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on; the last places have none."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for i in range(1, size):
        h = h * np.uint64(FACTOR) ^ h >> np.uint64(29)
        h += words[i : n + i]
    return mixed(h)


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def list_array(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
