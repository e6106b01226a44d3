"""A quality classifier by importance resampling.

Texts are bags of hashed features: words, and runs of five bytes. One generative model is counted over the clean
labelled documents of a bounded sample (the target), the other over all documents (raw). A document's log weight is the
log ratio of its probability under both, over the square root of its number of features, so that a long text's noise
does not outweigh what it says. Its key is the weight times ``SHARPNESS`` plus Gumbel noise, drawn from a hash of its
key; the documents with the k largest keys are a sample without replacement. k is the number of documents whose weight
reaches a bound calibrated on every labelled document outside the target sample.

Both models have ``BUCKETS`` counts whatever the corpus: tasks send dense parts of their count vectors, which are added
up as a stream.

Defined cases: null and empty texts have weight 0 like any text without features; without clean labels every weight is
0 and every document is kept; ties between keys go to the smaller document key; repeated rows and null ids are
documents of their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import KEY, SPACE, keyed, running, spans, text_blocks, word_hashes, written
from tallyframe.llm.labelled import lower_bound, verdicts
from tallyframe.session import ship

ship(__name__)

BITS = 20
BUCKETS = 1 << BITS
RUN = 5  # bytes in a run
PART = 1 << 14  # counts sent together
SAMPLE = 20_000  # most clean labelled documents that the target is counted on
SMOOTHING = 0.5
FALSE_ALARMS = 0.002
SHARPNESS = 50.0  # the inverse temperature of the sampling
SEED = 7


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, first of each document) for the words and for the byte runs of a block."""
    starts, ends, first = spans(data, offsets, SPACE)
    yield (word_hashes(data, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64), first
    if len(data) < RUN:
        yield np.zeros(0, np.int64), 0 * offsets
        return
    h = data[: len(data) - RUN + 1].astype(np.uint64)
    for i in range(1, RUN):
        h = h << np.uint64(8) | data[i : len(data) - RUN + 1 + i]
    # runs that would reach into the next document are left out
    last = np.concatenate([np.arange(max(0, e - RUN), min(e, len(h))) for e in offsets[1:].tolist()])
    keep = np.ones(len(h), bool)
    keep[last] = False
    buckets = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)[keep]
    yield buckets, np.concatenate([[0], np.cumsum(keep)])[np.minimum(offsets, len(h))]


def counts(docs: DataFrame) -> np.ndarray:
    """Feature counts of all documents and of those with ``target``, as two rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            target = batch.column(1).to_numpy(zero_copy_only=False)
            for low, high, data, offsets in text_blocks(batch.column(0)):
                for buckets, first in features(data, offsets):
                    total[0] += np.bincount(buckets, minlength=BUCKETS)
                    chosen = np.repeat(target[low:high], np.diff(first))
                    if chosen.any():
                        total[1] += np.bincount(buckets[chosen], minlength=BUCKETS)
        yield parts(total)

    def parts(total: np.ndarray) -> pa.RecordBatch:
        flat = total.reshape(-1, PART)
        some = np.flatnonzero(flat.any(1))
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([flat[i].tobytes() for i in some], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[part] = total.get(part, 0) + np.frombuffer(data, np.int64)
        columns = [pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["part", "counts"])

    kinds = "part int, counts binary"
    out = np.zeros((2 * BUCKETS // PART, PART), np.int64)
    for row in docs.select("text", "target").mapInArrow(run, kinds).repartition("part").mapInArrow(add, kinds).collect():
        out[row["part"]] += np.frombuffer(row["counts"], np.int64)  # 2 x BUCKETS numbers in all
    return out.reshape(2, BUCKETS)


def log_ratio(both: np.ndarray) -> np.ndarray:
    """Log of target probability over raw probability of each feature, smoothed; 0 where raw has none."""
    raw, target = both.astype(float)
    if not raw.any():
        return np.zeros(BUCKETS, np.float32)
    # the target's missing features fall back on their raw share, worth SMOOTHING occurrences or less
    p = (target + SMOOTHING * np.minimum(1, raw)) / (target.sum() + SMOOTHING * (raw > 0).sum())
    q = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * (raw > 0).sum())
    return np.where(raw > 0, np.log(np.maximum(p, 1e-300) / q), 0).astype(np.float32)


def log_weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``__key, doc_id, log_weight``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, size = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for low, high, data, offsets in text_blocks(batch.column(2)):
                for buckets, first in features(data, offsets):
                    total = np.concatenate([[0], np.cumsum(ratio[buckets], dtype=np.float64)])
                    score[low:high] += np.diff(total[first])
                    size[low:high] += np.diff(first)
            score /= np.sqrt(np.maximum(size, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(score, 6))], [KEY, "doc_id", "log_weight"])

    chosen = docs.select(KEY, F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(run, f"{KEY} bigint, doc_id bigint, log_weight double")


def resample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, false_alarms: float = FALSE_ALARMS, seed: int = SEED) -> DataFrame:
    """``__key, doc_id, log_weight, gumbel_key, kept`` of keyed documents."""
    docs = docs.select(KEY, "doc_id", F.col("text").cast("string").alias("text"))
    known = written(verdicts(labels))
    draw = F.xxhash64(F.lit(seed), "doc_id")  # half of the clean rows may be the target, the others calibrate
    target = known.filter(F.col("clean") & (F.pmod(draw, F.lit(2)) == 0)).orderBy(draw, "doc_id").limit(sample).select("doc_id")
    target = written(target)
    flagged = docs.join(F.broadcast(target.withColumn("target", F.lit(True))), "doc_id", "left")  # at most ``sample`` ids
    ratio = np.zeros(BUCKETS, np.float32)
    if target.take(1):
        ratio = log_ratio(counts(flagged.select("text", F.coalesce("target", F.lit(False)).alias("target"))))
    weights = written(log_weights(docs, ratio))
    held_out = known.join(F.broadcast(target), "doc_id", "left_anti")
    bound = lower_bound(weights.join(held_out, "doc_id").select(F.col("log_weight").alias("score"), "clean"), false_alarms)
    if bound is None and target.take(1):  # every clean row is in the target
        bound = lower_bound(weights.join(known, "doc_id").select(F.col("log_weight").alias("score"), "clean"), false_alarms)
    k = weights.count() if bound is None else weights.filter(F.col("log_weight") >= bound).count()
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), KEY), 11) + 0.5) / float(1 << 53)
    gumbel = weights.withColumn("gumbel_key", F.round(SHARPNESS * F.col("log_weight") - F.log(-F.log(uniform)), 6))
    gumbel = gumbel.withColumns({"__down": -F.col("gumbel_key"), "__one": F.lit(1)})
    ranked = running(gumbel, ["__down", KEY], {"__rank": "__one"})
    return ranked.select(KEY, "doc_id", "log_weight", "gumbel_key", (F.col("__rank") < k).alias("kept"))


def op7_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    docs = keyed(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    return resample(docs, spark.read.parquet(f"{folder}/labels.parquet")).drop(KEY)
