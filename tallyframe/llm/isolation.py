"""Quality rules: an isolation forest on rule statistics.

Each text is summed up in counts that simple rules use. Documents that a rule fails outright are rejected. For the rest
a forest of random splits, grown on a bounded sample of clean labelled documents, gives path lengths: what few splits
set apart is anomalous. The bound on the anomaly score is calibrated on all labelled documents.

Defined cases: null and empty texts have no words and fail; without clean labels the forest says nothing and only the
rules count; repeated rows and null ids are documents of their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import KEY, SPACE, keyed, mixed, shingle_hashes, spans, text_blocks, word_hashes, written
from tallyframe.llm.labelled import lower_bound, verdicts
from tallyframe.session import ship

ship(__name__)

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SAMPLE = 20_000  # most clean labelled documents that the forest is grown on
TREES, ROWS, DEPTH = 100, 256, 8
MARGIN = 1.5  # how far beyond its rows' range a split may fall, in ranges
FALSE_ALARMS = 0.002
SEED = 8


def again(owner: np.ndarray, hashes: np.ndarray, keep: str | bool) -> np.ndarray:
    """Which hashes occur before (keep='first') or at all (keep=False) elsewhere with the same owner."""
    return pd.Series(hashes ^ mixed(owner.astype(np.uint64) + np.uint64(1))).duplicated(keep=keep).to_numpy()


def block_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of COUNTS per document of a block."""
    starts, ends, first = spans(data, offsets, SPACE)
    docs = len(offsets) - 1
    n_words = np.diff(first)
    ahead = np.concatenate([[0], np.cumsum(~SPACE[data] & (data & 0xC0 != 0x80))])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    per_doc = lambda total: np.diff(total[offsets])

    ending = data == 10
    ending[offsets[1:] - 1] = True
    stops = np.flatnonzero(ending)
    begins = np.concatenate([[0], stops[:-1] + 1])
    line_doc = np.searchsorted(offsets, stops, side="right") - 1
    full = np.searchsorted(starts, stops) > np.searchsorted(starts, begins)
    begins, stops, line_doc = begins[full], stops[full], line_doc[full]
    dup_lines = np.bincount(line_doc[again(line_doc, word_hashes(data, begins, stops), "first")], minlength=docs)

    owner = np.repeat(np.arange(docs), n_words)
    repeats = np.zeros(docs, np.int64)
    runs = shingle_hashes(word_hashes(data, starts, ends), 3)
    if len(runs):
        whole = owner[2:] == owner[:-2]
        at = np.flatnonzero(whole)
        at = at[again(owner[at], runs[at], False)]
        hit = np.zeros(len(owner), bool)
        for i in range(3):
            hit[at + i] = True
        repeats = np.bincount(owner[hit], minlength=docs)
    return np.column_stack([n_words, per_doc(ahead), per_doc(symbols), dup_lines, repeats]).astype(np.int64)


def statistics(docs: DataFrame) -> DataFrame:
    """``__key, doc_id`` and COUNTS of keyed documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_blocks(batch.column(2)):
                rows, found = batch.slice(low, high - low), block_counts(data, offsets)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *map(pa.array, found.T.copy())], [KEY, "doc_id", *COUNTS])

    chosen = docs.select(KEY, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, f"{KEY} bigint, doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS))


def ratios(counts: np.ndarray) -> np.ndarray:
    """What the forest splits on: length, word length, and shares of symbols, equal lines and repeated words."""
    n = np.maximum(counts[:, 0], 1)
    return np.column_stack([np.log1p(counts[:, 0]), counts[:, 1] / n, counts[:, 2] / n, counts[:, 3] / np.sqrt(n), counts[:, 4] / n])


def mean_path(n: np.ndarray) -> np.ndarray:
    """Average path length of an unsuccessful search among n rows."""
    m = np.maximum(n, 2).astype(float)
    return np.where(n > 2, 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


class Forest:
    """Complete binary trees as arrays: node i has the children 2i + 1 and 2i + 2."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, size: int = ROWS, depth: int = DEPTH, seed: int = SEED):
        draw = np.random.default_rng(seed)
        nodes = (1 << depth + 1) - 1
        self.depth, self.size = depth, min(size, len(rows))
        spread = np.maximum(np.ptp(rows, axis=0), 0.1)
        self.feature = np.full((trees, nodes), -1)
        self.value = np.zeros((trees, nodes))
        self.length = np.zeros((trees, nodes))
        for tree in range(trees):
            parts = {0: rows[draw.choice(len(rows), self.size, replace=False)]}
            for node in range(nodes):
                part = parts.pop(node, None)
                if part is None:
                    continue
                level = (node + 1).bit_length() - 1
                if level == depth or len(part) < 2:
                    self.length[tree, node] = level + mean_path(np.array(len(part)))
                    continue
                f = draw.integers(rows.shape[1])
                low, high = part[:, f].min(), part[:, f].max()
                # beyond the rows' own range, so that what lies outside it is set apart early
                room = MARGIN * max(high - low, 0.1 * spread[f])
                at = draw.uniform(low - room, high + room)
                self.feature[tree, node], self.value[tree, node] = f, at
                parts[2 * node + 1], parts[2 * node + 2] = part[part[:, f] < at], part[part[:, f] >= at]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly scores, 0 to 1."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, value, length in zip(self.feature, self.value, self.length):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                step = 2 * node + 1 + (rows[every, np.maximum(f, 0)] >= value[node])
                node = np.where(f < 0, node, step)
            total += length[node]
        return 2 ** -(total / len(self.feature) / max(float(mean_path(np.array(self.size))), 1e-9))


def anomaly(counted: DataFrame, forest: Forest) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = forest.score(ratios(np.column_stack([c.to_numpy() for c in batch.columns[2:]])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(found, 9))], [*batch.schema.names, "anomaly"])

    kinds = f"{KEY} bigint, doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)
    return counted.select(KEY, "doc_id", *COUNTS).mapInArrow(run, kinds + ", anomaly double")


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, false_alarms: float = FALSE_ALARMS) -> DataFrame:
    """``__key, doc_id``, COUNTS, ``anomaly`` (null without a forest), ``base_failed, kept`` of keyed documents."""
    counted = written(statistics(docs))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    labelled = written(counted.filter(~failed).join(verdicts(labels), "doc_id"))
    order = [F.xxhash64(F.lit(SEED), "doc_id"), F.col(KEY)]
    rows = labelled.filter("clean").orderBy(*order).limit(sample).select(*COUNTS).toPandas()
    bound = None
    if len(rows):
        forest = Forest(ratios(rows.to_numpy(np.int64)))
        scored = anomaly(counted, forest)
        known = anomaly(labelled, forest).join(labelled.select(KEY, "clean"), KEY)
        bound = lower_bound(known.select((-F.col("anomaly")).alias("score"), "clean"), false_alarms)
    else:
        scored = counted.withColumn("anomaly", F.lit(None).cast("double"))
    normal = F.lit(True) if bound is None else -F.col("anomaly") >= bound
    return scored.select(KEY, "doc_id", *COUNTS, "anomaly", failed.alias("base_failed"), (~failed & normal).alias("kept"))


def op8_isolation_forest(spark: SparkSession, folder: str) -> DataFrame:
    docs = keyed(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    out = judged(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")
