"""LM scoring with a Brown class-based bigram model: exchange clustering assigns words to classes.

P(w | v) = P(class(w) | class(v)) P(w | class(w)). Tokens are words, and one end after each text; the end is a class of
its own and also what a text starts after. Words with at least ``SHARE`` of all training tokens are clustered: there
are at most 1 / SHARE of them in any corpus, so their table may be sent to every task. All rarer words form one class.
Within it a known word takes its share of the class, and words never seen take the part that words seen once suggest.

Exchange: each round counts, over the whole training text, how often each clustered word stands before and after each
class. Every word is then tried in every class, without its own counts in its present one, and moves to where the text
becomes likeliest; in each round a different half of the words may move. Rounds are one pass over the texts; counts
leave a task as packed parts of a dense array. The best assignment by mutual information is kept.

The words themselves are known by 64-bit hashes. Counts of rare words are never brought together: they stay in slices
by hash, and the occurrences to score are sent there in packed rows.

Defined cases: null and empty texts are the end alone; documents without an id are training text; with no training
text every token has base probability 1 / 1 and model probability by the smoothing alone; repeated rows are scored
each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import KEY, LOWER, SPACE, keyed, mixed, shuffle_partitions, spans, text_blocks, word_hashes, written
from tallyframe.session import ship

ship(__name__)

CLASSES = 62
ROUNDS = 4
SHARE = 2e-6
GATHERED = 4_000_000  # rare words a task gathers before it sends them
END = np.uint64(0)  # the end's hash; no word has it but by a chance of 2^-64


def held_out(doc_id: Column) -> Column:
    """Documents that the model does not learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, token hashes with an end after each text, offsets)."""
    for low, high, data, offsets in text_blocks(column):
        data = LOWER[data]
        starts, ends, first = spans(data, offsets, SPACE)
        yield low, high, np.insert(word_hashes(data, starts, ends), first[1:], END), first + np.arange(len(first))


def slice_of(hashes: np.ndarray, slices: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)


def packed(slices: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row per slice: its number, and the bytes of each column's values there."""
    order = np.argsort(slices, kind="stable")
    some, first = np.unique(slices[order], return_index=True)
    edges = np.append(first, len(order))
    out = [pa.array(some.astype(np.int32))]
    for column in columns:
        values = column[order]
        out.append(pa.array([values[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary()))
    return pa.RecordBatch.from_arrays(out, ["slice", "a", "b", "c", "d"][: len(out)])


def merged(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    codes, unique = pd.factorize(np.concatenate(hashes))
    return unique, np.bincount(codes, np.concatenate(counts), len(unique)).astype(np.int64)


def vocabulary(docs: DataFrame, slices: int) -> DataFrame:
    """``slice, words, counts, total, once``: all words of the texts, ends included; words sorted within a slice."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, size = [], [], 0
        for batch in batches:
            for _, _, found, _ in tokens(batch.column(0)):
                codes, unique = pd.factorize(found)
                hashes.append(unique)
                counts.append(np.bincount(codes, minlength=len(unique)))
                size += len(unique)
                if size > GATHERED:
                    hashes, counts = ([x] for x in merged(hashes, counts))
                    size = len(hashes[0])
                    if size > GATHERED // 2:
                        yield packed(slice_of(hashes[0], slices), hashes[0], counts[0])
                        hashes, counts, size = [], [], 0
        if hashes:
            h, c = merged(hashes, counts)
            yield packed(slice_of(h, slices), h, c)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashes, counts, size = None, [], [], 0
        for batch in batches:
            for number, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if number != now and now is not None:
                    yield row(now, *merged(hashes, counts))
                    hashes, counts, size = [], [], 0
                now = number
                hashes.append(np.frombuffer(a, np.uint64))
                counts.append(np.frombuffer(b, np.int64))
                size += len(hashes[-1])
                if len(hashes) > 64:
                    hashes, counts = ([x] for x in merged(hashes, counts))
        if now is not None:
            yield row(now, *merged(hashes, counts))

    def row(number: int, h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(h)
        columns = [pa.array([number], pa.int32()), *(pa.array([x[order].tobytes()], pa.binary()) for x in (h, c))]
        sums = [pa.array([int(x)], pa.int64()) for x in (c.sum(), len(c))]
        return pa.RecordBatch.from_arrays([*columns, *sums], ["slice", "words", "counts", "total", "types"])

    parts = docs.select("text").mapInArrow(count, "slice int, a binary, b binary")
    dealt = parts.repartition("slice").sortWithinPartitions("slice")
    return written(dealt.mapInArrow(add, "slice int, words binary, counts binary, total bigint, types bigint"))


@dataclass
class Clustered:
    """The clustered words, sorted by hash, with counts and classes. Two more classes: the end, and rare words."""

    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray

    @property
    def end(self) -> int:
        return CLASSES

    @property
    def rare(self) -> int:
        return CLASSES + 1

    @property
    def size(self) -> int:
        return CLASSES + 2

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for the end and -2 for rare words."""
        codes, unique = pd.factorize(hashes)
        at = np.minimum(np.searchsorted(self.words, unique), max(len(self.words) - 1, 0))
        there = self.words[at] == unique if len(self.words) else np.zeros(len(unique), bool)
        return np.where(unique == END, -1, np.where(there, at, -2))[codes]

    def class_of(self, numbers: np.ndarray) -> np.ndarray:
        return np.append(self.classes, [self.rare, self.end]).astype(np.int64)[numbers]


def frequent(words: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The words with at least ``least`` occurrences, at most 1 / SHARE of them, and their counts."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                h, c = np.frombuffer(a, np.uint64), np.frombuffer(b, np.int64)
                keep = (c >= least) & (h != END)
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(c[keep])], ["word", "n"])

    found = words.select("words", "counts").mapInArrow(pick, "word bigint, n bigint").toPandas()
    h = found["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], found["n"].to_numpy(np.int64)[order]


def first_classes(counts: np.ndarray) -> np.ndarray:
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    return (rank % CLASSES).astype(np.uint8)


def count_round(docs: DataFrame, model: Clustered, slices: int, vectors: bool) -> DataFrame:
    """``slice, a, b``: packed counts. Slice -1: the matrix of class pairs. Others: word numbers by (side, class)."""
    k, n = model.size, len(model.words)
    width = -(-max(n, 1) // slices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(k * k, np.int64)
        around = np.zeros(n * 2 * k if vectors else 0, np.uint32)
        for batch in batches:
            for _, _, hashes, _ in tokens(batch.column(0)):
                numbers = np.append(-1, model.find(hashes))
                classes = model.class_of(numbers)
                pairs += np.bincount(classes[:-1] * k + classes[1:], minlength=k * k)
                if vectors:
                    before, after = numbers[:-1], numbers[1:]
                    at = np.concatenate([before[before >= 0] * 2 * k + classes[1:][before >= 0], (after[after >= 0] * 2 + 1) * k + classes[:-1][after >= 0]])
                    at, times = np.unique(at, return_counts=True)
                    around[at] += times.astype(np.uint32)
        some = np.flatnonzero(around)
        if len(some):
            yield packed(some // (2 * k) // width, some, around[some].astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([b""]), pa.array([pairs.tobytes()])], ["slice", "a", "b"])

    return docs.select("text").mapInArrow(run, "slice int, a binary, b binary")


def pair_matrix(counted: DataFrame, k: int) -> np.ndarray:
    """The matrix of class pairs: tasks' matrices are added up in Spark, entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total += np.frombuffer(data, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total)], ["entry", "n"])

    parts = counted.filter("slice < 0").select("b").mapInArrow(run, "entry bigint, n bigint")
    out = np.zeros(k * k, np.int64)
    for row in parts.groupBy("entry").agg(F.sum("n").alias("n")).collect():  # k * k rows
        out[row["entry"]] = row["n"]
    return out.reshape(k, k)


def information(pairs: np.ndarray) -> float:
    """Mutual information of neighbouring classes, times the number of tokens."""
    expected = np.outer(pairs.sum(1), pairs.sum(0)) / max(pairs.sum(), 1)
    some = pairs > 0
    return float((pairs[some] * np.log(pairs[some] / expected[some])).sum())


def exchange(counted: DataFrame, pairs: np.ndarray, model: Clustered, slices: int, turn: int) -> np.ndarray:
    """Each word's best class, given all others' classes."""
    k, n = model.size, len(model.words)
    width = -(-max(n, 1) // slices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for number, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if number != now:
                    if now is not None:
                        yield moved(now, total)
                    now, total = number, np.zeros(min(width, n - number * width) * 2 * k)
                total[np.frombuffer(a, np.int64) - number * width * 2 * k] += np.frombuffer(b, np.int64)
        if now is not None:
            yield moved(now, total)

    def moved(number: int, total: np.ndarray) -> pa.RecordBatch:
        after, before = total.reshape(-1, 2, k).transpose(1, 0, 2)  # classes after the word, and before it
        at = number * width + np.arange(len(after))
        own = model.classes[at].astype(np.int64)
        rows, columns = pairs.sum(1).astype(float), pairs.sum(0).astype(float)
        log_rows = np.log(pairs + 0.1) - np.log(rows + 0.1 * k)[:, None]
        log_columns = np.log(pairs.T + 0.1) - np.log(columns + 0.1 * k)[:, None]
        gain = (after @ log_rows.T + before @ log_columns.T)[:, :CLASSES]
        # in its own class, a word is judged by what is there without it
        rest_rows = np.maximum(pairs[own] - after, 0) + 0.1
        rest_columns = np.maximum(pairs.T[own] - before, 0) + 0.1
        here = (after * (np.log(rest_rows) - np.log(rest_rows.sum(1))[:, None])).sum(1)
        here += (before * (np.log(rest_columns) - np.log(rest_columns.sum(1))[:, None])).sum(1)
        gain[np.arange(len(own)), own] = here
        best = np.where(model.words[at] >> np.uint64(17) & np.uint64(1) == turn % 2, gain.argmax(1), own)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(best)], ["number", "class"])

    dealt = counted.filter("slice >= 0").repartition("slice").sortWithinPartitions("slice")
    found = dealt.mapInArrow(run, "number bigint, class bigint").toPandas()  # at most one row per clustered word
    classes = model.classes.copy()
    classes[found["number"].to_numpy(np.int64)] = found["class"].to_numpy(np.int64)
    return classes


def cluster(docs: DataFrame, model: Clustered, slices: int, rounds: int) -> tuple[Clustered, np.ndarray]:
    """The best assignment found and its class pairs, counted over all of ``docs``."""
    best: tuple[float, Clustered, np.ndarray] | None = None
    for turn in range(rounds + 1):
        more = turn < rounds and len(model.words) > 0
        counted = written(count_round(docs, model, slices, more))
        pairs = pair_matrix(counted, model.size)
        found = information(pairs)
        if best is None or found > best[0]:
            best = found, model, pairs
        if not more:
            break
        model = Clustered(model.words, model.counts, exchange(counted, pairs, model, slices, turn))
    return best[1], best[2]


def score(docs: DataFrame, rounds: int = ROUNDS, share: float = SHARE) -> DataFrame:
    """``__key, doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of keyed documents."""
    text = F.col("text").cast("string").alias("text")
    docs = docs.select(KEY, "doc_id", text, held_out(F.col("doc_id")).alias("held_out"))
    train = docs.filter(~F.col("held_out")).select("text")
    slices = shuffle_partitions(docs.sparkSession)
    words = vocabulary(train, slices)
    sums = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    n_all, n_types = int(sums[0]), int(sums[1])
    names, counts = frequent(words, max(1, share * n_all))
    model, pairs = cluster(train, Clustered(names, counts, first_classes(counts)), slices, rounds)
    once = once_seen(words, model)
    return scored(docs, words, model, pairs, once, n_all, n_types, slices)


def once_seen(words: DataFrame, model: Clustered) -> int:
    """Rare words that occur once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = 0
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                h, c = np.frombuffer(a, np.uint64), np.frombuffer(b, np.int64)
                n += int(((c == 1) & (model.find(h) == -2)).sum())
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return int(words.select("words", "counts").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def scored(docs, words, model: Clustered, pairs: np.ndarray, once: int, n_all: int, n_types: int, slices: int) -> DataFrame:
    k = model.size
    ends = int(pairs[:, model.end].sum())
    n_rare = int(pairs[:, model.rare].sum())
    unseen = (once + 0.5) / (n_rare + 1) if n_rare else 1.0
    prior = (pairs.sum(0) + 1) / (pairs.sum() + k)
    move = np.log10((pairs + k * prior) / (pairs.sum(1)[:, None] + k))
    of_class = np.bincount(model.classes, model.counts, CLASSES)
    emit = np.log10(model.counts / of_class[model.classes]) if len(model.counts) else np.zeros(0)
    emit = np.append(emit, [0.0, 0.0])  # rare words are added later; the end is all of its class
    one_less = n_all + n_types + 1
    base = np.log10(np.append(model.counts, [one_less - 1, ends]) + 1.0) - np.log10(one_less)  # rare: 0 for now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, hashes, offsets in tokens(batch.column(1)):
                keys = batch.column(0).slice(low, high - low)
                numbers = model.find(hashes)
                classes = model.class_of(np.append(-1, numbers))
                total = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[offsets])
                rare = numbers == -2
                parts = [
                    np.diff(offsets), total(rare).astype(np.int64), total(base[numbers]),
                    total(move[classes[:-1], classes[1:]] + emit[numbers]),
                ]
                empty = pa.nulls(high - low, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.nulls(high - low, pa.int32()), empty, empty, keys, *map(pa.array, parts)], columns)
                if rare.any():
                    owner = np.repeat(keys.to_numpy(), np.diff(offsets))[rare]
                    rows = packed(slice_of(hashes[rare], slices), hashes[rare], owner)
                    none = [pa.nulls(rows.num_rows, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    yield pa.RecordBatch.from_arrays([*rows.columns, *none], columns)

    columns = ["slice", "a", "b", KEY, "n_tokens", "n_rare", "base", "model"]
    kinds = f"slice int, a binary, b binary, {KEY} bigint, n_tokens bigint, n_rare bigint, base double, model double"
    passed = written(docs.select(KEY, "text").mapInArrow(run, kinds))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, c = None, None, None
        found, size = [], 0
        for batch in batches:
            for number, kind, a, b in zip(*(x.to_pylist() for x in batch.columns)):
                if kind == 0:
                    now, h, c = number, np.frombuffer(a, np.uint64), np.frombuffer(b, np.int64)
                    continue
                asked, owner = np.frombuffer(a, np.uint64), np.frombuffer(b, np.int64)
                if number != now:  # a slice without training words
                    n = np.zeros(len(asked))
                else:
                    at = np.minimum(np.searchsorted(h, asked), len(h) - 1)
                    n = np.where(h[at] == asked, c[at], 0).astype(float)
                codes, keys = pd.factorize(owner)
                logs = np.log10(np.maximum(n, 1))
                found.append((keys, *(np.bincount(codes, x, len(keys)) for x in (n > 0, np.log10(n + 1), logs))))
                size += len(keys)
                if size > GATHERED // 4:
                    yield by_document(found)
                    found, size = [], 0
        if found:
            yield by_document(found)

    def by_document(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        keys, *sums = added(found)
        return packed(slice_of(mixed(keys.view(np.uint64)), slices), keys, *sums)

    def added(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        keys, *sums = (np.concatenate(x) for x in zip(*found))
        codes, unique = pd.factorize(keys)
        return unique, *(np.bincount(codes, x, len(unique)) for x in sums)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, []
        for batch in batches:
            for number, a, *sums in zip(*(x.to_pylist() for x in batch.columns)):
                if number != now and found:
                    yield per_document(added(found))
                    found = []
                now = number
                found.append((np.frombuffer(a, np.int64), *(np.frombuffer(x, np.float64) for x in sums)))
                if len(found) > 64:
                    found = [added(found)]
        if found:
            yield per_document(added(found))

    def per_document(sums: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        keys, known, plus, logs = sums
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(known.astype(np.int64)), pa.array(plus), pa.array(logs)], [KEY, "known", "plus", "logs"])

    asked = passed.filter("slice is not null").select("slice", F.lit(1).alias("kind"), "a", "b")
    held = words.select("slice", F.lit(0).alias("kind"), F.col("words").alias("a"), F.col("counts").alias("b"))
    dealt = held.unionByName(asked).repartition("slice").sortWithinPartitions("slice", "kind")
    # what a slice says about a document is sent on packed, to the slice of the document's key
    parts = dealt.mapInArrow(look_up, "slice int, a binary, b binary, c binary, d binary")
    rare = parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(add_up, f"{KEY} bigint, known bigint, plus double, logs double")

    whole = passed.filter("slice is null").select(KEY, "n_tokens", "n_rare", "base", "model").join(rare, KEY, "left")
    whole = whole.fillna({"known": 0, "plus": 0.0, "logs": 0.0}).join(docs.select(KEY, "doc_id", "held_out"), KEY)
    known_rare = np.log10((1 - unseen) / n_rare) if n_rare else 0.0
    if n_all == 0:
        ends_known = F.lit(0)
    else:
        ends_known = F.col("n_tokens") - F.col("n_rare")
    return whole.select(
        KEY,
        "doc_id",
        "held_out",
        "n_tokens",
        (ends_known + F.col("known")).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("plus") - F.col("n_rare") * float(np.log10(one_less))).alias("base_score"),
        (
            F.col("model") + F.col("logs") + F.col("known") * float(known_rare)
            + (F.col("n_rare") - F.col("known")) * float(np.log10(unseen))
        ).alias("score"),
    )


def op1_brown_classes(spark: SparkSession, folder: str) -> DataFrame:
    return score(keyed(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))).drop(KEY)
