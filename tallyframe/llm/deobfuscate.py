"""Toxicity behind obfuscation: a noisy channel restores texts, then they are scored.

The channel writes letters as look-alike digits and symbols, puts spaces and symbols between them and repeats them. A
token that shows such noise becomes a lattice of what its characters may have been; Viterbi decoding finds the reading
that channel and a character trigram model make likeliest. The model is counted over all documents, labels unseen. Runs
of three or more words of one character are one token. All other tokens stay as they are, in lower case.

Restored texts are scored by logistic regression over hashed character runs of their words and whole words, each as the
log of its share. Runs are chosen and weights fitted on at most ``SAMPLE`` labelled documents, taken by hash.

Defined cases: null and empty texts, and texts without words, get the score of a text without features. Without labels
of both kinds every score is the smoothed share of toxic labels. A document with several labels is toxic if one says
so; labels without an id or value say nothing. Rows that repeat a doc_id share its labels and are scored each; null ids
are in no fold and have no labels. No documents give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import KEY, LOWER, SPACE, byte_class, kept, keyed, mixed, spans, text_blocks, word_hashes, written
from tallyframe.session import ship

ship(__name__)

SYMBOLS = 64  # of the character model: 0 between words, 1 to 26 letters, 27 other ASCII, the rest longer characters' bytes
OTHER = 27
SYMBOL_OF = np.full(256, OTHER, np.int64)
SYMBOL_OF[SPACE] = 0
SYMBOL_OF[ord("a") : ord("z") + 1] = np.arange(1, 27)
SYMBOL_OF[128:] = 28 + np.arange(128) % 36
LETTER = byte_class([(0x61, 0x7A), (0x80, 0xFF)])
# Punctuation that may stand around a word without being noise.
EDGE = byte_class([(ord(c), ord(c)) for c in ".,;:!?\"'()[]{}-"])
# What a digit or symbol may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c"}
# Log costs in the channel: a look-alike, a symbol put in, a digit put in, a true space inside a spaced token (one
# space; two or more are likely true), several spaces put in, a letter written twice.
LOOK_ALIKE, PUT_IN, DIGIT_IN, TRUE_SPACE, SPACES_IN, TWICE = -1.5, -2.0, -6.0, -2.0, -1.0, -4.0
SINGLES = 3  # words of one character that make a spaced token
INTERPOLATION = 0.8, 0.15, 0.05  # trigram, bigram, single
REMEMBERED = 300_000  # restored tokens a process remembers before it starts over

RUNS = (4, 5, 6)  # bytes in a run, with one space on either side of a word
BITS = 20
FEATURES = 2048
LEAST_RATIO = 4.0  # log likelihood ratio below which a run says nothing
SAMPLE = 20_000
ROUNDS, RATE, RIDGE = 200, 0.05, 1e-4
FOLDS = 5


# -- the character model -----------------------------------------------------------------------------------------


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of three symbols in a row over all texts, with two spaces before and after each."""
    cells = SYMBOLS**3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                # each text ends in a space and gets one before it
                s = np.concatenate([[0], np.insert(SYMBOL_OF[LOWER[data]], offsets[:-1], 0), [0]])
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=cells)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    out = np.zeros(cells, np.int64)
    sums = docs.select("text").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    for row in sums.collect():  # at most SYMBOLS ** 3 rows
        out[row["cell"]] = row["n"]
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of a symbol after two others."""
    three, two, one = INTERPOLATION
    pairs = counts.sum(0)
    single = (pairs.sum(0) + 1) / (pairs.sum() + SYMBOLS)
    follow = pairs / np.maximum(pairs.sum(1, keepdims=True), 1)
    after = counts / np.maximum(counts.sum(2, keepdims=True), 1)
    return np.log(three * after + two * follow[None] + one * single[None, None]).astype(np.float32)


def readings(token: bytes) -> list[list[tuple[bytes, float]]]:
    """The lattice: for each run of one character what it may have been, with the channel's log cost."""
    out, at = [], 0
    while at < len(token):
        byte, end = token[at], at
        while end < len(token) and token[end] == byte:
            end += 1
        run, one = token[at:end], token[at : at + 1]
        if SPACE[byte]:
            choices = [(b" ", TRUE_SPACE), (b"", 0.0)] if end - at == 1 else [(b" ", 0.0), (b"", SPACES_IN)]
        elif LETTER[byte]:
            if byte > 127 or len(run) == 1:
                choices = [(run, 0.0)]
            elif len(run) == 2:
                choices = [(run, 0.0), (one, TWICE)]
            else:
                choices = [(one, 0.0), (one * 2, 0.0)]
        else:
            choices = [(run, 0.0), (b"", DIGIT_IN if one.isdigit() else PUT_IN)]
            for letter in LEET.get(chr(byte), "").encode():
                choices.append((bytes([letter]), LOOK_ALIKE))
                if len(run) > 1:
                    choices.append((bytes([letter] * 2), LOOK_ALIKE))
        out.append(choices)
        at = end
    return out


def decode(token: bytes, model: list) -> bytes:
    """The likeliest reading of a token between two spaces; of equal ones the first in the lattice's order."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for choices in [*readings(token), [(b" ", 0.0)]]:
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, before) in states.items():
            for text, cost in choices:
                x, y, total = a, b, score + cost
                for symbol in SYMBOL_OF[list(text)].tolist():
                    total += model[x][y][symbol]
                    x, y = y, symbol
                held = new.get((x, y))
                if held is None or total > held[0]:
                    new[x, y] = total, (before, text)
        states = new
    _, back = max(states.values(), key=lambda s: s[0])
    parts = []
    while back is not None:
        back, text = back
        parts.append(text)
    return b"".join(reversed(parts[1:]))


class Reader:
    """Decodes tokens by one character model and remembers what it read."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.read: dict[bytes, bytes] = {}

    def __call__(self, token: bytes) -> bytes:
        if token not in self.read:
            if len(self.read) > REMEMBERED:
                self.read.clear()
            self.read[token] = decode(token, self.model)
        return self.read[token]


def model_name(model: np.ndarray) -> str:
    return f"reader {hashlib.sha256(model.tobytes()).hexdigest()}"


# -- texts as restored tokens ------------------------------------------------------------------------------------


@dataclass
class Tokens:
    """A block's distinct tokens (restored bytes) and, per occurrence, its document, token and place in the block."""

    texts: list[bytes]
    doc: np.ndarray
    code: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    noisy: np.ndarray  # per distinct token


def tokens(data: np.ndarray, offsets: np.ndarray, reader: Reader) -> Tokens:
    data = LOWER[data]
    starts, ends, first = spans(data, offsets, SPACE)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    solid = np.flatnonzero(~(EDGE[data] | SPACE[data]))  # words without the punctuation around them
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = low < high
    starts, ends, doc = solid[low[some]], solid[high[some] - 1] + 1, doc[some]
    if len(starts):  # runs of words of one character
        single = ends - starts == 1
        turn = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
        for a, b in zip(turn[::2].tolist(), turn[1::2].tolist()):
            parts = np.flatnonzero(np.diff(doc[a:b])) + a + 1  # runs stay inside a document
            for x, y in zip([a, *parts.tolist()], [*parts.tolist(), b]):
                if y - x >= SINGLES:
                    ends[x] = ends[y - 1]
                    starts[x + 1 : y] = -1
        keep = starts >= 0
        starts, ends, doc = starts[keep], ends[keep], doc[keep]
    code, hashes = pd.factorize(word_hashes(data, starts, ends))
    where = np.zeros(len(hashes), np.int64)
    where[code[::-1]] = np.arange(len(code))[::-1]
    noise = np.concatenate([[0], np.cumsum(~LETTER[data])])
    again = np.zeros(len(data) + 1, np.int64)  # a third equal letter in a row
    if len(data) > 2:
        again[3:] = np.cumsum((data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & (data[2:] < 128) & LETTER[data[2:]])
    s, e = starts[where], ends[where]
    noisy = (noise[e] > noise[s]) | ((e - s > 2) & (again[e] > again[np.minimum(s + 2, e)]))
    texts = []
    for a, b, bad in zip(s.tolist(), e.tolist(), noisy.tolist()):
        text = data[a:b].tobytes()
        texts.append(reader(text) if bad else text)
    return Tokens(texts, doc, code, starts, ends, noisy)


def token_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the distinct tokens, and for each bucket the token it is of."""
    data = np.frombuffer(b" " + b"  ".join(texts) + b" ", np.uint8)
    sizes = np.array([len(t) + 2 for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    blank = data == 0x20
    inner = np.concatenate([[0], np.cumsum(blank)])
    buckets, owners = [], []
    for n in RUNS:
        size = len(data) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n, np.uint64)
        for i in range(n):
            h = h << np.uint64(8) | data[i : i + size]
        good = np.flatnonzero((inner[n - 1 : n - 1 + size] == inner[1 : 1 + size]) & ~(blank[:size] & blank[1 : size + 1]))
        buckets.append(mixed(h[good]) >> np.uint64(64 - BITS))
        owners.append(owner[good])
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))  # words in restored tokens
    starts, ends = edges[::2], edges[1::2]
    buckets.append(mixed(word_hashes(data, starts, ends)) >> np.uint64(64 - BITS))
    owners.append(owner[starts])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def document_features(found: Tokens, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, count), sorted. With ``wanted``, a table from buckets to features, others (-1) are left out."""
    none = np.zeros(0, np.int64)
    if not found.texts:
        return none, none, none
    buckets, owners = token_features(found.texts)
    if wanted is not None:
        buckets = wanted[buckets]
        owners, buckets = owners[buckets >= 0], buckets[buckets >= 0]
    order = np.argsort(owners, kind="stable")
    buckets, owners = buckets[order], owners[order]
    first = np.searchsorted(owners, np.arange(len(found.texts) + 1))
    held, often = np.unique(found.doc * len(found.texts) + found.code, return_counts=True)
    doc, code = np.divmod(held, len(found.texts))
    n = first[code + 1] - first[code]
    at = np.arange(n.sum()) + np.repeat(first[code] - (np.cumsum(n) - n), n)
    both, where = np.unique(np.repeat(doc, n) << BITS | buckets[at], return_inverse=True)
    counts = np.bincount(where, weights=np.repeat(often, n), minlength=len(both)).astype(np.int64)
    return both >> BITS, both & (1 << BITS) - 1, counts


def share(counts: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """What the regression sees of a feature: the log of its occurrences in a text brought to a common length."""
    return np.log1p(counts * (300.0 / (n_words + 100.0)))


# -- fitting and scoring -----------------------------------------------------------------------------------------


def toxic_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, toxic``: one row per labelled document."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


@dataclass
class Scorer:
    wanted: np.ndarray  # bucket -> feature or -1
    weights: np.ndarray
    bias: float


def sample_features(docs: DataFrame, sample: DataFrame, model: np.ndarray) -> DataFrame:
    """``toxic, n_words, buckets, counts`` of the sampled documents, packed."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), model_name(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = kept(name, lambda: Reader(shared.value))
        for batch in batches:
            for low, high, data, offsets in text_blocks(batch.column(0)):
                found = tokens(data, offsets, reader)
                doc, bucket, count = document_features(found)
                ends = np.searchsorted(doc, np.arange(high - low + 1)).astype(np.int32) * 4
                n_words = np.bincount(found.doc, minlength=high - low)
                columns = [batch.column(1).slice(low, high - low), pa.array(n_words.astype(np.int64))]
                for values in (bucket, count):
                    packed = pa.py_buffer(values.astype(np.int32))
                    columns.append(pa.BinaryArray.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(ends), packed]))
                yield pa.RecordBatch.from_arrays(columns, ["toxic", "n_words", "buckets", "counts"])

    chosen = docs.join(F.broadcast(sample), "doc_id").select("text", "toxic")  # at most SAMPLE ids
    return chosen.mapInArrow(run, "toxic boolean, n_words bigint, buckets binary, counts binary")


def chosen_buckets(rows: DataFrame, toxic: int, clean: int, size: int) -> np.ndarray:
    """The buckets whose presence says most about the label, by the log likelihood ratio of both shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for label, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[int(label), np.frombuffer(data.as_buffer(), np.int32)] += 1
        some = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[1, some]), pa.array(total[0, some])], ["bucket", "t", "c"])

    counts = rows.select("toxic", "buckets").mapInArrow(run, "bucket bigint, t bigint, c bigint").groupBy("bucket")
    counts = counts.agg(F.sum("t").alias("t"), F.sum("c").alias("c"))

    def part(k: Column, n: Column | int) -> Column:
        n = F.lit(float(n)) if isinstance(n, int) else n
        return F.when((k > 0) & (k < n), k * F.log(k / n) + (n - k) * F.log((n - k) / n)).otherwise(0.0)

    both = part(F.col("t"), toxic) + part(F.col("c"), clean) - part(F.col("t") + F.col("c"), toxic + clean)
    best = counts.withColumn("ratio", F.round(both, 6)).filter(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "bucket").limit(size)
    return np.array([r["bucket"] for r in best.select("bucket").collect()], np.int64)


def fit(docs: DataFrame, training: DataFrame, model: np.ndarray, sample: int = SAMPLE, features: int = FEATURES) -> Scorer:
    """Logistic regression on at most ``sample`` documents of ``training`` (doc_id, toxic), by Adam with a ridge."""
    taken = written(training.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    wanted = np.full(1 << BITS, -1, np.int64)
    rows = written(sample_features(docs, taken, model))
    toxic, n = rows.agg(F.coalesce(F.count_if("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    if not 0 < toxic < n:
        prior = (toxic + 1.0) / (n + 2.0)
        return Scorer(wanted, np.zeros(0), float(np.log(prior / (1 - prior))))
    buckets = chosen_buckets(rows, toxic, n - toxic, features)
    wanted[buckets] = np.arange(len(buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, value = [], []
            for n_words, b, c in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                which = wanted[np.frombuffer(b.as_buffer(), np.int32)]
                at.append(which[which >= 0].astype(np.int32).tobytes())
                value.append(share(np.frombuffer(c.as_buffer(), np.int32)[which >= 0], n_words).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.binary()), pa.array(value, pa.binary())], ["toxic", "at", "value"])

    got = rows.mapInArrow(run, "toxic boolean, at binary, value binary").collect()  # at most ``sample`` rows
    got.sort(key=lambda r: (r["toxic"], r["at"], r["value"]))
    y = np.array([r["toxic"] for r in got], float)
    at = np.frombuffer(b"".join(r["at"] for r in got), np.int32)
    value = np.frombuffer(b"".join(r["value"] for r in got), np.float32).astype(float)
    row = np.repeat(np.arange(len(got)), [len(r["at"]) // 4 for r in got])
    w, bias = np.zeros(len(buckets)), float(np.log(toxic / (n - toxic)))
    first, second = np.zeros(len(buckets) + 1), np.zeros(len(buckets) + 1)
    for step in range(1, ROUNDS + 1):
        z = bias + np.bincount(row, weights=w[at] * value, minlength=len(y))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        slope = np.append(np.bincount(at, weights=error[row] * value, minlength=len(w)) + RIDGE * w, error.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Scorer(wanted, w, float(bias))


def scores(docs: DataFrame, model: np.ndarray, scorer: Scorer) -> DataFrame:
    """``__key, doc_id, score, n_words, n_restored``: the last counts words that were noisy and read as something else."""
    shared, name = docs.sparkSession.sparkContext.broadcast((model, scorer)), model_name(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, scorer = shared.value
        reader = kept(name, lambda: Reader(model))
        for batch in batches:
            for low, high, data, offsets in text_blocks(batch.column(2)):
                found = tokens(data, offsets, reader)
                n_words = np.bincount(found.doc, minlength=high - low)
                doc, at, count = document_features(found, scorer.wanted)
                value = scorer.weights[at] * share(count, n_words[doc]) if len(at) else np.zeros(0)
                z = scorer.bias + np.bincount(doc, weights=value, minlength=high - low)
                score = np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 9)
                changed = np.array([n and LOWER[data[a:b]].tobytes() != t for n, a, b, t in first_places(found)], bool)
                restored = np.bincount(found.doc[changed[found.code]], minlength=high - low) if len(found.code) else n_words
                rows = batch.slice(low, high - low)
                columns = [rows.column(0), rows.column(1), pa.array(score), pa.array(n_words.astype(np.int64)), pa.array(restored.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, [KEY, "doc_id", "score", "n_words", "n_restored"])

    chosen = docs.select(KEY, "doc_id", "text")
    return chosen.mapInArrow(run, f"{KEY} bigint, doc_id bigint, score double, n_words bigint, n_restored bigint")


def first_places(found: Tokens) -> Iterator[tuple]:
    where = np.zeros(len(found.texts), np.int64)
    where[found.code[::-1]] = np.arange(len(found.code))[::-1]
    return zip(found.noisy.tolist(), found.starts[where].tolist(), found.ends[where].tolist(), found.texts)


def restore(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """``__key, doc_id, restored``: texts with noisy tokens read anew, all in lower case where A-Z; null stays null."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), model_name(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = kept(name, lambda: Reader(shared.value))
        for batch in batches:
            for low, high, data, offsets in text_blocks(batch.column(2)):
                found = tokens(data, offsets, reader)
                text = LOWER[data].tobytes()
                out, at = [], 0
                place = np.searchsorted(found.starts, offsets).tolist()
                for d in range(high - low):
                    parts, at = [], int(offsets[d])
                    for j in range(place[d], place[d + 1]):
                        if found.noisy[found.code[j]]:
                            parts += [text[at : found.starts[j]], found.texts[found.code[j]]]
                            at = int(found.ends[j])
                    parts.append(text[at : int(offsets[d + 1]) - 1])
                    out.append(b"".join(parts).decode(errors="replace"))
                rows = batch.slice(low, high - low)
                gone = rows.column(2).is_null().to_numpy(zero_copy_only=False)
                values = pa.array([None if g else t for g, t in zip(gone, out)], pa.string())
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), values], [KEY, "doc_id", "restored"])

    return bare(docs).mapInArrow(run, f"{KEY} bigint, doc_id bigint, restored string")


def bare(docs: DataFrame) -> DataFrame:
    return docs.select(KEY, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> DataFrame:
    """``__key, doc_id, held_out, score, predicted, n_words, n_restored`` of keyed documents; held-out labels unseen."""
    docs = bare(docs)
    model = log_model(trigram_counts(docs))
    training = toxic_labels(labels).filter(~held_out(F.col("doc_id")))
    found = scores(docs, model, fit(docs, training, model, sample, features))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return found.select(KEY, "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted, "n_words", "n_restored")


def op11_noisy_channel(spark: SparkSession, folder: str) -> DataFrame:
    docs = keyed(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    return toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet")).drop(KEY)
