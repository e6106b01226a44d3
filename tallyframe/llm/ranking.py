"""Ranked lexical search by the Best Position Algorithm over impact-ordered lists.

Documents are read once: a task keeps, of each document, its number of terms and its occurrences of the terms asked for.
From these Spark counts the documents, terms and document frequencies. Then each task builds shards of bounded size: for
every term asked for, a list of the shard's documents by falling impact. A query reads its lists side by side; each
document it meets is scored at once by direct accesses to all lists, which also mark its places there as seen. A list's
best position is the end of its unbroken run of seen places, and the sum of the impacts there bounds what an unseen
document can reach. A query stops when that bound is strictly below its k-th score, so documents that tie with the k-th
are never missed. k-th scores are carried from shard to shard inside a task, and Spark merges the tasks' best k.

Terms are told apart by 64-bit hashes. Items are searched in blocks of at most ``TERMS`` term occurrences (an item
beyond that is a block of its own), which is what goes to every task.

Defined cases: null and empty texts, and texts without terms, count nowhere and are never found; an item without terms,
or none of whose terms occur, gives no rows. Equal scores go to the smaller document key. Rows that repeat a doc_id, or
have none, are documents of their own (null ids last); repeated items are items of their own, each with all its ranks.
No documents or no items give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import KEY, LOWER, NON_WORD, keyed, spans, text_blocks, word_hashes, written
from tallyframe.session import ship

ship(__name__)

BEST = 20
TERMS = 2_000_000  # term occurrences of the items searched together
SHARD = 2_000_000  # postings of one shard
FIRST_DEPTH = 16  # places read from each list before the bound is looked at; doubled each time


def term_hashes(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes of the terms, first term of each row): only A-Z are lower-cased."""
    for low, high, data, offsets in text_blocks(texts):
        data = LOWER[data]
        starts, ends, first = spans(data, offsets, NON_WORD)
        yield low, high, word_hashes(data, starts, ends), first


@dataclass
class Queries:
    """Items of a block: for each its distinct terms (as places in ``terms``) and how often it has them."""

    items: np.ndarray
    terms: np.ndarray
    codes: list[np.ndarray]
    often: list[np.ndarray]


def query_terms(items: DataFrame) -> DataFrame:
    """``__key, item_id, n, terms``: the hashes of each item's terms, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, hashes, first in term_hashes(batch.column(2)):
                rows = batch.slice(low, high - low)
                packed = pa.array([hashes[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())], pa.binary())
                columns = [rows.column(0), rows.column(1), pa.array(np.diff(first).astype(np.int64)), packed]
                yield pa.RecordBatch.from_arrays(columns, [KEY, "item_id", "n", "terms"])

    chosen = items.select(KEY, F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, f"{KEY} bigint, item_id bigint, n bigint, terms binary")


def block_queries(rows: list) -> Queries:
    flat = [np.frombuffer(r["terms"], np.uint64) for r in rows]
    terms = np.unique(np.concatenate(flat)) if flat else np.zeros(0, np.uint64)
    pairs = [np.unique(np.searchsorted(terms, one), return_counts=True) for one in flat]
    return Queries(np.array([r[KEY] for r in rows], np.int64), terms, [p[0] for p in pairs], [p[1] for p in pairs])


def postings(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """``__key, doc_id, n, codes, tf`` per document with a term: all its terms counted, those in ``terms`` listed."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        size = max(1, len(wanted))
        for batch in batches:
            for low, high, hashes, first in term_hashes(batch.column(2)):
                count = np.diff(first)
                doc = np.repeat(np.arange(high - low), count)
                at = np.searchsorted(wanted, hashes)
                hit = at < len(wanted)
                hit[hit] = wanted[at[hit]] == hashes[hit]
                both, tf = np.unique(doc[hit] * size + at[hit], return_counts=True)
                ends = np.searchsorted(both, np.arange(high - low + 1) * size).astype(np.int32) * 4
                codes, tf = (both % size).astype(np.int32), tf.astype(np.int32)
                rows = batch.slice(low, high - low)
                columns = [rows.column(0), rows.column(1), pa.array(count.astype(np.int64))]
                for values in (codes, tf):
                    columns.append(pa.BinaryArray.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(ends), pa.py_buffer(values)]))
                out = pa.RecordBatch.from_arrays(columns, [KEY, "doc_id", "n", "codes", "tf"])
                yield out.filter(pa.array(count > 0))

    chosen = docs.select(KEY, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, f"{KEY} bigint, doc_id bigint, n bigint, codes binary, tf binary")


def frequencies(held: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for data in batch.column(0):
                total[np.frombuffer(data.as_buffer(), np.int32)] += 1  # a document lists a term once
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["code", "df"])

    out = np.zeros(size, np.int64)
    sums = held.select("codes").mapInArrow(run, "code bigint, df bigint").groupBy("code").agg(F.sum("df").alias("df"))
    for row in sums.collect():  # at most ``TERMS`` rows
        out[row["code"]] = row["df"]
    return out


class Shard:
    """Impact-ordered lists of some documents, and each document's places in them."""

    def __init__(self, docs: np.ndarray, codes: np.ndarray, impact: np.ndarray, n_docs: int, size: int):
        # postings come document by document, codes ascending
        order = np.lexsort((docs, -impact, codes))
        self.docs, self.impact = docs[order], impact[order]
        self.begin = np.searchsorted(codes[order], np.arange(size + 1))
        self.codes = codes
        self.place = np.empty(len(codes), np.int64)  # of each posting in its list
        self.place[order] = np.arange(len(codes)) - self.begin[codes[order]]
        self.row = np.searchsorted(docs, np.arange(n_docs + 1))
        self.value = impact
        self.met = np.zeros(n_docs, np.int64)  # the last query that met a document
        self.turn = 0
        self.which = np.full(size, -1, np.int64)

    def best(self, terms: np.ndarray, weights: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of this shard that may be among the best k, ``least`` being the k-th score so far."""
        begin = self.begin[terms]
        length = self.begin[terms + 1] - begin
        some = length > 0
        terms, weights, begin, length = terms[some], weights[some], begin[some], length[some]
        none = np.zeros(0, np.int64)
        if not len(terms):
            return none, none
        self.turn += 1
        self.which[terms] = np.arange(len(terms))
        base = np.cumsum(length) - length
        seen = np.zeros(length.sum(), bool)
        position = np.zeros(len(terms), np.int64)  # best positions
        found, scores, kth = [none], [none], max(least, 1)
        read, depth = np.zeros(len(terms), np.int64), FIRST_DEPTH
        while True:
            upto = np.minimum(length, read + depth)
            reach = upto - read
            at = np.arange(reach.sum()) + np.repeat(begin + read - (np.cumsum(reach) - reach), reach)
            docs = self.docs[at]
            docs = np.unique(docs[self.met[docs] != self.turn])
            if len(docs):
                self.met[docs] = self.turn
                n = self.row[docs + 1] - self.row[docs]
                at = np.arange(n.sum()) + np.repeat(self.row[docs] - (np.cumsum(n) - n), n)
                lists = self.which[self.codes[at]]
                inside = lists >= 0
                at, lists = at[inside], lists[inside]
                of = np.repeat(np.arange(len(docs)), n)[inside]
                total = np.zeros(len(docs), np.int64)
                np.add.at(total, of, weights[lists] * self.value[at])
                seen[base[lists] + self.place[at]] = True
                good = total >= kth
                found.append(docs[good])
                scores.append(total[good])
                every = np.concatenate(scores)
                if len(every) >= k:
                    kth = max(kth, int(np.partition(every, len(every) - k)[len(every) - k]))
            read, depth = upto, depth * 2
            for i, (a, p, m, r) in enumerate(zip(base.tolist(), position.tolist(), length.tolist(), read.tolist())):
                p = max(p, r)  # what was read was seen
                while p < m:
                    run = seen[a + p : a + min(m, p + 4096)]
                    gap = int(run.argmin())
                    if not run[gap]:
                        p += gap
                        break
                    p += len(run)
                position[i] = p
            open_ = position < length
            bound = int((weights * self.impact[begin + position - 1])[open_].sum())
            if not open_.any() or bound < kth:
                break
        self.which[terms] = -1
        return np.concatenate(found), np.concatenate(scores)


def best_of_tasks(held: DataFrame, queries: Queries, df: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``item, __key, doc_id, score``: the best k of each task, by ``Shard``."""
    weight = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)
    shared = held.sparkSession.sparkContext.broadcast((queries, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = shared.value
        weights = [weight[c] * o for c, o in zip(asked.codes, asked.often)]
        none = np.zeros(0, np.int64)
        top = [(none, none, none)] * len(asked.items)  # keys, ids, scores
        for keys, ids, docs, codes, impact in shards(batches, n_docs, n_terms):
            shard = Shard(docs, codes, impact, len(keys), len(weight))
            for i, (terms, w) in enumerate(zip(asked.codes, weights)):
                least = int(top[i][2][k - 1]) if len(top[i][2]) >= k else 0
                found, scores = shard.best(terms, w, least, k)
                if len(found):
                    new = [np.concatenate(x) for x in zip(top[i], (keys[found], ids[found], scores))]
                    order = np.lexsort((new[0], -new[2]))[:k]
                    top[i] = tuple(x[order] for x in new)
        sizes = [len(t[0]) for t in top]
        columns = [np.repeat(asked.items, sizes), *[np.concatenate([t[j] for t in top]) if top else none for j in range(3)]]
        missing = columns[2] == MISSING
        arrays = [pa.array(c) for c in columns[:2]] + [pa.array(columns[2], mask=missing), pa.array(columns[3])]
        yield pa.RecordBatch.from_arrays(arrays, ["item", KEY, "doc_id", "score"])

    return held.mapInArrow(run, f"item bigint, {KEY} bigint, doc_id bigint, score bigint")


MISSING = -(1 << 63)


def shards(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Keys and ids of documents, and their postings as (document, code, impact), at most ``SHARD`` at a time."""
    parts: list[tuple[np.ndarray, ...]] = []
    docs = size = 0
    for batch in batches:
        lengths = np.array([len(x.as_buffer()) // 4 for x in batch.column(3)], np.int64)
        ends, low = np.cumsum(lengths), 0
        while low < len(lengths):
            room = (ends[low - 1] if low else 0) + SHARD - size
            high = max(low + (not parts), int(np.searchsorted(ends, room, side="right")))
            if high > low:
                rows = batch.slice(low, high - low)
                codes, tf = (flat_ints(rows.column(j)) for j in (3, 4))
                m = 75 + (25 * rows.column(2).to_numpy() * n_docs) // n_terms
                of = np.repeat(np.arange(high - low), lengths[low:high])
                impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[of])
                ids = rows.column(1).fill_null(MISSING).to_numpy(zero_copy_only=False)
                parts.append((rows.column(0).to_numpy(), ids, of + docs, codes, impact))
                docs, size, low = docs + high - low, size + len(codes), high
            if low < len(lengths):
                yield joined(parts)
                parts, docs, size = [], 0, 0
    if parts:
        yield joined(parts)


def joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*parts))


def flat_ints(column: pa.Array) -> np.ndarray:
    """All 32-bit integers of a binary column, as 64-bit ones."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.int32)[ends[0] // 4 : ends[-1] // 4].astype(np.int64)


def search(docs: DataFrame, items: DataFrame, k: int = BEST, terms: int = TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score, __item, __key``: the k best of keyed ``docs`` for each of keyed ``items``."""
    spark = docs.sparkSession
    asked = written(query_terms(items).filter("n > 0"))
    total = asked.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, math.ceil(2 * total / terms))
    results = []
    for block in range(blocks):
        # dealt by hash, and again by size should a block be too large all the same
        rows = asked.filter(F.pmod(F.xxhash64(KEY), F.lit(blocks)) == block).select(KEY, "n", "terms").orderBy(KEY)
        group: list = []
        size = 0
        for row in rows.toLocalIterator():
            if group and size + row["n"] > terms:
                results.append(searched(docs, block_queries(group), k))
                group, size = [], 0
            group.append(row)
            size += row["n"]
        if group:
            results.append(searched(docs, block_queries(group), k))
    if not results:
        return spark.createDataFrame([], f"item_id bigint, rank int, doc_id bigint, score bigint, __item bigint, {KEY} bigint")
    tops = results[0]
    for more in results[1:]:
        tops = tops.unionByName(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), KEY)
    ranked = tops.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = asked.select(F.col(KEY).alias("item"), "item_id")
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score", F.col("item").alias("__item"), KEY)


def searched(docs: DataFrame, queries: Queries, k: int) -> DataFrame:
    held = written(postings(docs, queries.terms))
    n_docs, n_terms = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return written(best_of_tasks(held, queries, frequencies(held, len(queries.terms)), n_docs, n_terms, k))


def op13_best_position(spark: SparkSession, folder: str) -> DataFrame:
    docs = keyed(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    items = keyed(spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text"), "item_id")
    return search(docs, items).select("item_id", "rank", "doc_id", "score")


OP13_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents WHERE text IS NOT NULL
), n AS (SELECT doc_id, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0),
t AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS all_terms FROM n),
m AS (SELECT doc_id, 75 + ((25 * n * docs) // all_terms) AS m FROM n, t),
q AS (
    SELECT item_id, term, CAST(count(*) AS BIGINT) AS often FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL)
    GROUP BY ALL
), p AS (
    SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d)
    WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
    SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM p GROUP BY term), t
), s AS (
    SELECT item_id, doc_id, CAST(sum(often * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
    FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL
)
SELECT item_id, rank, doc_id, score FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0
) WHERE rank <= 20
"""
