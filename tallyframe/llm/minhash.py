"""Near duplicates by MinHash bands and sequential Bayesian verification.

1. Each document's distinct word shingles, as sorted 64-bit hashes, give a signature; documents with equal sets are one
   class, and only its first document goes on.
2. Bands of the signature put documents in buckets. Two documents of similarity ``threshold`` share none with
   probability (1 - threshold^rows)^bands, 3e-6 by default.
3. Within a bucket not all pairs are formed. A hub is compared with every member, and what is similar joins its
   component. Buckets that still hold several components are compared block by block, members of different components
   only; buckets with the same members are one. A block carries full sets, so a survivor is confirmed where it is
   found, and once two components are linked in a block their members are not compared there again: a block gives
   fewer links than it holds components. No link between components is lost.
4. A pair is compared 16 hashes at a time and given up once the posterior probability that its similarity reaches the
   threshold is below ``miss``. Survivors are confirmed on their full sets.

Defined cases: documents without words (null, empty) have empty sets and are linked with nothing; fewer words than a
shingle make one shingle of all; repeated rows and null ids are documents of their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import FACTOR, KEY, LOWER, SPACE, keyed, mixed, shingle_hashes, spans, text_blocks, word_hashes, written
from tallyframe.llm.components import components
from tallyframe.session import ship

ship(__name__)

STEP = 16  # hashes compared before the next look at the posterior
SIDE = 2048  # members of a bucket on one side of a block
HELD = 64 << 20  # bytes of full sets on one side of a block


@dataclass(frozen=True)
class NearDuplicates:
    """Parameters. percent: the least similarity that links. miss: chance taken at each look to lose a similar pair."""

    shingle: int = 5
    percent: int = 80
    rows: int = 4
    bands: int = 24
    miss: float = 1e-6

    @property
    def hashes(self) -> int:
        return self.rows * self.bands

    def needed(self) -> list[tuple[int, int]]:
        """(hashes seen, fewest matches to go on): with a uniform prior, P(J >= t | m of n) = P(Binomial(n+1, t) <= m)."""
        t, out = self.percent / 100, []
        for n in range(STEP, self.hashes + 1, STEP):
            total, m = 0.0, 0
            while True:
                total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
                if total >= self.miss:
                    break
                m += 1
            out.append((n, m))
        return out


def shingle_sets(column: pa.Array, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sorted distinct shingle hashes of each document in turn, offsets)."""
    for low, high, data, offsets in text_blocks(column):
        data = LOWER[data]
        starts, ends, first = spans(data, offsets, SPACE)
        words = word_hashes(data, starts, ends)
        runs = shingle_hashes(words, shingle)
        sets = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= shingle:
                sets.append(np.unique(runs[a : b - shingle + 1]))
            else:
                sets.append(shingle_hashes(words[a:b], b - a) ^ np.uint64(b - a) if b > a else words[:0])
        yield low, high, np.concatenate(sets), np.cumsum([0, *map(len, sets)])


def signatures(docs: DataFrame, how: NearDuplicates) -> DataFrame:
    """``__key, n, high, low, signature, bands``; ``docs`` are keyed. high, low: 128 bits of the set."""
    k, shingle, rows = how.hashes, how.shingle, how.rows
    draw = np.random.default_rng(97).integers(0, 2**63, 2 * k, dtype=np.int64).astype(np.uint64)
    factors, masks = draw[:k] << np.uint64(1) | np.uint64(1), mixed(draw[k:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, hashes, offsets in shingle_sets(batch.column(1), shingle):
                yield block(batch.column(0).slice(low, high - low), hashes, offsets)

    def block(keys: pa.Array, hashes: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        n = np.diff(offsets)
        some = np.flatnonzero(n)
        signature = np.zeros((len(n), k), np.uint32)
        for i in range(k if len(some) else 0):
            values = (hashes ^ masks[i]) * factors[i]
            signature[some, i] = np.minimum.reduceat(values, offsets[some]) >> np.uint64(32)
        ids = [xxhash.xxh3_128_intdigest(hashes[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
        band = np.zeros((len(n), k // rows), np.uint64)
        for i in range(rows):
            band = mixed(band * np.uint64(FACTOR) + signature[:, i::rows])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * band.shape[1]), pa.array(band.ravel().view(np.int64)))
        columns = [
            keys,
            pa.array(n.astype(np.int64)),
            pa.array(np.array([x >> 64 for x in ids], np.uint64).view(np.int64)),
            pa.array(np.array([x & (1 << 64) - 1 for x in ids], np.uint64).view(np.int64)),
            pa.array([row.tobytes() for row in signature], pa.binary()),
            lists,
        ]
        return pa.RecordBatch.from_arrays(columns, [KEY, "n", "high", "low", "signature", "bands"])

    kinds = f"{KEY} bigint, n bigint, high bigint, low bigint, signature binary, bands array<bigint>"
    return docs.select(KEY, F.col("text").cast("string").alias("text")).mapInArrow(run, kinds)


def signature_rows(column: pa.Array, width: int) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data.view(np.uint32).reshape(len(column), width)


def surviving(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, needed: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs (rows i of a, j of b) are not given up, and their matches."""
    alive, matches = np.arange(len(i)), np.zeros(len(i), np.int32)
    seen = 0
    for n, least in needed:
        if not len(alive):
            break
        matches += (a[i[alive], seen:n] == b[j[alive], seen:n]).sum(1, dtype=np.int32)
        keep = matches >= least
        alive, matches, seen = alive[keep], matches[keep], n
    return alive, matches


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share ``percent`` of their union."""
    joint = np.sort(np.concatenate([x, y]), kind="stable")
    shared = int((joint[1:] == joint[:-1]).sum())
    return 100 * shared >= percent * (len(joint) - shared)


class Search:
    def __init__(self, docs: DataFrame, how: NearDuplicates):
        self.docs, self.how, self.needed = docs, how, how.needed()
        self.all = written(signatures(docs, how))
        full = self.all.filter("n > 0")
        first = full.groupBy("high", "low", "n").agg(F.min(KEY).alias("first"))
        self.classes = written(full.select(KEY, "high", "low", "n").join(first, ["high", "low", "n"]).select(KEY, "first"))
        firsts = self.classes.filter(F.col(KEY) == F.col("first")).select(KEY)
        rows = full.join(firsts, KEY, "left_semi").select(KEY, "n", F.posexplode("bands").alias("band", "hash"))
        rows = rows.select(F.xxhash64("band", "hash").alias("bucket"), KEY, "n")
        hubs = rows.groupBy("bucket").agg(F.min(KEY).alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1")
        self.members = written(rows.join(hubs, "bucket").select("bucket", KEY, "n", "hub", "size"))
        some = self.members.select(KEY).distinct()
        self.signatures = written(full.join(some, KEY).select(KEY, "n", "signature"))
        self.sets = self.full_sets(docs.join(some, KEY))
        self.labels: DataFrame | None = None

    def full_sets(self, docs: DataFrame) -> DataFrame:
        shingle = self.how.shingle

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low, high, hashes, offsets in shingle_sets(batch.column(1), shingle):
                    values = [hashes[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(values, pa.binary())], [KEY, "shingles"])

        chosen = docs.select(KEY, F.col("text").cast("string").alias("text"))
        return written(chosen.mapInArrow(run, f"{KEY} bigint, shingles binary"), "snappy")

    def side(self, table: DataFrame, name: str) -> DataFrame:
        return table.select(*[F.col(c).alias(name if c == KEY else f"{c}_{name}") for c in table.columns])

    def near_in_size(self) -> str:
        return f"100 * least(n_a, n_b) >= {self.how.percent} * greatest(n_a, n_b)"

    def survivors(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``a, b`` that their signatures do not rule out."""
        needed, width = self.needed, self.how.hashes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = (signature_rows(batch.column(i), width) for i in (2, 3))
                every = np.arange(batch.num_rows)
                alive, _ = surviving(a, b, every, every, needed)
                yield batch.select([0, 1]).take(pa.array(alive))

        both = pairs.join(self.side(self.signatures, "b"), "b").join(self.side(self.signatures, "a"), "a")
        return both.filter(self.near_in_size()).select("a", "b", "signature_a", "signature_b").mapInArrow(run, "a bigint, b bigint")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar enough."""
        percent = self.how.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column(2), batch.column(3)):
                    keep.append(similar(*(np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y)), percent))
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        both = pairs.join(self.side(self.sets, "b"), "b").join(self.side(self.sets, "a"), "a")
        return both.select("a", "b", "shingles_a", "shingles_b").mapInArrow(run, "a bigint, b bigint")

    def open_members(self) -> DataFrame:
        """``bucket, __key, n, label`` of the buckets that hold several labels; unlinked documents are their own."""
        rows = self.members.filter("size > 2").select("bucket", KEY, "n")
        rows = rows.join(self.labels.withColumnRenamed("node", KEY), KEY, "left").withColumn("label", F.coalesce("label", KEY))
        same = [F.bit_xor(F.xxhash64(F.lit(i), KEY)).alias(f"same_{i}") for i in (1, 2)]
        size = F.count(F.lit(1)).alias("size")
        kinds = rows.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), size, *same).filter("x <> y")
        chosen = kinds.groupBy("size", "same_1", "same_2").agg(F.min("bucket").alias("bucket"))
        return written(rows.join(chosen.select("bucket"), "bucket"))

    def by_block(self, rows: DataFrame) -> DataFrame:
        """Links ``a, b`` between labels: in each block of a bucket, enough to join all labels that a link joins there.

        The members of a bucket are dealt over ``across`` parts, those outside its largest label over ``down`` parts
        as well; a block is one part of each, of about SIDE documents and HELD bytes of full sets a side.
        """
        sizes = rows.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("held"))
        most = F.max_by(F.struct("label", "c", "held"), F.struct("c", "label")).alias("most")
        sizes = sizes.groupBy("bucket").agg(most, F.sum("c").alias("c"), F.sum("held").alias("held"))
        parts = lambda c, held: F.greatest(F.ceil(c / SIDE), F.ceil(held * 8 / HELD)).cast("int")
        across = parts(F.col("c"), F.col("held")).alias("across")
        down = parts(F.col("c") - F.col("most.c"), F.col("held") - F.col("most.held")).alias("down")
        full = rows.join(sizes.select("bucket", F.col("most.label").alias("main"), across, down), "bucket")
        spot = lambda n: F.pmod(F.xxhash64(KEY), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        shared = ["bucket", KEY, "label", "n", "main"]
        builds = full.select(*shared, spot("across").alias("x"), every("down").alias("y"), F.lit(False).alias("probe"))
        probes = full.filter("label <> main").select(*shared, every("across").alias("x"), spot("down").alias("y"), F.lit(True).alias("probe"))
        dealt = builds.unionByName(probes).join(self.signatures.drop("n"), KEY).join(self.sets, KEY)
        dealt = dealt.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
        needed, width, percent = self.needed, self.how.hashes, self.how.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in whole_groups((b for batch in batches for b in slices(batch)), 3):
                bucket, x, y = (table.column(i).to_numpy() for i in range(3))
                edge = np.flatnonzero((bucket[1:] != bucket[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
                for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(bucket)]):
                    found = linked(table.slice(a, b - a))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

        def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for low in range(0, batch.num_rows, 500):
                yield batch.slice(low, 500)

        def linked(block: pa.Table) -> list[tuple[int, int]]:
            keys, label, n, main, probe = (block.column(i).to_numpy() for i in range(3, 8))
            signature = np.concatenate([signature_rows(part, width) for part in block.column(8).chunks])
            sets = [np.frombuffer(v.as_buffer(), np.uint64) for part in block.column(9).chunks for v in part]
            root = np.unique(label, return_inverse=True)[1]  # of each row, the component found so far
            q, out = np.flatnonzero(~probe), []
            for i in np.flatnonzero(probe).tolist():
                fits = (root[q] != root[i]) & (100 * np.minimum(n[q], n[i]) >= percent * np.maximum(n[q], n[i]))
                j = q[fits & ((label[q] == main[q]) | (keys[i] < keys[q]))]
                alive, _ = surviving(signature, signature, np.full(len(j), i), j, needed)
                for k in j[alive].tolist():
                    if root[k] != root[i] and similar(sets[i], sets[k], percent):
                        out.append((int(keys[i]), int(keys[k])))
                        root[root == root[k]] = root[i]
            return out

        columns = ["bucket", "x", "y", KEY, "label", "n", "main", "probe", "signature", "shingles"]
        return dealt.select(*columns).mapInArrow(run, "a bigint, b bigint")

    def run(self) -> None:
        first = self.members.filter(F.col(KEY) != F.col("hub")).select(F.col("hub").alias("a"), F.col(KEY).alias("b"))
        links = written(self.confirmed(self.survivors(first.distinct())))
        self.labels = written(components(links, 2))
        rows = self.open_members()
        if rows.take(1):
            links = links.unionByName(written(self.by_block(rows)))
        self.labels = components(links)


def whole_groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.Table]:
    """Rows sorted by the first columns, in tables that hold every group they touch in full."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = [batch.column(i).to_numpy() for i in range(columns)]
        change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1
        if rest and any(rest[-1].column(i)[rest[-1].num_rows - 1].as_py() != batch.column(i)[0].as_py() for i in range(columns)):
            change = np.append(0, change)
        if rest and len(change) and sum(r.num_rows for r in rest) >= SIDE:
            if change[-1]:
                rest.append(batch.slice(0, change[-1]))
            yield pa.Table.from_batches(rest)
            rest = [batch.slice(change[-1])]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


def near_duplicates(docs: DataFrame, how: NearDuplicates = NearDuplicates()) -> DataFrame:
    """``__key, n_shingles, component``: the smallest key each document is linked with, itself included; keyed ``docs``."""
    search = Search(docs, how)
    search.run()
    whole = search.classes.join(search.labels.withColumnRenamed("node", "first"), "first", "left")
    whole = whole.select(KEY, F.coalesce("label", "first").alias("component"))
    out = search.all.select(KEY, F.col("n").alias("n_shingles")).join(whole, KEY, "left")
    return out.select(KEY, "n_shingles", F.coalesce("component", KEY).alias("component"))


def op5_minhash_bayes(spark: SparkSession, folder: str) -> DataFrame:
    docs = keyed(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    found = near_duplicates(docs, NearDuplicates(shingle=4, percent=80))
    ids = docs.select(F.col(KEY).alias("component"), F.col("doc_id").alias("component_id"))
    named = found.join(docs.select(KEY, "doc_id"), KEY).join(ids, "component")
    return named.select("doc_id", "n_shingles", "component_id", (F.col(KEY) == F.col("component")).alias("kept"))


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g
  FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM comp LEFT JOIN n USING (doc_id)
"""
