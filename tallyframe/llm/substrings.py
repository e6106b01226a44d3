"""Exact removal of repeated byte strings: every byte of a ``window``-byte string that also starts earlier goes.

1. Every window has an anchor: the leftmost least hash of its ``seed``-byte strings, so equal windows have equal
   anchors. Consecutive windows with one anchor form a stretch, about one per 35 bytes.
2. Equal stretches (by two 64-bit hashes) need no sorting: all but the earliest are repeated throughout. They are
   thinned out within each task first, so a passage in a third of all documents meets in one place once per task.
3. Only anchors with several different stretches go on, as suffixes: the bytes from the anchor on, and those before
   it. Each goes twice, for windows reaching far right and far left, to the shard of the middle bytes all those windows
   share, so that an anchor many texts share does not fill one shard. Spark sorts each shard; ``induced`` carries the
   order and the common prefixes to the starts before the anchors, and finds equal windows.
4. Spans meet their documents again, and are cut out.

Earlier means a smaller doc_id, or the same document and a smaller start. Defined cases: null texts are empty; texts
shorter than a window lose nothing; rows that repeat a doc_id are documents of their own in the order of their texts'
hashes, null ids last; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import BLOCK, KEY, hash_tables, keyed, list_array, mixed, text_blocks, word_hashes, written
from tallyframe.llm.induced import repeated, tuple_type
from tallyframe.session import ship

ship(__name__)

WINDOW = 100
SEED = 32
# Stretches a task gathers before it looks for equal ones among them.
GATHERED = 1 << 20
POSITION_BITS = 24


def seed_hashes(data: np.ndarray, seed: int) -> np.ndarray:
    """Hash of the ``seed`` (a power of two) bytes from each place on."""
    h, step = hash_tables()[0][data], 1
    while step < seed:
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * step * step * 0x51ED27) + h[step:]
        step *= 2
    return (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)


def least_over(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def stretches(data: np.ndarray, ends: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Anchor, first and last window start, seed hash and content hash; ``ends``: each document's end in ``data``."""
    if len(data) < window:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    hashes = seed_hashes(data, seed)
    place = np.arange(len(hashes), dtype=np.uint64)
    ordered = hashes >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS) | place
    anchor = (least_over(ordered, window - seed + 1) & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
    room = np.zeros(len(data) + 1, np.int32)  # whether a window may start: not within window - 1 bytes of an end
    np.add.at(room, np.maximum(ends - window + 1, np.append(0, ends[:-1] + 1)), 1)
    np.add.at(room, np.minimum(ends + 1, len(data)), -1)
    starts = np.flatnonzero(np.cumsum(room)[: len(anchor)] == 0)
    if not len(starts):
        return stretches(data[:0], ends, window, seed)
    anchor = anchor[starts]
    head = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    tail = np.append(head[1:], len(anchor)) - 1
    low, high, anchor = starts[head], starts[tail], anchor[head]
    return anchor, low, high, hashes[anchor], word_hashes(data, low, high + window)


def seeds(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """``route, seed, body, __key, place, known``: one row per stretch. known: an earlier equal one is in the same task."""

    def collapse(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        hashes, bodies, keys, place = (np.concatenate(x) for x in zip(*parts))
        joint = hashes ^ mixed(bodies)
        known = np.zeros(len(keys), bool)
        again = np.flatnonzero(pd.Series(joint).duplicated(keep=False).to_numpy())
        order = again[np.lexsort((place[again], keys[again], bodies[again], hashes[again]))]
        known[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (bodies[order[1:]] == bodies[order[:-1]])
        route = np.where(known, mixed(keys.view(np.uint64)), hashes)
        columns = [route.view(np.int64), hashes.view(np.int64), bodies.view(np.int64), keys, place, known]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["route", "seed", "body", KEY, "place", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for low, _, data, offsets in text_blocks(batch.column(1)):
                # documents longer than a block go through in overlapping parts
                for base in range(0, max(1, len(data)), 8 * BLOCK):
                    part = data[base : base + 8 * BLOCK + window - 1]
                    ends = offsets[1:] - 1 - base
                    ends = np.append(ends[(ends >= 0) & (ends < len(part))], len(part))
                    if base + len(part) >= len(data):
                        ends = np.minimum(ends, len(part) - 1)
                    anchor, first, last, hashes, bodies = stretches(part, ends, window, seed)
                    doc = np.searchsorted(offsets, base + anchor, side="right") - 1
                    place = base + anchor - offsets[doc] << 16 | anchor - first << 8 | last - first
                    parts.append((hashes, bodies, keys[low + doc], place))
                    rows += len(place)
                if rows >= GATHERED:
                    yield collapse(parts)
                    parts, rows = [], 0
        if rows:
            yield collapse(parts)

    kinds = f"route bigint, seed bigint, body bigint, {KEY} bigint, place bigint, known boolean"
    return docs.select(KEY, "text").mapInArrow(run, kinds)


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, and the least and largest distance from a window's start to it."""
    most = place >> 8 & 255
    return place >> 16, most - (place & 255), most


def sort_out(stretch_rows: DataFrame, window: int) -> DataFrame:
    """``__key, start, end, place``: spans that repeat, and (``place`` not null) stretches that need a closer look."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None  # seed and body of the row before
        waiting: tuple[int, int] | None = None  # key and place of a seed's only stretch so far

        for batch in batches:
            hashes, bodies, keys, place, known = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            gone, asked = [np.flatnonzero(known)], []
            extra = []
            at = np.flatnonzero(~known)
            if len(at):
                s, b = hashes[at], bodies[at]
                new_seed, new_body = np.ones(len(at), bool), np.ones(len(at), bool)
                new_seed[1:] = s[1:] != s[:-1]
                new_body[1:] = new_seed[1:] | (b[1:] != b[:-1])
                if last is not None:
                    new_seed[0] = s[0] != last[0]
                    new_body[0] = new_seed[0] or b[0] != last[1]
                gone.append(at[~new_body])
                heads = np.flatnonzero(new_body)
                fresh = new_seed[heads]  # the seed's first stretch; any other one shows that there are several
                # a seed's first row is always a head, so "fresh" is right for rows of new seeds
                several = ~fresh
                several[:-1] |= ~fresh[1:]
                if len(heads) and not fresh[0] and waiting is not None:
                    extra.append(waiting)
                    waiting = None
                asked.append(at[heads[several]])
                if len(heads):
                    lone = not several[-1]
                    waiting = (int(keys[at[heads[-1]]]), int(place[at[heads[-1]]])) if lone else None
                last = (int(s[-1]), int(b[-1]))
            yield rows(keys, place, np.concatenate(gone), np.concatenate(asked) if asked else np.zeros(0, np.int64), extra)

    def rows(keys, place, gone, asked, extra) -> pa.RecordBatch:
        anchor, least, most = unpack(place[gone])
        more = np.array(extra, np.int64).reshape(-1, 2)
        n = len(asked) + len(more)
        none = np.zeros(n, np.int64)
        columns = [
            pa.array(np.concatenate([keys[gone], keys[asked], more[:, 0]])),
            pa.array(np.concatenate([anchor - most, none])),
            pa.array(np.concatenate([anchor - least + window, none])),
            pa.array(np.concatenate([0 * gone, place[asked], more[:, 1]]), mask=np.arange(len(gone) + n) < len(gone)),
        ]
        return pa.RecordBatch.from_arrays(columns, [KEY, "start", "end", "place"])

    dealt = stretch_rows.repartition("route").sortWithinPartitions("known", "seed", "body", KEY, "place")
    kinds = f"{KEY} bigint, start bigint, end bigint, place bigint"
    return dealt.select("seed", "body", KEY, "place", "known").mapInArrow(run, kinds)


def contexts(docs: DataFrame, asked: DataFrame, window: int, seed: int) -> DataFrame:
    """``core, right, left, __key, anchor, least, most``: the bytes around each anchor, for both halves of its windows."""
    half = (window - seed) // 2
    by_doc = asked.groupBy(KEY).agg(F.collect_list("place").alias("places"))  # at most one per byte of the document
    both = docs.select(KEY, "text").join(by_doc, KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["core", "right", "left", KEY, "anchor", "least", "most"]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int16(), pa.int16()]
        out: list[list] = [[] for _ in names]
        for batch in batches:
            for key, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = text.as_py().encode()
                for a, low, high in zip(*(x.tolist() for x in unpack(places.values.to_numpy(zero_copy_only=False)))):
                    for least, most, from_, to in (
                        (low, min(high, half), a, a + window - half),
                        (max(low, half + 1), high, a - half - 1, a + seed),
                    ):
                        if least <= most:
                            core = xxhash.xxh3_64_intdigest(data[from_:to]) - (1 << 63)
                            row = (core, data[a : a + window - least], data[a - most : a], key, a, least, most)
                            for column, value in zip(out, row):
                                column.append(value)
                if len(out[0]) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)
                    out = [[] for _ in names]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    schema = f"core bigint, right binary, left binary, {KEY} bigint, anchor bigint, least smallint, most smallint"
    return both.mapInArrow(run, schema)


def level_zero(batches: Iterator[pa.RecordBatch], window: int, most: int, block: int) -> Iterator[np.ndarray]:
    """Suffix tuples in sorted order with common prefixes, from rows sorted by (core, right)."""
    kind = tuple_type(most)
    before: tuple[int, bytes] | None = None
    for batch in batches:
        for low in range(0, batch.num_rows, block):
            rows = batch.slice(low, block)
            cores = rows.column(0).to_numpy()
            right, left = matrix(rows.column(1), window), matrix(rows.column(2), most, True)
            size = np.diff(offsets_of(rows.column(1)))
            out = np.zeros(rows.num_rows, kind)
            if before is not None:
                right = np.concatenate([before[1], right])
                size, cores = np.append(before[2], size), np.append(before[0], cores)
            differs = right[1:] != right[:-1]
            lcp = np.where(differs.any(1), differs.argmax(1), window)
            lcp = np.minimum(np.minimum(lcp, size[1:]), size[:-1]) * (cores[1:] == cores[:-1])
            out["lcp"] = lcp if before is not None else np.append(0, lcp)
            before = (cores[-1:], right[-1:], size[-1:])
            out["key"], out["at"] = rows.column(3).to_numpy(), rows.column(4).to_numpy()
            out["least"], out["most"], out["left"] = rows.column(5).to_numpy(), rows.column(6).to_numpy(), left
            yield out


def offsets_of(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def matrix(column: pa.Array, width: int, at_end: bool = False) -> np.ndarray:
    """One row of bytes per value, filled with zeros behind it, or before it."""
    offsets = offsets_of(column)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    out = np.zeros((len(size), width), np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], size)
    out[row, inside + (np.repeat(width - size, size) if at_end else 0)] = data
    return out


def merged(keys: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that touch or overlap, as spans."""
    order = np.lexsort((starts, keys))
    keys, starts = keys[order], starts[order]
    head = np.append(True, (keys[1:] != keys[:-1]) | (starts[1:] > starts[:-1] + window))
    return keys[head], starts[head], starts[np.append(np.flatnonzero(head)[1:], len(keys)) - 1] + window


def induced_spans(around: DataFrame, window: int, seed: int, limit: int = 64 << 20, block: int = 20_000) -> DataFrame:
    most = window - seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for part in repeated(level_zero(batches, window, most, block), window, most, limit, block):
            found.append(part)
            held += len(part[0])
            if held > 1_000_000:
                yield spans_of(found)
                found, held = [], 0
        if found:
            yield spans_of(found)

    def spans_of(found) -> pa.RecordBatch:
        columns = merged(*(np.concatenate(x) for x in zip(*found)), window)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [KEY, "start", "end"])

    dealt = around.repartition("core").sortWithinPartitions("core", "right")
    return dealt.mapInArrow(run, f"{KEY} bigint, start bigint, end bigint")


def repeated_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``__key, start, end`` of repeated windows, overlapping and in no order; ``docs`` are keyed."""
    found = written(sort_out(seeds(docs, window, seed), window))
    asked = found.filter(F.col("place").isNotNull())
    inner = induced_spans(contexts(docs, asked, window, seed), window, seed)
    return found.filter(F.col("place").isNull()).select(KEY, "start", "end").unionByName(inner)


def without_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``__key, doc_id, n_bytes, kept, starts, ends``: each document's remaining bytes and its maximal removed runs."""
    docs = docs.select(KEY, "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spans = written(repeated_spans(docs, window, seed))
    by_doc = spans.groupBy(KEY).agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                yield cut(batch.slice(low, 500))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, kept, starts, ends = [], [], [], []
        for text, spans in zip(batch.column(2), batch.column(3)):
            data = text.as_py().encode()
            sizes.append(len(data))
            if not spans.is_valid:
                kept.append(data), starts.append([]), ends.append([])
                continue
            pairs = spans.values
            first, last = (pairs.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            order = np.argsort(first, kind="stable")
            first, last = first[order], np.maximum.accumulate(last[order])
            head = np.append(True, first[1:] > last[:-1])
            starts.append(first[head])
            ends.append(last[np.append(np.flatnonzero(head)[1:], len(first)) - 1])
            edges = [0, *np.ravel(np.column_stack([starts[-1], ends[-1]])).tolist(), len(data)]
            kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
        columns = [pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], [KEY, "doc_id", "n_bytes", "kept", "starts", "ends"])

    kinds = f"{KEY} bigint, doc_id bigint, n_bytes bigint, kept binary, starts array<bigint>, ends array<bigint>"
    return docs.join(by_doc, KEY, "left").select(KEY, "doc_id", "text", "spans").mapInArrow(run, kinds)


def op10_induced_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    cut = without_repeats(keyed(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP10_SQL = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
part AS (SELECT doc_id, 200 * k AS base, substr(x, 400 * k + 1, 598) AS c FROM h, unnest(range(0, (length(x) // 2 + 199) // 200)) AS u(k)),
win AS (SELECT doc_id, base + j AS i, substr(c, 2 * j - 1, 200) AS s FROM part, unnest(range(1, least(200, length(c) // 2 - 99) + 1)) AS u(j) WHERE length(c) >= 200),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
new AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS opens FROM dup),
run AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM new),
span AS (SELECT doc_id, min(i) AS a, max(i) + 99 AS b FROM run GROUP BY doc_id, r),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM span),
kept AS (
  SELECT h.doc_id, any_value(x) AS x, coalesce(sum(b - a + 1), 0) AS n_removed, count(a) AS n_spans,
    coalesce(string_agg(substr(x, 2 * since + 1, 2 * (a - 1 - since)), '' ORDER BY a), '') || substr(any_value(x), 2 * coalesce(max(b), 0) + 1) AS y
  FROM h LEFT JOIN gap USING (doc_id) GROUP BY h.doc_id)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(y)) AS kept_sha256 FROM kept
"""
