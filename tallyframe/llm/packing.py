"""Packing by non-negative least squares over a histogram of lengths.

Documents become ids; full windows are cut off their fronts. What is left of each, shorter than a window, is counted
by length. Shallow combinations of lengths that fill a window exactly (two lengths, or three with two frequent ones)
are the columns of a least-squares problem whose non-negative solution says how often to use each; it is rounded, kept
within the counts, and the residual documents are packed greedily, end to end, cut where a window is full. The very
last window is split into powers of two, which need no padding.

Everything held on the driver is bounded by the window: one count per length, a few thousand combinations. Which
document takes which slot follows from its rank among those of its length, counted across range partitions, so a
length that a third of all documents share is no task of its own.

Defined cases: null and empty texts are the end id alone; repeated rows and null ids are documents of their own; no
rows give no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import KEY, keyed, list_array, running, written
from tallyframe.llm.token_files import id_type, token_rows
from tallyframe.llm.tokens import loaded, tokenizer_path
from tallyframe.session import ship

ship(__name__)

WINDOW = 4096
FREQUENT = 64  # lengths that may take part in a combination of three
STEPS = 300  # of the least-squares iteration


def combinations(counts: np.ndarray, window: int, frequent: int) -> list[tuple[int, ...]]:
    """Descending length tuples that fill a window, from lengths that occur; ``counts`` by length, below ``window``."""
    present = np.flatnonzero(counts)
    there = set(present.tolist())
    found = {(max(a, window - a), min(a, window - a)) for a in there if window - a in there}
    top = present[np.argsort(-counts[present], kind="stable")][:frequent].tolist()
    for i, a in enumerate(top):
        for b in top[i:]:
            if window - a - b in there:
                found.add(tuple(sorted((a, b, window - a - b), reverse=True)))
    return sorted(found, reverse=True)


def least_squares(counts: np.ndarray, combos: list[tuple[int, ...]], steps: int) -> np.ndarray:
    """x >= 0 that nearly minimises the squared distance of the lengths used from ``counts`` (projected, accelerated)."""
    rows = np.concatenate([np.array(c) for c in combos])
    columns = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    used = lambda x: np.bincount(rows, x[columns], len(counts))
    back = lambda r: np.bincount(columns, r[rows], len(combos))
    probe = np.ones(len(combos))
    for _ in range(30):
        probe = back(used(probe))
        size = np.linalg.norm(probe)
        probe /= size
    x = y = np.zeros(len(combos))
    speed = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(used(y) - counts) / (1.02 * size))
        faster = (1 + (1 + 4 * speed**2) ** 0.5) / 2
        x, y, speed = new, new + (speed - 1) / faster * (new - x), faster
    return x


@dataclass
class Plan:
    """For each length its slots in order: the rank from which a slot's use starts, its sequences and offset."""

    window: int
    slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    planned: np.ndarray  # documents of each length in planned windows
    first: np.ndarray  # rank of the first document of each length
    tokens_before: np.ndarray  # residual ids of shorter lengths
    stream_sequence: int  # sequences before the residual stream
    stream_full: int
    tail: np.ndarray  # where the parts of the last, cut-up window start
    full_sequence: int  # sequences before those of full windows


def make_plan(counts: np.ndarray, window: int = WINDOW, frequent: int = FREQUENT, steps: int = STEPS) -> Plan:
    counts = counts.astype(np.int64)
    combos = combinations(counts * (np.arange(len(counts)) > 0), window, frequent)
    left, uses = counts.copy(), np.zeros(len(combos), np.int64)
    if combos:
        wanted = least_squares(counts.astype(float), combos, steps)
        shares = [np.unique(c, return_counts=True) for c in combos]
        for bound in (np.rint(wanted), np.full(len(combos), np.inf)):  # as solved, then whatever still fits
            for i in np.argsort(-wanted, kind="stable").tolist():
                length, times = shares[i]
                n = int(min(bound[i], (left[length] // times).min()))
                uses[i] += n
                left[length] -= n * times
    slots: dict[int, list[tuple[int, int, int]]] = {}
    taken, sequence = np.zeros(len(counts), np.int64), 0
    for combo, n in zip(combos, uses.tolist()):
        offset = 0
        for length in combo if n else ():
            slots.setdefault(length, []).append((int(taken[length]), sequence, offset))
            taken[length] += n
            offset += length
        sequence += n
    residual = (counts - taken) * np.arange(len(counts))
    total = int(residual.sum())
    rest, parts, at = total % window, [], 0
    for bit in range(window.bit_length(), -1, -1):
        if rest >> bit & 1:
            parts.append(at)
            at += 1 << bit
    return Plan(
        window, {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in slots.items()}, taken,
        np.cumsum(counts) - counts, np.cumsum(residual) - residual, sequence, total // window,
        np.array(parts, np.int64), sequence + total // window + len(parts),
    )


def place(plan: Plan, tokens: np.ndarray, rank: np.ndarray, blocks_before: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document number, start, length, sequence and offset of every piece, by document and start."""
    window = plan.window
    blocks, rest = tokens // window, tokens % window
    owner = np.repeat(np.arange(len(tokens)), blocks)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    found = [(owner, index * window, np.full(len(owner), window), plan.full_sequence + blocks_before[owner] + index, 0 * index)]
    within = rank - plan.first[rest]
    slotted = (rest > 0) & (within < plan.planned[rest])
    for length in np.unique(rest[slotted]).tolist():
        at = np.flatnonzero(slotted & (rest == length))
        since, sequence, offset = plan.slots[length]
        slot = np.searchsorted(since, within[at], side="right") - 1
        found.append((at, blocks[at] * window, rest[at], sequence[slot] + within[at] - since[slot], offset[slot]))
    at = np.flatnonzero((rest > 0) & ~slotted)
    begin = plan.tokens_before[rest[at]] + (within[at] - plan.planned[rest[at]]) * rest[at]
    stream = plan.stream_full * window
    tail = stream + plan.tail
    part = lambda p: np.where(p < stream, p // window, plan.stream_full + np.searchsorted(tail, p, side="right") - 1)
    opens = lambda s: np.where(s < plan.stream_full, s * window, np.append(tail, 0)[np.maximum(s - plan.stream_full, 0)])
    low, high = part(begin), part(begin + rest[at] - 1)
    owner = np.repeat(np.arange(len(at)), high - low + 1)
    sequence = low[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1)
    ends = begin + rest[at]
    a = np.maximum(begin[owner], opens(sequence))
    b = np.where(sequence == high[owner], ends[owner], opens(sequence + 1))
    found.append((at[owner], blocks[at[owner]] * window + a - begin[owner], b - a, plan.stream_sequence + sequence, a - opens(sequence)))
    columns = [np.concatenate([f[i] for f in found]).astype(np.int64) for i in range(5)]
    order = np.lexsort((columns[1], columns[0]))
    return tuple(c[order] for c in columns)


def pack(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, frequent: int = FREQUENT, steps: int = STEPS, digest: bool = False
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    digest: the pieces' CRC-32 as ``ids_crc32`` in place of their ids.
    """
    tokens = written(token_rows(keyed(docs.select("doc_id", "text")), tokenizer, packed=True))
    lengths = tokens.select(KEY, "n")
    lengths = lengths.select(
        KEY, "n", (F.col("n") % window).alias("rest"), F.floor(F.col("n") / window).cast("long").alias("blocks"), F.lit(1).alias("one")
    )
    ranked = written(running(lengths, ["rest", KEY], {"rank": "one", "blocks_before": "blocks"}))
    counts = np.zeros(window, np.int64)
    for row in ranked.groupBy("rest").count().collect():  # at most one row per length below the window
        counts[row["rest"]] = row["count"]
    plan = make_plan(counts, window, frequent, steps)
    names = ["start", "length", "sequence_id", "offset"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n, rank, before = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            owner, *columns = place(plan, n, rank, before)
            offsets = np.searchsorted(owner, np.arange(len(n) + 1))
            lists = [list_array(pa.array(c), offsets) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(key), *lists], [KEY, *names])

    kind = id_type(loaded(tokenizer).get_vocab_size())
    heads = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                rows = batch.slice(low, 256)
                lists = rows.columns[3:]
                ends = lists[0].offsets.to_numpy()
                owner = np.repeat(np.arange(rows.num_rows), np.diff(ends))
                start, length, sequence, offset = (x.values.to_numpy()[ends[0] : ends[-1]] for x in lists)
                whole = [np.frombuffer(x.as_buffer(), kind) for x in rows.column(2)]
                parts = [whole[i][a : a + n].astype("<u4") for i, a, n in zip(owner.tolist(), start.tolist(), length.tolist())]
                if digest:
                    last = pa.array([zlib.crc32(x) for x in parts], pa.int64())
                else:
                    ids = np.concatenate(parts) if parts else np.zeros(0, "<u4")
                    last = list_array(pa.array(ids.view(np.int32)), np.concatenate([[0], np.cumsum(length)]))
                columns = [start, length, rows.column(1).to_numpy()[owner], sequence, offset]
                found = [rows.column(0).take(pa.array(owner)), *map(pa.array, columns), last]
                yield pa.RecordBatch.from_arrays(found, [*heads, "ids_crc32" if digest else "ids"])

    kinds = ", ".join(f"{c} array<bigint>" for c in names)
    placed = ranked.select(KEY, "n", "rank", "blocks_before").mapInArrow(pieces, f"{KEY} bigint, {kinds}")
    # one row per document on both sides, shuffled whatever their sizes
    both = tokens.join(placed.hint("merge"), KEY).select("doc_id", "n", "ids", *names)
    last = "ids_crc32 bigint" if digest else "ids array<int>"
    return both.mapInArrow(cut, ", ".join(f"{c} bigint" for c in heads) + ", " + last)


def op4_pack_nnls(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return pack(docs, tokenizer_path("word_bpe_49k.json"), WINDOW, digest=True).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
