"""Statistics of many replicates over rows that are shuffled once.

A replicate only changes how often a row counts: by the draws of its cluster, by the half its cluster is in, or by a
permuted label. So rows are range-partitioned by (key, score) alone and each task folds its range as a stream, a strip
of replicates at a time, with weights it works out itself. What leaves a task are totals per key and strip: of its
first score, of its last one, and of everything between. A score may lie on both sides of a border; Spark adds up the
totals of equal scores before it carries running totals from range to range, so ties count as ties wherever they lie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallyframe.functions.draws import drawn
from tallyframe.session import ship

ship(__name__)

STRIP = 64  # replicates handled together
WORK = 8_000_000  # rows times replicates in a range
HELD = 32_000_000  # weights a task keeps instead of drawing them again


class Draws:
    """Clusters drawn with replacement: weights by cluster number, for rows with ``idx, p, n``."""

    payload = ("idx", "p", "n")

    def __init__(self, clusters: int, columns: int, seed: int):
        self.clusters, self.columns, self.seed = clusters, columns, seed
        self.made: dict[int, np.ndarray] = {}

    def column(self, at: int) -> np.ndarray:
        picked = drawn(self.seed, at, np.arange(self.clusters)) % self.clusters
        return np.bincount(picked, minlength=self.clusters)

    def table(self, low: int, high: int) -> np.ndarray:
        if low in self.made:
            return self.made[low]
        out = np.stack([self.column(at) for at in range(low, high)], axis=1).astype(np.int32)
        if self.clusters * self.columns <= HELD:
            self.made[low] = out
        return out

    def weights(self, rows: dict[str, np.ndarray], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        w = self.table(low, high)[rows["idx"]].astype(float)
        return w * rows["p"][:, None], w * rows["n"][:, None]


class Halves(Draws):
    """Random halves of the clusters: column 2r is the first half of split r, 2r + 1 the other."""

    def column(self, at: int) -> np.ndarray:
        order = np.argsort(drawn(self.seed, at // 2, np.arange(self.clusters)))
        side = np.ones(self.clusters, np.int64)
        side[order[: self.clusters // 2]] = 0
        return (side == at % 2).astype(np.int64)


class Labels:
    """Permuted labels: for rows with ``mask``, a bit per replicate that is set where the row is an error."""

    payload = ("mask",)

    def __init__(self, reps: int):
        self.reps = self.columns = reps

    # replicates dealt into groups of whole bytes, for work that is spread over replicates too
    def groups(self, most: int) -> int:
        return max(1, math.ceil(math.ceil(self.reps / 8) / math.ceil(math.ceil(self.reps / 8) / most)))

    def bytes_of(self, groups: int) -> int:
        return math.ceil(math.ceil(self.reps / 8) / groups)

    def base_of(self, groups: int, group: int) -> int:
        return group * self.bytes_of(groups) * 8 * (self.columns // self.reps)

    def part(self, groups: int, group: int) -> Labels:
        first = group * self.bytes_of(groups) * 8
        return self.over(min(self.reps, first + self.bytes_of(groups) * 8) - first)

    def over(self, reps: int) -> Labels:
        return Labels(reps)

    def bits(self, rows: dict[str, np.ndarray], low: int, high: int) -> np.ndarray:
        return np.unpackbits(rows["mask"][:, low // 8 : (high + 7) // 8], axis=1, bitorder="little")[:, : high - low].astype(float)

    def weights(self, rows: dict[str, np.ndarray], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        wrong = self.bits(rows, low, high)
        return wrong, 1.0 - wrong


class LabelsInHalves(Labels):
    """Permuted labels scored on halves: column ``rep * folds + fold``, for rows with ``mask, idx``."""

    payload = ("mask", "idx")

    def __init__(self, reps: int, halves: Halves):
        self.halves, self.reps = halves, reps
        self.columns = reps * halves.columns

    def over(self, reps: int) -> LabelsInHalves:
        return LabelsInHalves(reps, self.halves)

    def weights(self, rows: dict[str, np.ndarray], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        folds = self.halves.columns
        side = self.halves.table(0, folds)
        rep, fold = np.divmod(np.arange(low, high), folds)
        first = rep[0] - rep[0] % 8
        wrong = self.bits(rows, first, rep[-1] + 1)[:, rep - first]
        inside = side[rows["idx"]][:, fold]
        return wrong * inside, (1.0 - wrong) * inside


def as_arrays(batch: pa.RecordBatch, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    out = {}
    for name in names:
        column = batch.column(name)
        if pa.types.is_binary(column.type):
            width = len(column[0].as_buffer()) if len(column) else 0
            data = np.frombuffer(b"".join(v.as_buffer() for v in column), np.uint8)
            out[name] = data.reshape(len(column), width)
        else:
            out[name] = column.to_numpy(zero_copy_only=False)
    return out


def key_runs(batch: pa.RecordBatch, keys: list[str]) -> list[tuple[tuple, int, int]]:
    """(key values, first row, end row) of the runs of equal keys."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for k in keys:
        codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    edges = [*np.flatnonzero(new).tolist(), batch.num_rows]
    return [(tuple(batch.column(k)[a].as_py() for k in keys), a, b) for a, b in zip(edges, edges[1:])]


class _Fold:
    """Totals of one key over a stream of ascending scores."""

    def __init__(self, columns: int):
        self.first: tuple | None = None  # score, p, n
        self.open: tuple | None = None
        self.least: float | None = None  # score of the first closed group between
        self.u, self.p, self.n = (np.zeros(columns) for _ in range(3))

    def close(self, score: float, p: np.ndarray, n: np.ndarray) -> None:
        if self.first is None:
            self.first = score, p, n
            return
        self.least = score if self.least is None else self.least
        self.u += n * (self.p + 0.5 * p)
        self.p += p
        self.n += n

    def add(self, scores: np.ndarray, weigher, rows: dict[str, np.ndarray]) -> None:
        starts = np.flatnonzero(np.r_[True, scores[1:] != scores[:-1]])
        first_p, first_n, last_p, last_n = (np.zeros(weigher.columns) for _ in range(4))
        mid = slice(1, len(starts) - 1)
        # the batch's first score may go on from the batch before, its last one into the next
        goes_on = self.open is not None and self.open[0] == scores[0]
        between = len(starts) > 2
        closes_first = len(starts) > 1
        new = []
        for low in range(0, weigher.columns, STRIP):
            high = min(weigher.columns, low + STRIP)
            p, n = (np.add.reduceat(w, starts, axis=0) for w in weigher.weights(rows, low, high))
            first_p[low:high], first_n[low:high], last_p[low:high], last_n[low:high] = p[0], n[0], p[-1], n[-1]
            if between:
                before = np.cumsum(p[mid], axis=0) - 0.5 * p[mid]
                new.append(((n[mid] * before).sum(0), p[mid].sum(0), n[mid].sum(0)))
        if goes_on:
            first_p, first_n = first_p + self.open[1], first_n + self.open[2]
        elif self.open is not None:
            self.close(*self.open)
        if not closes_first:
            self.open = float(scores[0]), first_p, first_n
            return
        self.close(float(scores[0]), first_p, first_n)
        if between:
            u, p, n = (np.concatenate(x) for x in zip(*new))
            self.least = float(scores[starts[1]]) if self.least is None else self.least
            self.u += u + self.p * n
            self.p += p
            self.n += n
        self.open = float(scores[-1]), last_p, last_n

    def segments(self) -> Iterator[tuple[float, bool, np.ndarray, np.ndarray, np.ndarray]]:
        """(score, between, u, p, n)."""
        nothing = np.zeros(len(self.u))
        for border in (self.first, self.open):
            if border is not None:
                yield border[0], False, nothing, border[1], border[2]
        if self.least is not None:
            yield self.least, True, self.u, self.p, self.n


def replicate_auc(rows: DataFrame, keys: list[str], weigher, name: str = "rep", count: int | None = None) -> DataFrame:
    """``keys, name, auc``: the AUC of every replicate, NULL where it is left with one class.

    ``rows`` hold the keys, ``score`` (never NULL) and what the weigher asks for. The one shuffle of rows does not
    grow with the replicates; ranges send three totals per key and replicate.
    """
    count = rows.count() if count is None else count
    pieces = max(1, math.ceil(count * weigher.columns / WORK))
    chosen = rows.select(*keys, "score", *weigher.payload)
    order = [*keys, "score"]
    spread = F.xxhash64(*weigher.payload)  # ties are dealt too
    ranged = chosen.repartitionByRange(pieces, *order, spread).sortWithinPartitions(*order)
    kinds = dict(chosen.dtypes)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        types = [out_schema.field(k).type for k in keys]
        for batch in batches:
            arrays = as_arrays(batch, weigher.payload)
            scores = batch.column("score").to_numpy(zero_copy_only=False)
            for values, a, b in key_runs(batch, keys):
                if state is None or values != key:
                    if state is not None:
                        yield from sent(key, state, types)
                    key, state = values, _Fold(weigher.columns)
                state.add(scores[a:b], weigher, {n: x[a:b] for n, x in arrays.items()})
        if state is not None:
            yield from sent(key, state, types)

    def sent(key: tuple, state: _Fold, types: list) -> Iterator[pa.RecordBatch]:
        for score, between, u, p, n in state.segments():
            starts = np.arange(0, len(u), STRIP)
            m = len(starts)
            ends = pa.array(np.append(starts, len(u)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (u, p, n)]
            columns = [pa.array([v] * m, t) for v, t in zip(key, types)]
            columns += [pa.array([score] * m, pa.float64()), pa.array([between] * m), pa.array(starts.astype(np.int32)), *lists]
            yield pa.RecordBatch.from_arrays(columns, schema=out_schema)

    parts = "score double, between boolean, base int, u array<double>, p array<double>, n array<double>"
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], parts])
    spark = rows.sparkSession
    out_schema = to_arrow_schema(spark.createDataFrame([], schema).schema)
    totals = ranged.mapInArrow(fold, schema)
    each = totals.select(*keys, "score", "between", "base", F.posexplode(F.arrays_zip("u", "p", "n")).alias("at", "t"))
    each = each.withColumn(name, F.col("base") + F.col("at"))
    # totals of a score that lies on both sides of a border come together here
    each = each.groupBy(*keys, name, "score", "between").agg(*[F.sum(f"t.{c}").alias(c) for c in "upn"])
    run = Window.partitionBy(*keys, name).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("p").over(run), F.lit(0.0))
    wins = F.when(F.col("between"), F.col("u")).otherwise(0.5 * F.col("p") * F.col("n")) + F.col("n") * F.col("__before")
    done = each.withColumn("__before", before).groupBy(*keys, name)
    done = done.agg(F.sum(wins).alias("__u"), F.sum("p").alias("__p"), F.sum("n").alias("__n"))
    return done.select(*keys, name, F.try_divide(F.col("__u"), F.col("__p") * F.col("__n")).alias("auc"))


def replicate_sums(rows: DataFrame, keys: list[str], weigher: Draws) -> DataFrame:
    """``keys, rep, p, n``: weighted sums of ``p`` and ``n`` over rows with ``idx``; tasks send sums per key and strip."""
    chosen = rows.select(*keys, *weigher.payload)
    kinds = dict(chosen.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "base int, p array<double>, n array<double>"])
    out_schema = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            arrays = as_arrays(batch, weigher.payload)
            for values, a, b in key_runs(batch, keys):
                total = sums.setdefault(values, np.zeros((2, weigher.columns)))
                part = {n: x[a:b] for n, x in arrays.items()}
                for low in range(0, weigher.columns, STRIP):
                    high = min(weigher.columns, low + STRIP)
                    total[:, low:high] += [w.sum(0) for w in weigher.weights(part, low, high)]
        for values, total in sums.items():
            starts = np.arange(0, weigher.columns, STRIP)
            ends = pa.array(np.append(starts, weigher.columns).astype(np.int32))
            columns = [pa.array([v] * len(starts), out_schema.field(k).type) for k, v in zip(keys, values)]
            columns += [pa.array(starts.astype(np.int32)), *[pa.ListArray.from_arrays(ends, pa.array(x)) for x in total]]
            yield pa.RecordBatch.from_arrays(columns, schema=out_schema)

    totals = (chosen.sortWithinPartitions(*keys) if keys else chosen).mapInArrow(add, schema)
    each = totals.select(*keys, "base", F.posexplode(F.arrays_zip("p", "n")).alias("at", "t"))
    return each.groupBy(*keys, (F.col("base") + F.col("at")).alias("rep")).agg(F.sum("t.p").alias("p"), F.sum("t.n").alias("n"))
