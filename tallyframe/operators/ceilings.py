"""Label-informed ceilings: the best fixed channel and the best channel per category."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyframe.functions.columns import defined
from tallyframe.functions.ordered import spread
from tallyframe.operators.detection import auc
from tallyframe.operators.replicates import STRIP, Labels, as_arrays, key_runs
from tallyframe.session import cut, ship

ship(__name__)

SWEEPS = 8
GAIN = 1e-12
CELLS = 5_000  # most cells of category and channel; a cube holds the square of that
CELL_ROWS = 8_000_000  # rows times cells, or times columns of weights, worked on at once
PIECE_CHUNKS = 32  # such chunks in a piece
GROUPS = 32  # most groups of replicates


def best_fixed_channel(scored: DataFrame, keys: list[str], channel: str = "channel") -> DataFrame:
    """Exhaustive over channels; equal AUCs keep the lowest channel."""
    per = auc(scored, [*keys, channel]).filter("auc IS NOT NULL")
    best = per.groupBy(*keys).agg(F.min(F.struct((-F.col("auc")).alias("down"), F.col(channel), "n_wrong", "n_right")).alias("__b"))
    return best.select(*keys, F.col(f"__b.{channel}").alias(channel), (-F.col("__b.down")).alias("auc"), "__b.n_wrong", "__b.n_right")


class Once:
    """Every row as it is: rows with ``p, n``."""

    payload = ("p", "n")
    columns = 1

    def weights(self, rows: dict[str, np.ndarray], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        return rows["p"].astype(float)[:, None], rows["n"].astype(float)[:, None]


@dataclass
class Cells:
    """Categories and channels in order; a cell is ``category * channels + channel``."""

    categories: list
    channels: list

    @property
    def size(self) -> int:
        return len(self.categories) * len(self.channels)


def cells_of(scored: DataFrame) -> Cells:
    """The levels of both dimensions, which are few whatever the number of rows; ValueError beyond ``CELLS``."""
    levels = []
    for name in ("category", "channel"):
        found = [r[0] for r in scored.select(name).distinct().limit(CELLS + 1).collect()]
        levels.append(sorted(found, key=lambda v: (v is not None, v)))
    if len(levels[0]) * len(levels[1]) > CELLS:
        raise ValueError(f"more than {CELLS} cells of category and channel")
    return Cells(*levels)


def coded(scored: DataFrame, cells: Cells) -> DataFrame:
    """Adds ``cell``; rows without a defined score go."""
    spark = scored.sparkSession
    kinds = {f.name: f.dataType for f in scored.schema.fields}
    out = scored.withColumn("score", defined("score")).filter("score IS NOT NULL")
    for name, levels in (("category", cells.categories), ("channel", cells.channels)):
        schema = T.StructType([T.StructField(f"__{name}", kinds[name]), T.StructField(f"__{name}_code", T.IntegerType())])
        codes = F.broadcast(spark.createDataFrame([(v, i) for i, v in enumerate(levels)], schema))  # at most CELLS rows
        out = out.join(codes, F.col(name).eqNullSafe(F.col(f"__{name}"))).drop(f"__{name}")
    cell = F.col("__category_code") * len(cells.channels) + F.col("__channel_code")
    return out.withColumn("cell", cell.cast("int")).drop("__category_code", "__channel_code")


@dataclass
class Border:
    """What lies on the first or last score of a range: errors and correct rows per cell."""

    score: float
    p: np.ndarray
    n: np.ndarray

    def with_(self, other: Border) -> Border:
        return Border(self.score, self.p + other.p, self.n + other.n)


@dataclass
class Cube:
    """For one replicate: twice the pairs (error below correct row, ties half) between any two cells, and cell totals.

    Cubes of score ranges that follow each other add up: every error of the earlier range is below every correct row
    of the later one, but for a score that both hold, whose rows are ties.
    """

    wins: np.ndarray
    p: np.ndarray
    n: np.ndarray
    first: Border
    last: Border

    def then(self, later: Cube) -> Cube:
        wins = self.wins + later.wins + 2 * np.outer(self.p, later.n)
        first, last = self.first, later.last
        if self.last.score == later.first.score:
            wins += np.outer(later.first.p, self.last.n) - np.outer(self.last.p, later.first.n)
            if self.first.score == self.last.score:
                first = self.first.with_(later.first)
            if later.first.score == later.last.score:
                last = self.last.with_(later.last)
        return Cube(wins, self.p + later.p, self.n + later.n, first, last)

    def packed(self) -> bytes:
        scores = np.array([self.first.score, self.last.score]).view(np.int64)
        return np.concatenate([scores, self.wins.ravel(), self.p, self.n, self.first.p, self.first.n, self.last.p, self.last.n]).tobytes()

    @classmethod
    def unpacked(cls, data: bytes, size: int) -> Cube:
        flat = np.frombuffer(data, np.int64)
        scores, rest = flat[:2].view(np.float64), flat[2 + size * size :].reshape(6, size)
        borders = Border(float(scores[0]), rest[2], rest[3]), Border(float(scores[1]), rest[4], rest[5])
        return cls(flat[2 : 2 + size * size].reshape(size, size), rest[0], rest[1], *borders)


class Chunk:
    """Rows in score order, cut into blocks of few rows: the pairs inside a block are listed once for all columns, the
    pairs between blocks are a product of the blocks' cell counts. Tied scores are never cut; a score with many rows is
    a block of its own, where every pair is a tie."""

    def __init__(self, cell: np.ndarray, score: np.ndarray, size: int):
        self.cell, self.score, self.size = cell.astype(np.int64), score, size
        width = max(8, size // 8)  # listing pairs grows with the rows of a block, the product with the number of blocks
        starts = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
        self.starts, sizes = starts, np.diff(np.r_[starts, len(score)])
        group = np.repeat(np.arange(len(starts)), sizes)
        big = sizes >= width
        edge = big.copy()
        edge[0] = False
        edge[1:] |= big[:-1] | (starts[1:] // width != starts[:-1] // width)
        of_group = np.cumsum(edge)
        block, self.blocks = of_group[group], int(of_group[-1]) + 1
        self.place = block * size + self.cell
        self.lone = np.bincount(of_group) == 1
        mixed = ~self.lone[block]
        less, same = [], [np.flatnonzero(mixed)[None].repeat(2, 0)]
        for step in range(1, 2 * width):
            low = np.flatnonzero(mixed[:-step] & (block[step:] == block[:-step])) if step < len(block) else np.empty(0, np.int64)
            if not len(low):
                break
            tied = group[low] == group[low + step]
            less.append(np.stack([low, low + step])[:, ~tied])
            ties = np.stack([low, low + step])[:, tied]
            same += [ties, ties[::-1]]
        self.strict = sum(x.shape[1] for x in less)
        self.error, self.correct = np.concatenate([*less, *same], axis=1)
        self.code = self.cell[self.error] * size + self.cell[self.correct]

    def cube(self, p: np.ndarray, n: np.ndarray) -> Cube:
        size = self.size
        table_p, table_n = (np.bincount(self.place, weights=w, minlength=self.blocks * size).reshape(-1, size) for w in (p, n))
        sum_p, sum_n = table_p.sum(0), table_n.sum(0)
        beside = 2 * (sum_n - np.cumsum(table_n, axis=0))
        beside[self.lone] += table_n[self.lone]
        wins = table_p.T @ beside
        if len(self.code):
            pairs = p[self.error] * n[self.correct]
            pairs[: self.strict] *= 2
            wins += np.bincount(self.code, weights=pairs, minlength=size * size).reshape(size, size)
        first, last = (
            Border(float(self.score[at][0]), *[np.bincount(self.cell[at], weights=w[at], minlength=size).astype(np.int64) for w in (p, n)])
            for at in (slice(0, self.starts[1] if len(self.starts) > 1 else None), slice(self.starts[-1], None))
        )
        return Cube(wins.astype(np.int64), sum_p.astype(np.int64), sum_n.astype(np.int64), first, last)


def rows_cubes(cell: np.ndarray, score: np.ndarray, arrays: dict[str, np.ndarray], weigher, size: int) -> Iterator[Cube]:
    """A cube per column of the weigher from rows in score order; a strip of columns has its weights at a time."""
    chunk = Chunk(cell, score, size)
    for low in range(0, weigher.columns, STRIP):
        high = min(weigher.columns, low + STRIP)
        p, n = (np.ascontiguousarray(w.T) for w in weigher.weights(arrays, low, high))
        yield from map(chunk.cube, p, n)


def climb(cube: Cube, categories: int, channels: int) -> tuple[np.ndarray, np.ndarray]:
    """From every fixed channel, move single categories while the overall AUC gains: (AUC, picks) of each start.

    All starts take a step together. With one category set aside, each of its channels adds what its cell has with
    the cells picked elsewhere and with itself. Needs nothing but the cube.
    """
    wins = cube.wins.astype(float).reshape(categories, channels, categories, channels)
    p, n = (x.astype(float).reshape(categories, channels) for x in (cube.p, cube.n))
    pick = np.repeat(np.arange(channels)[:, None], categories, axis=1)
    every, all_categories = np.arange(channels), np.arange(categories)
    own = wins[all_categories, :, all_categories, :][:, every, every]  # (category, channel)
    best = np.full(channels, -1.0)
    active = np.ones(channels, bool)

    def totals() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = cube.wins.astype(float)
        at = all_categories * channels + pick
        return np.array([flat[np.ix_(a, a)].sum() for a in at]), p[all_categories, pick].sum(1), n[all_categories, pick].sum(1)

    total, sum_p, sum_n = totals()
    for sweep in range(SWEEPS):
        moved = np.zeros(channels, bool)
        for cat in range(categories):
            rest = np.delete(all_categories, cat)
            picked = pick[:, rest]
            # (start, channel of cat): pairs with the cells picked elsewhere, both ways
            cross = wins[cat][:, rest[None, :], picked].sum(2).T + wins[rest[None, :], picked, cat, :].sum(1)
            now = pick[:, cat]
            base = total - cross[every, now] - own[cat, now]
            value = 0.5 * (base[:, None] + cross + own[cat][None])
            pairs = (sum_p - p[cat, now])[:, None] + p[cat][None]
            pairs = pairs * ((sum_n - n[cat, now])[:, None] + n[cat][None])
            area = np.divide(value, pairs, out=np.full(value.shape, -1.0), where=pairs > 0)
            if sweep == 0 and cat == 0:
                best = area[every, now].copy()
            # the first channel that is as good as the best other one, if that gains
            area[every, now] = -1.0
            most = area.max(1)
            better = active & (most > best + GAIN)
            new = np.where(better, (area >= most[:, None] - GAIN).argmax(1), now)
            best = np.where(better, most, best)
            moved |= better
            total = base + cross[every, new] + own[cat, new]
            sum_p, sum_n = sum_p - p[cat, now] + p[cat, new], sum_n - n[cat, now] + n[cat, new]
            pick[:, cat] = new
        active = moved
        if not moved.any():
            break
    return best, pick


def attained(cube: Cube, pick: np.ndarray, channels: int) -> float | None:
    """AUC of a mapping on a cube; None with one class only."""
    at = np.arange(len(pick)) * channels + pick
    pairs = float(cube.p[at].sum()) * float(cube.n[at].sum())
    return 0.5 * float(cube.wins[np.ix_(at, at)].sum()) / pairs if pairs else None


def cubes(rows: DataFrame, keys: list[str], weigher, cells: Cells, groups: int = 1) -> DataFrame:
    """``keys, column, piece, cube`` from rows of (keys, cell, score, what the weigher asks for).

    Rows are range-partitioned by (key, score) and folded as a stream; a task sends one cube per key and column. The
    columns of permuted labels are dealt into ``groups`` of as many replicates, each row's bits with them.
    """
    spark = rows.sparkSession
    size = cells.size
    kinds = dict(rows.dtypes)
    count = rows.count()
    # a piece of many chunks sends as many bytes as one of few, so pieces of many columns are long
    pieces = groups * max(1, math.ceil(count * size / CELL_ROWS / (PIECE_CHUNKS if groups > 1 else 1)))
    chosen = rows.select(*keys, "cell", "score", *weigher.payload)
    if groups > 1:
        step = weigher.bytes_of(groups)
        part = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("__group")
        bits = F.substring(F.col("mask"), F.col("__group") * step + 1, F.lit(step))
        chosen = chosen.select("*", part).withColumn("mask", bits)
    else:
        chosen = chosen.withColumn("__group", F.lit(0))
    order = [*keys, "__group", "score"]
    spread_ties = F.xxhash64("cell", *weigher.payload)
    ranged = chosen.repartitionByRange(pieces, *order, spread_ties).sortWithinPartitions(*order)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "column int, piece int, cube binary"])
    out_schema = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, most = TaskContext.get().partitionId(), max(1, CELL_ROWS // max(size, 4 * STRIP))
        held: list[pa.RecordBatch] = []
        key, total, size_held = None, None, 0

        def closed() -> None:
            nonlocal total, held, size_held
            if held:
                table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                arrays = as_arrays(table, weigher.payload)
                part = weigher if groups == 1 else weigher.part(groups, key[-1])
                new = rows_cubes(table.column("cell").to_numpy(), table.column("score").to_numpy(), arrays, part, size)
                total = list(new) if total is None else [a.then(b) for a, b in zip(total, new)]
                held, size_held = [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            base = 0 if groups == 1 else weigher.base_of(groups, key[-1])
            for i, cube in enumerate(total):
                columns = [pa.array([v], out_schema.field(k).type) for k, v in zip(keys, key)]
                columns += [pa.array([base + i], pa.int32()), pa.array([piece], pa.int32()), pa.array([cube.packed()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=out_schema)

        for batch in batches:
            for values, a, b in key_runs(batch, [*keys, "__group"]):
                if values != key:
                    closed()
                    if total is not None:
                        yield from sent()
                    key, total = values, None
                for low in range(a, b, most):
                    held.append(batch.slice(low, min(b, low + most) - low))
                    size_held += held[-1].num_rows
                    if size_held >= most:
                        closed()
        closed()
        if total is not None:
            yield from sent()

    return ranged.mapInArrow(run, schema)


def searched(found: DataFrame, keys: list[str], cells: Cells, answer, schema: str, unit: int = 1) -> DataFrame:
    """``answer(columns, cubes)`` for the whole cubes of ``unit`` columns that belong together; ``keys`` and its table.

    Cubes of one column are added up in the order of their pieces as they stream by.
    """
    size = cells.size
    kinds = dict(found.dtypes)
    full = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], schema])
    out_schema = to_arrow_schema(found.sparkSession.createDataFrame([], full).schema)
    units = found.withColumn("__unit", F.floor(F.col("column") / unit).cast("int"))
    order = [*keys, "__unit", "column", "piece"]
    dealt = spread(units, [*keys, "__unit"]).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, whole = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            if key is not None:
                table = answer(list(whole), list(whole.values()))
                m = table.num_rows
                columns = [pa.array([v] * m, out_schema.field(k).type) for k, v in zip(keys, key)]
                yield from pa.table([*columns, *table.columns], [*keys, *table.column_names]).cast(out_schema).combine_chunks().to_batches()

        for batch in batches:
            for values, a, b in key_runs(batch, [*keys, "__unit"]):
                if values != key:
                    yield from done()
                    key, whole = values, {}
                for i in range(a, b):
                    column = batch.column("column")[i].as_py()
                    cube = Cube.unpacked(batch.column("cube")[i].as_buffer(), size)
                    whole[column] = whole[column].then(cube) if column in whole else cube
        yield from done()

    return dealt.mapInArrow(run, full)


def score_cells(scored: DataFrame, keys: list[str], extra: list[str], cells: Cells) -> DataFrame:
    known = coded(scored.filter("wrong IS NOT NULL"), cells)
    return cut(known.groupBy(*keys, *extra, "cell", "score").agg(F.count_if("wrong").alias("p"), F.count_if(~F.col("wrong")).alias("n")))


def best_mapping(scored: DataFrame, keys: list[str]) -> DataFrame:
    """One channel per category, found by coordinate ascent from every fixed channel.

    Spark reduces the rows to pairs between cells of (category, channel), a sum over score ranges; the search needs
    only that, whatever the number of rows. The result is attained by the mapping, never a bound, and NULL where a key
    has one class only. Returns (keys, category, channel, search_auc, start) for the categories with rows in the key;
    ``start`` is the channel the search began from.
    """
    cells = cells_of(scored)
    kind = dict(scored.dtypes)
    found = cubes(score_cells(scored, keys, [], cells), keys, Once(), cells)

    def answer(_: list[int], whole: list[Cube]) -> pa.Table:
        best, pick = climb(whole[0], len(cells.categories), len(cells.channels))
        at = int(best.argmax())
        area = float(best[at]) if best[at] >= 0 else None
        some = np.flatnonzero((whole[0].p + whole[0].n).reshape(len(cells.categories), -1).sum(1))
        columns = [[cells.categories[c] for c in some], [cells.channels[h] for h in pick[at][some]], [area] * len(some), [cells.channels[at]] * len(some)]
        return pa.table([pa.array(c) for c in columns], ["category", "channel", "search_auc", "start"])

    schema = f"category {kind['category']}, channel {kind['channel']}, search_auc double, start {kind['channel']}"
    return searched(found, keys, cells, answer, schema)


def mapping_draws(rows: DataFrame, weigher, cells: Cells, groups: int = GROUPS) -> DataFrame:
    """``rep, auc``: the best mapping under every replicate's labels, from rows of (cell, score, mask)."""

    def answer(columns: list[int], whole: list[Cube]) -> pa.Table:
        best = [climb(c, len(cells.categories), len(cells.channels))[0].max() for c in whole]
        return pa.table([pa.array(columns, pa.int32()), pa.array([float(b) if b >= 0 else None for b in best], pa.float64())], ["rep", "auc"])

    groups = weigher.groups(groups)
    return searched(cubes(rows, [], weigher, cells, groups), [], cells, answer, "rep int, auc double")


def cell_pairs(rows: DataFrame, weigher, cells: Cells, groups: int = GROUPS) -> DataFrame:
    """``rep, category, channel, other_category, other_channel, pairs``: how often an error of one cell scores below a
    correct row of the other, ties half; pairs of cells that never do are left out."""

    def answer(columns: list[int], whole: list[Cube]) -> pa.Table:
        rep = np.repeat(columns, [np.count_nonzero(c.wins) for c in whole])
        a, b = np.concatenate([np.stack(np.nonzero(c.wins)) for c in whole], axis=1)
        pairs = np.concatenate([c.wins[np.nonzero(c.wins)] for c in whole]) / 2
        n = len(cells.channels)
        names = [[cells.categories[i] for i in a // n], [cells.channels[i] for i in a % n], [cells.categories[i] for i in b // n], [cells.channels[i] for i in b % n]]
        return pa.table([pa.array(rep), *[pa.array(x) for x in names], pa.array(pairs)], ["rep", "category", "channel", "other_category", "other_channel", "pairs"])

    kinds = "rep bigint, category string, channel string, other_category string, other_channel string, pairs double"
    return searched(cubes(rows, [], weigher, cells, weigher.groups(groups)), [], cells, answer, kinds)


def held_out_mappings(rows: DataFrame, weigher, cells: Cells, groups: int = 1) -> DataFrame:
    """``column, auc``: the best mapping of each half (columns 2s and 2s + 1) scored on the other half.

    Halves that have one class only, fitted or scored, give no row.
    """

    def answer(columns: list[int], whole: list[Cube]) -> pa.Table:
        held = dict(zip(columns, whole))
        out = []
        for column in columns:
            if column ^ 1 in held:
                best, pick = climb(held[column], len(cells.categories), len(cells.channels))
                at = int(best.argmax())
                area = attained(held[column ^ 1], pick[at], len(cells.channels)) if best[at] >= 0 else None
                if area is not None:
                    out.append((column, area))
        return pa.table([pa.array([c for c, _ in out], pa.int32()), pa.array([a for _, a in out], pa.float64())], ["column", "auc"])

    groups = weigher.groups(groups) if groups > 1 else 1
    return searched(cubes(rows, [], weigher, cells, groups), [], cells, answer, "column int, auc double", unit=2)


def mapping_null(scored: DataFrame, masks: DataFrame, item: str, reps: int) -> DataFrame:
    """The mapping search on every replicate of permuted labels: (rep, auc).

    ``scored`` holds (item, category, channel, score), ``masks`` (item, mask) a bit per replicate. A replicate without
    both classes has a NULL auc.
    """
    cells = cells_of(scored)
    rows = cut(coded(scored, cells).join(masks.select(item, "mask"), item).select("cell", "score", "mask"))
    return mapping_draws(rows, Labels(reps), cells)


def mapping_auc(scored: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Exact AUC of a mapping over the whole scored table; categories it does not know read its start channel."""
    starts = mapping.groupBy(*keys).agg(F.first("start").alias("__start"))
    picks = mapping.select(*keys, "category", F.col("channel").alias("__pick"))
    rows = scored.withColumn("category", F.col("category").cast("string"))
    rows = rows.join(starts, keys).join(picks, [*keys, "category"], "left")
    return auc(rows.filter(F.col("channel") == F.coalesce("__pick", "__start")).drop("__pick", "__start"), keys)
