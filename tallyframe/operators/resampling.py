"""Cluster bootstrap, split halves and permutations without writing out resampled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import hashed, ratio
from tallyframe.functions.draws import MODULUS, drawn
from tallyframe.functions.ordered import ALL, Grouped, Ordered, matched, small
from tallyframe.operators.detection import auc, score_counts
from tallyframe.operators.replicates import Draws, Halves, replicate_auc, replicate_sums
from tallyframe.session import cut, ship

ship(__name__)


def index_clusters(rows: DataFrame, cluster: str) -> DataFrame:
    """Distinct clusters numbered in sorted order."""
    return cut(Ordered(rows.select(cluster).distinct(), [], [cluster]).position("idx"))


def half_weights(clusters: DataFrame, splits: int, seed: int) -> DataFrame:
    """``idx, rep``: the clusters in column ``rep`` of ``Halves``; a task draws a split at a time."""
    halves = Halves(clusters.count(), 2 * splits, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep in batch.column(0).to_pylist():
                idx = np.flatnonzero(halves.column(rep))
                yield pa.RecordBatch.from_arrays([pa.array(idx), pa.array(np.full(len(idx), rep, np.int32))], ["idx", "rep"])

    return clusters.sparkSession.range(2 * splits).mapInArrow(run, "idx bigint, rep int")


def indexed_counts(scored: DataFrame, cluster: str, keys: list[str], population: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Score counts per key and numbered cluster, and the clusters."""
    counts = cut(score_counts(scored, keys, [cluster]))
    clusters = index_clusters(population if population is not None else counts, cluster)
    return counts.join(small(clusters), cluster).drop(cluster), clusters


def bootstrap_auc(scored: DataFrame, cluster: str, keys: list[str], reps: int, seed: int, population: DataFrame | None = None) -> DataFrame:
    """AUC per replicate of clusters drawn with replacement; replicates left with one class are skipped.

    ``population`` fixes the clusters that are drawn from (all clusters); without it only
    clusters with a defined score take part.
    """
    counts, clusters = indexed_counts(scored, cluster, keys, population)
    return replicate_auc(counts, keys, Draws(clusters.count(), reps, seed)).filter("auc IS NOT NULL")


def auc_interval(scored: DataFrame, cluster: str, keys: list[str], reps: int, seed: int) -> DataFrame:
    """AUC per key with its counts and the clustered percentile interval."""
    scored = cut(scored)
    band = percentile_interval(bootstrap_auc(scored, cluster, keys, reps, seed), keys, "auc")
    return matched(auc(scored, keys), cut(band), keys, "left").withColumn("reps", F.coalesce("reps", F.lit(0).cast("bigint")))


def percentile_interval(draws: DataFrame, keys: list[str], value: str, least: int = 50) -> DataFrame:
    """Percentile 2.5 / 97.5 over replicates; fewer than `least` replicates give no interval."""
    n = F.count(value)
    enough = n >= least
    return draws.groupBy(*keys).agg(
        F.when(enough, F.percentile(value, F.lit(0.025))).alias("lo"),
        F.when(enough, F.percentile(value, F.lit(0.975))).alias("hi"),
        n.cast("bigint").alias("reps"),
    )


def paired_delta(draws: DataFrame, rule: str, a: str, b: str) -> DataFrame:
    """Difference between two rules on the same draws."""
    sides = draws.groupBy("rep").agg(
        F.max(F.when(F.col(rule) == a, F.col("auc"))).alias("a"), F.max(F.when(F.col(rule) == b, F.col("auc"))).alias("b")
    )
    delta = sides.select((F.col("a") - F.col("b")).alias("delta")).filter("delta IS NOT NULL")
    return delta.agg(
        F.percentile("delta", F.lit(0.025)).alias("lo"),
        F.percentile("delta", F.lit(0.975)).alias("hi"),
        F.avg((F.col("delta") <= 0).cast("double")).alias("p_le_zero"),
        F.count(F.lit(1)).cast("bigint").alias("reps"),
    )


def bootstrap_rate(rows: DataFrame, cluster: str, keys: list[str], num: Column, den: Column, reps: int, seed: int) -> DataFrame:
    """Clustered interval of a proportion: clusters are summed once, then only sums are resampled."""
    clusters = index_clusters(rows, cluster)
    per = cut(rows.groupBy(*keys, cluster).agg(F.count_if(num & den).alias("num"), F.count_if(den).alias("den")))
    numbered = per.join(small(clusters), cluster).select(*keys, "idx", F.col("num").alias("p"), F.col("den").alias("n"))
    drawn = replicate_sums(numbered, keys, Draws(clusters.count(), reps, seed))
    rates = drawn.select(*keys, ratio(F.col("p"), F.col("n")).alias("rate")).filter("rate IS NOT NULL")
    point = per.groupBy(*keys).agg(
        ratio(F.sum("num"), F.sum("den")).alias("value"),
        F.sum("num").cast("bigint").alias("num"),
        F.sum("den").cast("bigint").alias("den"),
    )
    band = percentile_interval(rates, keys, "rate", 1)
    return matched(point, cut(band), keys, "left") if keys else point.select(
        "*", *[band.select(c).scalar().alias(c) for c in ("lo", "hi", "reps")]
    )


def split_half(scored: DataFrame, cluster: str, rule: str, reps: int, seed: int, keys: list[str] | None = None) -> DataFrame:
    """Pick the best rule on one half of the clusters, score it on the other; both directions.

    ``keys`` repeats the whole selection per key, for instance per replicate of permuted labels.
    """
    keys = keys or []
    counts, clusters = indexed_counts(scored, cluster, [*keys, rule], scored)
    halves = replicate_auc(counts, [*keys, rule], Halves(clusters.count(), 2 * reps, seed), "fold")
    return held_out(halves, rule, keys)


def held_out(halves: DataFrame, rule: str, keys: list[str]) -> DataFrame:
    """The best rule of each half, from ``keys, rule, fold, auc``, with its AUC on the other half."""
    halves = cut(halves.filter("auc IS NOT NULL"))
    best = halves.groupBy(*keys, "fold").agg(F.min(F.struct((-F.col("auc")).alias("down"), F.col(rule))).alias("__b"))
    chosen = best.select(*keys, F.col(f"__b.{rule}").alias(rule), F.col("fold").alias("__from"), F.expr("fold ^ 1").alias("fold"))
    held = chosen.join(halves, [*keys, rule, "fold"])
    return held.select(*keys, F.col("__from").alias("fold"), rule, F.col("auc").alias("held_auc"))


def permute_within(rows: DataFrame, group: list[str], item: str, label: str, reps: int, seed: int) -> DataFrame:
    """Shuffle labels inside each group, once per replicate; every group keeps its label totals.

    The k-th item of the group by hash receives the label of the k-th item by id.
    """
    base = Ordered(rows.select(*group, item, label), group, [item]).position("k")
    many = base.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    shuffled = many.drop("k", label).withColumn("draw", hashed(F.lit(seed), F.col("rep"), F.col(item)))
    placed = Ordered(shuffled, [*group, "rep"], ["draw", item]).position("k")
    labels = base.select(*group, "k", label)
    return placed.join(labels, [*group, "k"]).select("rep", *group, item, label)


def permuted_masks(rows: DataFrame, group: list[str], item: str, label: str, reps: int, seed: int) -> DataFrame:
    """Labels permuted within each group, as bits: ``group, item, mask``, bit r of ``mask`` set where replicate r has
    the item as an error.

    A replicate's errors are the items with the smallest draws of their group, as many as the group has errors; rows
    without a label take no part. A group within the row limit is one task's work. An oversized group is dealt into
    pieces; its k-th smallest draws are found for all replicates at once by counting ranges of draws and narrowing
    them, so nothing is sorted or written per row and replicate.
    """
    known = rows.filter(F.col(label).isNotNull()).select(*group, F.col(item), F.col(label).alias("__label"))
    placed = Ordered(known, [], [item]).position("__j")
    groups = Grouped(placed, group)
    keys = groups.keys
    kinds = dict(groups.df.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in [*keys, item]], "mask binary"])

    def small_group(table: pa.Table) -> pa.Table:
        j, wrong = table.column("__j").to_numpy(), table.column("__label").to_numpy()
        errors = int(wrong.sum())
        mask = np.zeros((len(j), (reps + 7) // 8), np.uint8)
        for rep in range(reps if errors else 0):
            chosen = np.argpartition(drawn(seed, rep, j), errors - 1)[:errors]
            mask[chosen, rep // 8] |= np.uint8(1 << rep % 8)
        return pa.table([*[table.column(c) for c in [*keys, item]], pa.array([m.tobytes() for m in mask], pa.binary())], [*keys, item, "mask"])

    usual = groups.df if groups.big is None else matched(groups.df, groups.big.select(*keys), keys, "left_anti")
    out = usual.groupBy(*keys).applyInArrow(small_group, schema)
    if groups.big is not None:
        out = out.unionByName(_large_masks(groups, item, reps, seed, schema))
    return out.drop(ALL)


def mask_totals(masks: DataFrame, keys: list[str], reps: int) -> DataFrame:
    """``keys, times, reps_sum``: in how many replicates a row is an error, and the sum of their numbers."""
    kinds = dict(masks.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = np.frombuffer(b"".join(m.as_buffer() for m in batch.column("mask")), np.uint8)
            hit = np.unpackbits(data.reshape(batch.num_rows, -1), axis=1, bitorder="little")[:, :reps].astype(np.int64)
            columns = [*[batch.column(k) for k in keys], pa.array(hit.sum(1)), pa.array(hit @ np.arange(hit.shape[1]))]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "times", "reps_sum"])

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "times bigint, reps_sum bigint"])
    return masks.select(*keys, "mask").mapInArrow(run, schema)


_FAN = 128  # ranges that a range of draws is cut into


def _large_masks(groups: Grouped, item: str, reps: int, seed: int, schema: str) -> DataFrame:
    keys = groups.keys
    rows = matched(groups.df, groups.big.select(*keys), keys, "left_semi")
    # pieces of a group as arrays, one row each
    dealt = rows.withColumn("__slice", F.floor(F.col("__j") / groups.limit))
    entry = F.struct(F.col(item).alias("item"), F.col("__j").alias("j"), F.col("__label").alias("wrong"))
    pieces = cut(dealt.groupBy(*keys, "__slice").agg(F.collect_list(entry).alias("rows")))
    names = cut(groups.big.select(*keys).withColumn("__g", F.monotonically_increasing_id()))
    pieces = cut(matched(pieces, names, keys, "inner"))
    errors = pieces.select("__g", F.expr("size(filter(rows, r -> r.wrong))").alias("k")).groupBy("__g").agg(F.sum("k").alias("k"))
    state = errors.select("__g", F.array_repeat(F.lit(0).cast("bigint"), reps).alias("low"), F.array_repeat("k", reps).alias("need"))
    width = MODULUS
    while width > 1:
        state = cut(_narrowed(pieces, state, reps, seed, width))
        width = -(-width // _FAN)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held = batch.column("rows")[i].values
                j = held.field("j").to_numpy()
                low, need = (batch.column(c)[i].values.to_numpy() for c in ("low", "need"))
                mask = np.zeros((len(j), (reps + 7) // 8), np.uint8)
                for rep in np.flatnonzero(need > 0).tolist():
                    mask[drawn(seed, rep, j) <= low[rep], rep // 8] |= np.uint8(1 << rep % 8)
                columns = [batch.column(k).take(pa.array(np.full(len(j), i))) for k in keys]
                columns += [held.field("item"), pa.array([m.tobytes() for m in mask], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*keys, item, "mask"])

    return pieces.join(state, "__g").select(*keys, "rows", "low", "need").mapInArrow(mark, schema)


def _narrowed(pieces: DataFrame, state: DataFrame, reps: int, seed: int, width: int) -> DataFrame:
    """``__g, low, need``: the part of each range [low, low + width) that holds the need-th smallest draw."""
    part = -(-width // _FAN)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, group in enumerate(batch.column("__g").to_pylist()):
                j = batch.column("rows")[i].values.field("j").to_numpy()
                low = batch.column("low")[i].values.to_numpy()
                total = totals.setdefault(group, np.zeros((reps, _FAN), np.int64))
                for rep in range(reps):
                    above = drawn(seed, rep, j) - low[rep]
                    inside = above[(above >= 0) & (above < width)]
                    total[rep] += np.bincount(inside // part, minlength=_FAN)
        for group, total in totals.items():
            columns = [pa.array(np.full(reps, group)), pa.array(np.arange(reps, dtype=np.int32)), pa.array(list(total), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["__g", "rep", "counts"])

    counted = pieces.join(state, "__g").select("__g", "rows", "low").mapInArrow(count, "__g bigint, rep int, counts array<bigint>")
    sums = counted.groupBy("__g", "rep").agg(*[F.sum(F.get("counts", F.lit(i))).alias(f"c{i}") for i in range(_FAN)])
    each = state.select("__g", F.posexplode(F.arrays_zip("low", "need")).alias("rep", "s")).select("__g", "rep", "s.low", "s.need")
    counts = F.array(*[F.col(f"c{i}") for i in range(_FAN)])
    both = each.join(sums.select("__g", "rep", counts.alias("counts")), ["__g", "rep"])
    upto = F.transform(F.sequence(F.lit(1), F.lit(_FAN)), lambda i: F.aggregate(F.slice("counts", 1, i), F.lit(0).cast("bigint"), lambda a, x: a + x))
    at = F.array_position(F.transform("upto", lambda t: t >= F.col("need")), True).cast("int") - 1
    both = both.withColumn("upto", upto).withColumn("at", F.when(F.col("need") > 0, at).otherwise(0))
    low = F.col("low") + F.col("at") * F.lit(part)
    need = F.when(F.col("at") > 0, F.col("need") - F.get("upto", F.col("at") - 1)).otherwise(F.col("need"))
    packed = both.groupBy("__g").agg(F.array_sort(F.collect_list(F.struct("rep", low.alias("low"), need.alias("need")))).alias("s"))
    return packed.select("__g", F.col("s.low").alias("low"), F.col("s.need").alias("need"))


def monte_carlo(draws: DataFrame, keys: list[str], value: str, observed: Column) -> DataFrame:
    """Summary of a null distribution and p = (1 + draws at or above observed) / (1 + draws)."""
    n = F.count(value)
    at_least = F.count_if(F.col(value) >= observed)
    return draws.groupBy(*keys).agg(
        n.cast("bigint").alias("reps"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.percentile(value, F.lit(0.95)).alias("p95"),
        F.max(value).alias("max"),
        F.max(observed).alias("observed"),
        ((F.lit(1.0) + at_least) / (F.lit(1.0) + n)).alias("monte_carlo_p"),
    )
