"""Ordered items against a smooth curve: residuals, standardising, flags and corruption tests.

A cluster's items are few (one per category), so a fit sees a handful of points.  Clusters are
packed into arrays and fitted batch by batch: all fits of one size are solved together.
The curve is a least-squares polynomial of degree min(degree, n-1) in chord length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.columns import count_if, defined, ratio
from tallyframe.functions.ordered import Grouped
from tallyframe.session import ship

ship(__name__)

MIN_POINTS = 4
MIN_REGION = 4
SAMPLES = 1000
STRETCHES = 27  # of 37 steps between samples each
_BATCH = 512  # searches at a time, so that their tables stay in a core's cache
ROUNDING = 1e-12  # of the squared reach of a curve: far above the rounding of a squared distance
PART_ROWS = 250_000  # items of a partition that is folded cluster by cluster
FLAT = 1e-12  # a polynomial of that size over the places says nothing

# The four decision rules (score, z threshold, floor of the deviation, least residual).
PRESETS = [
    ("deployed", "z", 1.5, 0.1, 0.0),
    ("guarded", "z", 1.5, 1.0, 3.0),
    ("loo", "z_loo", 1.5, 1.0, 3.0),
    ("loo_raw", "z_loo", 1.5, 1.0, 0.0),
]


def _fit(points: np.ndarray, of: np.ndarray, asked: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances of asked points to the curves through points, and fit RMS per axis.

    points is (B, m, 2); asked is (N, 2), each with the number of its curve in ``of``. Undefined fits give NaN.
    """
    count, m = points.shape[:2]
    resid, rms = np.full(len(of), np.nan), np.full((count, 2), np.nan)
    if m < MIN_POINTS or not count:
        return resid, rms
    place = np.ascontiguousarray(points.transpose(2, 1, 0))  # (2, m, B): sums over the few points of a fit run along fits
    steps = np.sqrt((np.diff(place, axis=1) ** 2).sum(axis=0))
    chord = np.concatenate([np.zeros((1, count)), np.cumsum(steps, axis=0)])
    good = chord[-1] > 0
    place, t = place[:, :, good], chord[:, good] / chord[-1, good]
    used = good[of]
    curve = (np.cumsum(good) - 1)[of[used]]
    if min(degree, m - 1) == 1:
        coef = _line(t, place)
        at_places = coef[0][:, None] + coef[1][:, None] * t
        resid[used] = _to_line(coef, curve, asked[used].T)
    else:
        basis, shift, scale = _orthogonal(t, min(degree, m - 1))
        size = [(q**2).sum(axis=0) for q in basis]
        coef = [np.divide((q * place).sum(axis=1), n, out=np.zeros_like(place[:, 0]), where=n > FLAT) for q, n in zip(basis, size)]
        at_places = sum(c[:, None] * q for c, q in zip(coef, basis))
        resid[used] = _to_curve(np.stack(coef), shift, scale, curve, asked[used].T)
    rms[good] = np.sqrt(((place - at_places) ** 2).mean(axis=1)).T
    return resid, rms


def _orthogonal(t: np.ndarray, degree: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Polynomials orthogonal over the places ``t`` (m, B), by their three-term recurrence: their values at the places
    and the shifts and scales (degree, B) of the recurrence. Coefficients are then plain sums, and a degree that the
    places cannot tell apart (coincident points) has size 0."""
    at, size_before = [np.ones_like(t)], None
    shift, scale = np.zeros((2, degree, t.shape[1]))
    for d in range(degree):
        size = (at[-1] ** 2).sum(axis=0)
        shift[d] = np.divide((t * at[-1] ** 2).sum(axis=0), size, out=np.zeros_like(size), where=size > FLAT)
        new = (t - shift[d]) * at[-1]
        if size_before is not None:
            scale[d] = np.divide(size, size_before, out=np.zeros_like(size), where=size_before > FLAT)
            new = new - scale[d] * at[-2]
        at.append(new)
        size_before = size
    return at, shift, scale


def _powers(coef: np.ndarray, shift: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The curves as sums of powers: their coefficients (degree + 1, 2, B), and how large the summands can get (2, B)."""
    degree, count = shift.shape
    out, reach = np.zeros_like(coef), np.zeros_like(coef[0])
    before, own = np.zeros((degree + 1, count)), np.zeros((degree + 1, count))
    own[0] = 1.0
    for d in range(degree + 1):
        out += coef[d] * own[:, None]
        reach += np.abs(coef[d]) * np.abs(own).sum(axis=0)
        if d < degree:
            new = -shift[d] * own - scale[d] * before
            new[1:] += own[:-1]
            before, own = own, new
    return out, reach


def _stretches(degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of powers to Bernstein coefficients on each stretch of samples, (degree + 1, STRETCHES, degree + 1), and
    those to the values at the samples of a stretch, both of its ends included."""
    every = range(degree + 1)
    local = np.array([[math.comb(r, j) / math.comb(degree, j) if j <= r else 0.0 for j in every] for r in every])
    start, step = np.arange(STRETCHES) / STRETCHES, 1 / STRETCHES
    moved = np.array([[math.comb(i, j) * start ** max(i - j, 0) * step**j for i in every] for j in every])  # comb is 0 for j > i
    w = np.linspace(0.0, 1.0, (SAMPLES - 1) // STRETCHES + 1)
    values = np.stack([math.comb(degree, r) * w**r * (1 - w) ** (degree - r) for r in every], axis=1)
    return np.einsum("rj,jis->rsi", local, moved), values


def _to_curve(coef: np.ndarray, shift: np.ndarray, scale: np.ndarray, curve: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Distance of each asked point (2, N) to the nearest of the samples of its curve.

    The squared distance is a polynomial along the curve. On a stretch of samples it is nowhere below its least Bernstein
    coefficient there, so only stretches that can hold the nearest sample are looked at, and of them only samples that
    rounding cannot tell from the nearest are worked out as points of the curve. What is not a number drops nothing.
    """
    degree = len(shift)
    powers, reach = _powers(coef, shift, scale)
    square = np.zeros((2 * degree + 1, powers.shape[2]))
    for i in range(degree + 1):
        square[i : i + degree + 1] += (powers[i] * powers).sum(axis=1)
    bounds, values = _stretches(2 * degree)
    per, grid = len(values) - 1, np.linspace(0.0, 1.0, SAMPLES)
    out = np.empty(len(curve))
    for first in range(0, len(curve), _BATCH):
        own, a = curve[first : first + _BATCH], asked[:, first : first + _BATCH]
        gap = square[:, own]
        gap[: degree + 1] -= 2 * (powers[:, :, own] * a).sum(axis=1)
        gap[0] += (a**2).sum(axis=0)
        doubt = ROUNDING * ((reach[:, own] + np.abs(a)) ** 2).sum(axis=0)
        bern = (bounds.reshape(-1, 2 * degree + 1) @ gap).reshape(2 * degree + 1, STRETCHES, -1)
        most = np.minimum(bern[0].min(axis=0), bern[-1, -1]) + doubt
        search, stretch = np.nonzero(~(bern.min(axis=0) > most).T)
        near = values @ bern[:, stretch, search]
        begin = np.flatnonzero(np.diff(search, prepend=-1))
        most = np.minimum.reduceat(near.min(axis=0), begin) + doubt
        which, sample = np.nonzero(~(near > most[search]).T)
        search = search[which]
        s, c = grid[stretch[which] * per + sample], own[search]
        x = coef[0][:, c]
        before, at = 0.0, np.ones_like(s)
        for d in range(degree):
            before, at = at, (s - shift[d, c]) * at - scale[d, c] * before
            x = x + coef[d + 1][:, c] * at
        exact = ((a[:, search] - x) ** 2).sum(axis=0)
        out[first : first + _BATCH] = np.minimum.reduceat(exact, np.flatnonzero(np.diff(search, prepend=-1)))
    return np.sqrt(out)


def _line(t: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Straight least-squares fit: intercepts and slopes, both (2, B)."""
    mid_t, mid = t.mean(axis=0), place.mean(axis=1)
    off = t - mid_t
    slope = (off * (place - mid[:, None])).sum(axis=1) / (off**2).sum(axis=0)
    return mid - slope * mid_t, slope


def _to_line(coef: tuple[np.ndarray, np.ndarray], curve: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Distance to the nearest of the samples of a line: the sample next to the foot point."""
    away, slope = asked - coef[0][:, curve], coef[1][:, curve]
    size = (slope**2).sum(axis=0)
    along = (away * slope).sum(axis=0)
    foot = np.divide(along, size, out=np.zeros_like(along), where=size > 0)
    at = np.rint(np.clip(foot, 0.0, 1.0) * (SAMPLES - 1)) / (SAMPLES - 1)
    return np.sqrt(((away - slope * at) ** 2).sum(axis=0))


def _residual_arrays(cluster: np.ndarray, region: np.ndarray, xy: np.ndarray, degree: int) -> dict[str, np.ndarray]:
    """Residual facts for points sorted by (cluster, ord); region -1 means the point only shapes fits."""
    n = len(cluster)
    out = {k: np.full(n, np.nan) for k in ("residual", "loo_residual", "rms_x", "rms_y")}
    out |= {k: np.zeros(n, dtype=np.int32) for k in ("idx", "region_size", "n_fit")}

    def settle(index: np.ndarray, keep: np.ndarray) -> None:
        """Fit each row of `index`; results go to the members marked in `keep`."""
        m = index.shape[1]
        rows, cols = np.nonzero(keep)
        to = index[rows, cols]
        resid, rms = _fit(xy[index], rows, xy[to], degree)
        out["residual"][to] = resid
        out["rms_x"][to], out["rms_y"][to] = rms[rows, 0], rms[rows, 1]
        out["n_fit"][to] = m
        if m > MIN_POINTS:
            others = np.array([[j for j in range(m) if j != i] for i in range(m)])
            rest = index[rows[:, None], others[cols]]
            out["loo_residual"][to] = _fit(xy[rest], np.arange(len(to)), xy[to], degree)[0]

    def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.zeros(len(keys[0]), dtype=bool)
        edge[:1] = True
        for key in keys:
            edge[1:] |= key[1:] != key[:-1]
        start = np.flatnonzero(edge)
        return start, np.diff(np.r_[start, len(edge)])

    order = np.lexsort((np.arange(n), region, cluster))
    start, size = runs(cluster[order], region[order])
    named = region[order][start] >= 0
    for m in np.unique(size[named]):
        index = order[start[named & (size == m)][:, None] + np.arange(m)]
        out["idx"][index] = np.arange(m)
        out["region_size"][index] = m
        if m >= MIN_REGION:
            settle(index, np.ones(index.shape, dtype=bool))
    small_region = (region >= 0) & (out["region_size"] < MIN_REGION)
    start, size = runs(cluster)
    for m in np.unique(size):
        index = start[size == m][:, None] + np.arange(m)
        keep = small_region[index]
        used = keep.any(axis=1)
        if used.any():
            settle(index[used], keep[used])
    return out


STATS = {f"__{s}{k}": v for s, v in (("r", "residual"), ("l", "loo_residual")) for k in "msk"}


def _cluster_stats(cluster: np.ndarray, clusters: int, values: np.ndarray) -> list[np.ndarray]:
    """Mean, population deviation and number of the defined values of each point's cluster, one per point."""
    known = ~np.isnan(values)
    at = cluster[known]
    k = np.bincount(at, minlength=clusters)
    mean = np.divide(np.bincount(at, weights=values[known], minlength=clusters), k, out=np.full(clusters, np.nan), where=k > 0)
    spread = np.bincount(at, weights=(values[known] - mean[at]) ** 2, minlength=clusters)
    spread = np.sqrt(np.divide(spread, k, out=np.full(clusters, np.nan), where=k > 0))
    return [mean[cluster], spread[cluster], k[cluster].astype(np.int64)]


def curve_residuals(centers: DataFrame, keys: list[str], degree: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Residual facts per item of (keys, ord, region, x, y); items without a region only shape fits.

    There is one row per cluster and category, so a cluster is a short list whatever the table's
    size.  Columns named in ``carry`` ride along.  ``__rm, __rs, __rk`` and ``__lm, __ls, __lk``: mean, population
    deviation and number of both residuals in the cluster, which is whole here, for ``score_items``.

    A region of at least four members is fitted on its own, in sample; smaller ones use the
    whole cluster.  ``loo_residual`` always refits without the item.  ``deployed_residual`` is
    the mixed form: in sample for regions, leave-one-out where the whole cluster is used.
    """
    place = [F.col(a).cast("double").alias(a) for a in "xy"]
    entry = F.struct("ord", "region", *place, *carry)
    packed = centers.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("pts"))
    kinds = {f.name: f.dataType.simpleString() for f in centers.schema.fields}
    facts = "idx int, region_size int, n_fit int, residual double, loo_residual double, rms_x double, rms_y double"
    facts += ", " + ", ".join(f"{c} {'bigint' if c.endswith('k') else 'double'}" for c in STATS)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in [*keys, "ord", "region", *carry]], facts])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pts")
            flat = lists.flatten()
            cluster = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            name = flat.field("region")
            code = np.nan_to_num(name.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(float), nan=-1).astype(int)
            xy = np.stack([flat.field(a).to_numpy(zero_copy_only=False) for a in "xy"], axis=1)
            found = _residual_arrays(cluster, code, xy, degree)
            keep = np.flatnonzero(code >= 0)
            columns = [batch.column(k).take(pa.array(cluster[keep])) for k in keys]
            columns += [flat.field(c).take(pa.array(keep)) for c in ("ord", "region", *carry)]
            names = ["idx", "region_size", "n_fit", "residual", "loo_residual", "rms_x", "rms_y"]
            columns += [pa.array(found[c][keep]) for c in names]
            for c in ("residual", "loo_residual"):
                columns += [pa.array(x) for x in _cluster_stats(cluster[keep], len(lists), found[c][keep])]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "ord", "region", *carry, *names, *STATS])

    out = packed.mapInArrow(solve, schema)
    for name in ("residual", "loo_residual", "rms_x", "rms_y"):
        out = out.withColumn(name, defined(name))
    local = F.col("region_size") >= MIN_REGION
    return (
        out.withColumn("endpoint", (F.col("idx") == 0) | (F.col("idx") == F.col("region_size") - 1))
        .withColumn("scope", F.when(local, "region").otherwise("global"))
        .withColumn("deployed_residual", F.when(local, F.col("residual")).otherwise(F.col("loo_residual")))
    )


def pooled_z(rows: DataFrame, keys: list[str], value: str, floor: Column | float, name: str, salt: list[str]) -> DataFrame:
    """Standardise over the key with the population deviation, never below the floor.

    Needs two defined values; also reports whether the floor was used.
    """
    floor = floor if isinstance(floor, Column) else F.lit(float(floor))
    out = Grouped(rows, keys).with_stats(
        {"__m": F.avg(value), "__s": F.stddev_pop(value), "__k": F.count(value)}, salt
    )
    z = (F.col(value) - F.col("__m")) / F.greatest(F.col("__s"), floor)
    return (
        out.withColumn(name, F.when(F.col("__k") >= 2, z))
        .withColumn(f"{name}_floored", F.when(F.col("__k") >= 2, F.col("__s") < floor))
        .drop("__m", "__s", "__k")
    )


def robust_z(rows: DataFrame, keys: list[str], value: str, floor: Column | float, name: str, salt: list[str]) -> DataFrame:
    """Distance from the median in units of 1.4826 times the median absolute deviation."""
    floor = floor if isinstance(floor, Column) else F.lit(float(floor))
    groups = Grouped(rows, keys)
    mid = groups.with_quantiles(value, {"__med": 0.5}, salt)
    mid = mid.withColumn("__dev", F.abs(F.col(value) - F.col("__med")))
    out = groups.on(mid).with_quantiles("__dev", {"__mad": 0.5}, salt)
    scale = F.greatest(F.lit(1.4826) * F.col("__mad"), floor)
    return out.withColumn(name, (F.col(value) - F.col("__med")) / scale).drop("__med", "__dev", "__mad")


def by_cluster(rows: DataFrame, cluster: list[str], count: int) -> DataFrame:
    """All rows of a cluster in one partition; partitions grow in number with ``count``, not in size."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(count / PART_ROWS)), *cluster)


def with_rules(rows: DataFrame, presets: list[tuple] = PRESETS) -> DataFrame:
    """Every item once per decision rule (a short fixed list)."""
    options = F.array(
        *[
            F.struct(
                F.lit(k).alias("rule"),
                F.lit(s).alias("uses"),
                F.lit(float(z)).alias("threshold"),
                F.lit(float(f)).alias("std_floor"),
                F.lit(float(m)).alias("least_mm"),
            )
            for k, s, z, f, m in presets
        ]
    )
    return rows.withColumn("__r", F.explode(options)).select(*rows.columns, "__r.*")


def score_items(resid: DataFrame, keys: list[str], px_mm: float = 1.0, presets: list[tuple] = PRESETS, whole: bool = False) -> DataFrame:
    """Pooled z of both residuals under each rule's floor, and the pair each rule tests.

    Mean and deviation do not depend on the rule, so they are taken once per cluster (one row
    per category) before the rules multiply the rows; ``whole`` rows bring them: all that ``curve_residuals`` gave for the
    same keys.  ``z_robust`` takes median and 1.4826 times the median
    absolute deviation of the cluster instead. z is rounded to nine places: with two
    items it is exactly 1, and whether it passes a threshold of 1 must not hang on the order
    of summation.
    """
    unknown = {uses for _, uses, *_ in presets} - {"z", "z_loo", "z_robust"}
    if unknown:
        raise ValueError(f"unknown scores: {sorted(unknown)}")
    over = Window.partitionBy(*keys)
    rows = resid
    if not whole:
        how = {"m": F.avg, "s": F.stddev_pop, "k": F.count}
        rows = resid.drop(*STATS).select("*", *[how[n[-1]](c).over(over).alias(n) for n, c in STATS.items()])
    if any(uses == "z_robust" for _, uses, *_ in presets):
        rows = rows.withColumn("__med", F.percentile("residual", F.lit(0.5)).over(over))
        rows = rows.withColumn("__mad", F.percentile(F.abs(F.col("residual") - F.col("__med")), F.lit(0.5)).over(over))
    else:
        rows = rows.withColumns({"__med": F.lit(None).cast("double"), "__mad": F.lit(None).cast("double")})
    rows = with_rules(rows, presets)

    def z(col: str, name: str) -> Column:
        scale = F.greatest(F.col(f"__{name}s"), F.col("std_floor"))
        return F.round(F.when(F.col(f"__{name}k") >= 2, (F.col(col) - F.col(f"__{name}m")) / scale), 9)

    loo = F.col("uses") == "z_loo"
    mm = F.when(loo, F.col("loo_residual")).otherwise(F.col("residual")) * F.lit(float(px_mm))
    scale = F.greatest(F.lit(1.4826) * F.col("__mad"), F.col("std_floor"))
    robust = F.round((F.col("residual") - F.col("__med")) / scale, 9)
    tested = F.when(loo, z("loo_residual", "l")).when(F.col("uses") == "z_robust", robust).otherwise(z("residual", "r"))
    return rows.withColumn("tested", tested).withColumn("tested_mm", mm).drop(*STATS, "__med", "__mad")


def flag(threshold: Column | None = None) -> Column:
    """Strictly above the threshold and at least the least residual; undefined never flags."""
    over = F.col("tested") > (threshold if threshold is not None else F.col("threshold"))
    return F.coalesce(over & (F.col("tested_mm") >= F.col("least_mm")), F.lit(False))


def inject(centers: DataFrame, keys: list[str], offset_mm: float = 10.0, px_mm: float = 1.0) -> DataFrame:
    """Each cluster clean and under four corruptions, one row per item and variant.

    level shift: from the middle on, items take the next item's place and the last is dropped;
    swap: the middle item and the next exchange places; off by one: a shift from the first item;
    offset: the middle item moves sideways.  ``perturbed`` marks changed items, ``site`` the
    middle (or first) one.  Variants a cluster is too short for are left out.  Centres hold one
    row per cluster and category, so the windows are short.
    """
    along, whole = Window.partitionBy(*keys).orderBy("ord"), Window.partitionBy(*keys)
    near = [f(c, 1).over(along).alias(n) for n, f, c in (("nx", F.lead, "x"), ("ny", F.lead, "y"), ("bx", F.lag, "x"), ("by", F.lag, "y"))]
    place = (F.row_number().over(along) - 1).alias("pos")
    rows = centers.select("*", *near, place, F.count(F.lit(1)).over(whole).alias("n"))
    pos, n = F.col("pos"), F.col("n")
    mid = F.floor(n / 2)
    x, y = F.col("x"), F.col("y")

    def variant(name: str, ok: Column, vx: Column, vy: Column, changed: Column, site: Column) -> Column:
        body = F.struct(
            F.lit(name).alias("variant"), vx.alias("x"), vy.alias("y"), changed.alias("perturbed"), (pos == site).alias("site")
        )
        return F.when(ok, body)

    def shifted(start: Column) -> tuple:
        moved = pos >= start
        keep = ~(moved & (pos == n - 1))
        return keep, F.when(moved, F.col("nx")).otherwise(x), F.when(moved, F.col("ny")).otherwise(y), moved, start

    first, second = pos == mid, pos == mid + 1
    swap_x = F.when(first, F.col("nx")).when(second, F.col("bx")).otherwise(x)
    swap_y = F.when(first, F.col("ny")).when(second, F.col("by")).otherwise(y)
    side = F.when(first, x + F.lit(offset_mm / px_mm)).otherwise(x)
    none = F.lit(False)
    options = F.array_compact(
        F.array(
            variant("clean", F.lit(True), x, y, none, F.lit(-1)),
            variant("level_shift", *shifted(mid)),
            variant("swap", mid + 1 < n, swap_x, swap_y, first | second, mid),
            variant("off_by_one", *shifted(F.lit(0))),
            variant("offset", F.lit(True), side, y, first, mid),
        )
    )
    rest = [c for c in centers.columns if c not in ("x", "y")]
    return rows.withColumn("__v", F.explode(options)).select(*rest, "__v.*")


def false_positives(scored: DataFrame, cluster: list[str]) -> DataFrame:
    """False-positive profile on clean data, all breakdowns in one pass."""
    ready = scored.filter("tested IS NOT NULL AND tested_mm IS NOT NULL").withColumn("flagged", flag())
    ready = ready.withColumn("depth", F.least(F.col("idx"), F.col("region_size") - 1 - F.col("idx")))
    ready = ready.withColumn("cluster_id", F.concat_ws("|", *[F.col(c).cast("string") for c in cluster]))
    sets = [["rule"], *[["rule", c] for c in ("endpoint", "depth", "region_size", "scope")]]
    out = ready.groupingSets(
        [[F.col(c) for c in s] for s in sets], "rule", "endpoint", "depth", "region_size", "scope"
    )
    return out.agg(
        count_if(F.lit(True)).alias("n"),
        count_if(F.col("flagged")).alias("fp"),
        ratio(F.count_if("flagged"), F.count(F.lit(1))).alias("fp_rate"),
        count_if(F.col("tested") > F.col("threshold")).alias("z_passed"),
        count_if((F.col("tested") > F.col("threshold")) & ~F.col("flagged")).alias("blocked"),
        F.countDistinct(F.when(F.col("flagged"), F.col("cluster_id"))).alias("clusters_hit"),
    )


def paired_injection(scored: DataFrame, cluster: list[str]) -> DataFrame:
    """Detection per corruption and rule, next to the same clusters before corruption.

    Everything is local to a cluster with all its variants: rows that are partitioned by cluster stay where they are.
    """
    rows = scored.withColumn("flagged", flag())
    before = F.max(F.when(F.col("variant") == "clean", F.col("flagged")))
    pair = Window.partitionBy(*cluster, "ord", "rule")
    marked = rows.withColumn("was", F.coalesce(before.over(pair), F.lit(False))).filter("variant <> 'clean'")
    per = marked.groupBy("variant", "rule", *cluster).agg(
        F.bool_or(F.col("flagged") & F.col("site")).alias("site_hit"),
        F.bool_or(F.col("was") & F.col("site")).alias("site_was"),
        F.bool_or(F.col("flagged") & F.col("perturbed")).alias("any_hit"),
        F.bool_or(F.col("was") & F.col("perturbed")).alias("any_was"),
        F.count_if(~F.col("perturbed")).alias("rest"),
        F.count_if(F.col("flagged") & ~F.col("perturbed")).alias("rest_hit"),
    )
    n = F.count(F.lit(1))
    return per.groupBy("variant", "rule").agg(
        n.cast("bigint").alias("n"),
        ratio(F.count_if("site_hit"), n).alias("site_rate"),
        ratio(F.count_if("site_was"), n).alias("site_rate_clean"),
        ratio(F.count_if("any_hit"), n).alias("any_rate"),
        ratio(F.count_if("any_was"), n).alias("any_rate_clean"),
        ratio(F.sum("rest_hit"), F.sum("rest")).alias("fp_on_rest"),
    )


def threshold_sweep(scored: DataFrame, cluster: list[str], thresholds: list[float]) -> DataFrame:
    """Item and cluster rates at every threshold, from residuals computed once.

    A cluster is hit at a threshold when its largest eligible z exceeds it, so one maximum per
    cluster answers all thresholds; only the item counts are kept per threshold.
    """
    usable = F.col("tested").isNotNull() & F.col("tested_mm").isNotNull()
    eligible = F.when(F.col("tested_mm") >= F.col("least_mm"), F.col("tested"))
    cuts = [(f"__f{i}", float(t)) for i, t in enumerate(thresholds)]
    per = scored.groupBy("variant", "rule", *cluster).agg(
        F.count_if(usable).alias("items"),
        F.max(eligible).alias("top"),
        F.max(F.when(F.col("perturbed"), eligible)).alias("top_changed"),
        *[F.count_if(eligible > t).alias(n) for n, t in cuts],
    )
    n, items = F.count(F.lit(1)), F.sum("items")
    entries = [
        F.struct(
            F.lit(t).alias("z_cut"),
            ratio(F.sum(name), items).alias("item_rate"),
            ratio(F.count_if(F.col("top") > t), n).alias("cluster_rate"),
            ratio(F.count_if(F.col("top_changed") > t), n).alias("detection"),
        )
        for name, t in cuts
    ]
    out = per.groupBy("variant", "rule").agg(n.cast("bigint").alias("n"), F.array(*entries).alias("__e"))
    return out.withColumn("__e", F.explode("__e")).select("variant", "rule", "n", "__e.*")
