"""Matching predicted items to reference items, and cells to planes, bins and grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.columns import distance
from tallyframe.functions.ordered import Grouped, Ordered, small, spread
from tallyframe.session import BROADCAST_BYTES, cut, setting, stored_bytes

WHOLE = 512  # reference points of a block that is one leaf
LEAF = 64  # reference points of a leaf in larger blocks, and children of a node
BITS = 8  # bits of a quantile rank per axis in the order of the leaves
SLACK = 1 + 1e-9  # keeps rounding in the bounds from dropping an exact tie


def _placed(axes: list[str]) -> Column:
    """Rows with a place: every coordinate is a finite number."""
    return reduce(lambda a, b: a & b, [F.abs(F.col(a)) < F.lit(float("inf")) for a in axes])


def _rank(value: Column, cuts: Column) -> Column:
    """How many of the 2^BITS - 1 ascending cuts are not above the value, by bisection."""
    steps = F.array(*[F.lit(2**b) for b in reversed(range(BITS))])
    return F.aggregate(steps, F.lit(0), lambda r, s: r + F.when(F.get(cuts, r + s - 1) <= value, s).otherwise(0))


def _leaf_of(points: DataFrame, block: list[str], axes: list[str]) -> DataFrame:
    """Number the leaves of crowded blocks: places in Z-order of their quantile ranks, LEAF to a leaf.

    Ranks follow the points' own distribution, so a far outlier moves nothing, and leaves are cut by position, so
    none can be overfull. The order only decides how tight the boxes are; results never depend on it.
    """
    cuts = [i / 2**BITS for i in range(1, 2**BITS)]
    sketch = points.groupBy(*block).agg(*[F.percentile_approx(a, cuts).alias(f"__t_{a}") for a in axes])
    ranked = Grouped(points, block).join_stats(cut(sketch), axes)
    ranked = ranked.select(*points.columns, *[_rank(F.col(a), F.col(f"__t_{a}")).alias(f"__r_{a}") for a in axes])
    order = reduce(
        lambda a, b: a.bitwiseOR(b),
        [
            F.shiftleft(F.shiftright(f"__r_{a}", bit).bitwiseAND(F.lit(1)).cast("long"), bit * len(axes) + i)
            for bit in range(BITS)
            for i, a in enumerate(axes)
        ],
    )
    rows = ranked.select(*points.columns, order.alias("__z"))
    rows = Ordered(rows, block, ["__z", *axes]).position("__node").drop("__z")
    return rows.withColumn("__node", F.expr(f"__node div {LEAF}"))


def _tree(points: DataFrame, block: list[str], axes: list[str]) -> tuple[DataFrame, list[DataFrame], DataFrame | None]:
    """Leaves with their points, the levels of nodes above them (lowest first), and the blocks that have such nodes.

    The height follows from one count. A node is one row that holds its children, their tight boxes and a point of each.
    """
    sizes = points.groupBy(*block).agg(F.count(F.lit(1)).alias("__n"))
    most = sizes.agg(F.max("__n")).first()[0] or 0
    rows = points.withColumn("__node", F.lit(0).cast("long"))
    if most > WHOLE:
        crowded = cut(sizes.filter(F.col("__n") > WHOLE).select(*block))
        rows = points.join(small(crowded), block, "left_anti").withColumn("__node", F.lit(0).cast("long"))
        rows = rows.unionByName(_leaf_of(cut(points.join(small(crowded), block, "left_semi")), block, axes))
    boxes = [f(a).alias(f"{side}_{a}") for a in axes for side, f in (("low", F.min), ("high", F.max))]
    held = F.collect_list(F.struct(*axes, "nearest")).alias("__points")
    leaves = rows.groupBy(*block, "__node").agg(*boxes, held)
    middle = F.get("__points", F.expr("size(__points) div 2"))
    leaves = leaves.withColumn("__some", F.struct(*[middle[a].alias(a) for a in axes]))
    leaves = cut(leaves)
    if most <= WHOLE:
        return leaves, [], None
    sides = [*[f"{side}_{a}" for a in axes for side in ("low", "high")], "__some"]
    upper = [F.first(s).alias(s) if s == "__some" else F.min(s).alias(s) if s.startswith("low_") else F.max(s).alias(s) for s in sides]
    below = leaves.select(*block, "__node", *sides).join(small(crowded), block, "left_semi")
    levels, last = [], (most - 1) // LEAF
    while last > 0:
        kids = F.collect_list(F.struct("__node", *sides)).alias("__kids")
        parent = F.expr(f"__node div {LEAF}").alias("__parent")
        level = cut(below.select("*", parent).groupBy(*block, "__parent").agg(*upper, kids))
        levels.append(level)
        below = level.select(*block, F.col("__parent").alias("__node"), *sides)
        last //= LEAF
    return leaves, levels, crowded


def nearest(
    pred: DataFrame,
    ref: DataFrame,
    block: list[str],
    axes: list[str],
    label: str,
    within: float | None = None,
) -> DataFrame:
    """Nearest reference of every prediction inside its block, exactly; ties take the lowest label.

    Blocks of at most WHOLE reference points are one leaf. The others are leaves of LEAF points under a tree with LEAF
    children a node: each distinct prediction place walks down and drops nodes that cannot hold its nearest point, looks
    into the leaf with the nearest box, and then only into leaves with a box nearer than the point found there, so it
    meets a handful of leaves rather than every reference of its block.  Copies of a place are asked once.  With ``within`` nothing farther is
    looked for.  Rows without a finite place neither find anything nor are found.  Adds ``nearest`` and ``dist``.
    """
    # read several times below and joined on its places: averages worked out anew may differ in their last bits
    pred = pred if stored_bytes(pred) is not None else cut(pred)
    copies = ref.filter(_placed(axes)).groupBy(*block, *axes).agg(F.min(label).alias("nearest"))
    leaves, levels, crowded = _tree(cut(copies), block, axes)
    query = [*block, *[f"q_{a}" for a in axes]]
    # few bytes and much work a row: the adaptive planner would fold all of them into one task
    asked = spread(pred.filter(_placed(axes)).select(*block, *[F.col(a).alias(f"q_{a}") for a in axes]), query).distinct()
    at = [F.col(f"q_{a}") for a in axes]

    def bounded(kid: Column) -> Column:
        low, high = [kid[f"low_{a}"] for a in axes], [kid[f"high_{a}"] for a in axes]
        zero = F.lit(0.0)
        near = [F.greatest(lo - q, q - hi, zero) for lo, hi, q in zip(low, high, at)]
        # the nearest point is no farther than any point of the box
        least, most = distance(near, [zero] * len(axes)), distance(at, [kid["__some"][a] for a in axes])
        return F.struct(kid["__node"].alias("__node"), least.alias("__least"), most.alias("__most"))

    def found(front: DataFrame, *more: str) -> DataFrame:
        """The best point of every leaf a query stands before; columns named in ``more`` ride along."""
        gaps = F.transform("__points", lambda p: F.struct(distance(at, [p[a] for a in axes]).alias("dist"), p["nearest"].alias("nearest")))
        held = small(leaves.select(*block, "__node", "__points"), leaves)
        size = stored_bytes(leaves)
        if size is not None and size > setting(leaves.sparkSession, BROADCAST_BYTES):
            front = spread(front, [*block, "__node"])
        return front.join(held, [*block, "__node"]).select(*query, F.array_min(gaps).alias("__m"), *more)

    root = F.lit(0).cast("long").alias("__node")
    if crowded is None:
        best = found(asked.select("*", root))
    else:
        front = asked.join(small(crowded), block, "left_semi").select("*", root)
        for level in reversed(levels):
            nodes = small(level.select(*block, F.col("__parent").alias("__node"), "__kids"), level)
            seen = front.join(nodes, [*block, "__node"]).select(*query, F.transform("__kids", bounded).alias("__kids"))
            bound = F.array_min(F.transform("__kids", lambda k: k["__most"])) * SLACK
            kept = seen.withColumn("__bound", bound)
            kept = kept.select(*query, F.inline(F.filter("__kids", lambda k: k["__least"] <= F.col("__bound"))))
            # a query stands before a few nodes at a time, so its window stays small
            best = F.min("__most").over(Window.partitionBy(*query)) * SLACK
            kept = kept.withColumn("__bound", best).filter(F.col("__least") <= F.col("__bound"))
            if within is not None:
                kept = kept.filter(F.col("__least") <= within * SLACK)
            front = kept.select(*query, "__node")
        # the leaf with the nearest box first: its best point is so near that few of the others are met at all
        ahead = kept.groupBy(*query).agg(F.sort_array(F.collect_list(F.struct("__least", "__node"))).alias("__ahead"))
        rest = F.expr("slice(__ahead, 2, size(__ahead))").alias("__rest")
        first = found(ahead.select(*query, F.get("__ahead", F.lit(0))["__node"].alias("__node"), rest), "__rest")
        rest = F.filter("__rest", lambda k: k["__least"] <= F.col("__m.dist") * SLACK)
        first = cut(first.withColumn("__rest", rest))
        others = found(first.select(*query, F.inline("__rest")))
        deep = first.select(*query, "__m").unionByName(others).groupBy(*query).agg(F.min("__m").alias("__m"))
        flat = found(asked.join(small(crowded), block, "left_anti").select("*", root))
        best = flat.unionByName(deep)
    if within is not None:
        best = best.filter(F.col("__m.dist") <= within)
    best = best.select(
        *block, *[F.col(f"q_{a}").alias(a) for a in axes], F.col("__m.nearest").alias("nearest"), F.col("__m.dist").alias("dist")
    )
    salt = [c for c, kind in pred.dtypes if c not in block and not kind.startswith("map")]
    return Grouped(pred, [*block, *axes]).join_stats(best, salt)


def match(
    pred: DataFrame, ref: DataFrame, block: list[str], axes: list[str], own: str, label: str, tolerance: float
) -> DataFrame:
    """Matched when the nearest reference lies within tolerance; wrong when its label is not one's own."""
    out = nearest(pred, ref, block, axes, label)
    matched = F.coalesce(F.col("dist") <= tolerance, F.lit(False))
    return out.withColumn("matched", matched).withColumn(
        "wrong", F.when(F.col("matched"), F.col("nearest") != F.col(own))
    )


def has_own(pred: DataFrame, ref: DataFrame, keys: list[str], name: str = "present") -> DataFrame:
    """Whether the prediction's own label exists anywhere in its block's reference."""
    known = ref.select(*keys).distinct().withColumn(name, F.lit(True))
    salt = [c for c, kind in pred.dtypes if c not in keys and not kind.startswith("map")] or keys
    out = Grouped(pred, keys).join_stats(known, salt)
    return out.withColumn(name, F.coalesce(name, F.lit(False)))


def identification_hits(
    truth: DataFrame, pred: DataFrame, block: list[str], axes: list[str], label: str, tolerance: float = 20.0
) -> DataFrame:
    """Per reference label: 1 if the prediction of that label has it as nearest within tolerance, else 0.

    Both sides are first restricted to the labels they share, so a label missing on either
    side neither hits nor competes.
    """
    keys = [*block, label]
    shared_truth = truth.join(pred.select(*keys), keys, "left_semi")
    shared_pred = pred.join(truth.select(*keys), keys, "left_semi").select(*keys, *axes)
    near = nearest(shared_pred, shared_truth, block, axes, label, within=tolerance)
    hits = near.filter(F.col("nearest") == F.col(label)).select(*keys, F.lit(1).alias("hit"))
    return truth.select(*keys).join(hits, keys, "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def label_distance(truth: DataFrame, pred: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    other = pred.select(*keys, *[F.col(a).alias(f"p_{a}") for a in axes])
    gap = distance([F.col(a) for a in axes], [F.col(f"p_{a}") for a in axes])
    return truth.join(other, keys).select(*keys, gap.alias("dist"))


def plane_offsets(points: DataFrame, planes: list[dict], axes: list[str]) -> DataFrame:
    """Row, column and normal offset of every point on every listed plane (a fixed short list)."""

    def dot(vec: list[float], origin: list[float]) -> Column:
        total = F.lit(0.0)
        for a, v, o in zip(axes, vec, origin):
            total = total + (F.col(a) - F.lit(float(o))) * F.lit(float(v))
        return total

    options = F.array(
        *[
            F.struct(
                F.lit(p["plane"]).alias("plane"),
                (dot(p["down"], p["origin"]) / F.lit(float(p["row_step"]))).alias("row"),
                (dot(p["across"], p["origin"]) / F.lit(float(p["col_step"]))).alias("col"),
                dot(p["normal"], p["origin"]).alias("offset"),
            )
            for p in planes
        ]
    )
    return points.withColumn("__p", F.explode(options)).select(*points.columns, "__p.*")


def best_plane(offsets: DataFrame, keys: list[str], rows: float, cols: float) -> DataFrame:
    """The plane with the least total normal distance per key, and how many points fall inside it."""
    inside = (F.col("row").between(0, rows - 1)) & (F.col("col").between(0, cols - 1))
    per = offsets.groupBy(*keys, "plane").agg(
        F.sum(F.abs("offset")).alias("total"), F.count_if(inside).cast("bigint").alias("inside")
    )
    best = per.groupBy(*keys).agg(F.min(F.struct("total", "plane", "inside")).alias("__b"))
    return best.select(*keys, "__b.plane", F.col("__b.total").alias("total_offset"), "__b.inside")


def nearest_bin(value: Column, start: float, step: float, count: int) -> Column:
    """Closest of `count` equally spaced planes; halfway takes the lower one."""
    place = F.ceil((value - F.lit(start)) / F.lit(step) - F.lit(0.5))
    return F.least(F.greatest(place, F.lit(0)), F.lit(count - 1)).cast("int")


def grid_gather(targets: DataFrame, cells: DataFrame, block: list[str], index: dict[str, Column], value: str) -> DataFrame:
    """Read each target's source cell (half-even rounding of its mapped place); outside reads 0."""
    placed = targets.select("*", *[F.rint(c).cast("long").alias(n) for n, c in index.items()])
    keys = [*block, *index]
    return placed.join(cells.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(0)))
