"""Items in order: positions, neighbours, regularity, carried headers, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.ordered import Ordered


def detection_order(items: DataFrame, cluster: list[str], height: str, item: str) -> DataFrame:
    """0-based place from the highest down; items without a height take no place."""
    return Ordered(items.filter(F.col(height).isNotNull()), cluster, [f"-{height}", item]).position("seq")


def position_facts(rows: DataFrame, cluster: list[str], order: list[str]) -> DataFrame:
    """Place, group size, whether at an end, and distance from the nearer end."""
    groups = Ordered(rows, cluster, order)
    placed = groups.position("idx")
    sized = groups.on(placed).with_stats({"group_size": F.count(F.lit(1))}, [o.lstrip("-") for o in order])
    last = F.col("group_size") - 1
    return sized.withColumn("endpoint", (F.col("idx") == 0) | (F.col("idx") == last)).withColumn(
        "depth", F.least(F.col("idx"), last - F.col("idx"))
    )


def _middle(values: Column) -> Column:
    """Median of a short array."""
    ranked, n = F.array_sort(values), F.size(values)
    low = F.get(ranked, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ranked, F.floor(n / 2).cast("int"))
    return (low + high) / F.lit(2.0)


def neighbour_ratio(rows: DataFrame, cluster: list[str], order: list[str], value: str) -> DataFrame:
    """Minus |ln(value / median of up to two positive neighbours each side)|."""
    near = {f"__n{k}": (value, k) for k in (-2, -1, 1, 2)}
    out = Ordered(rows, cluster, order).neighbours(near)
    kept = F.filter(F.array(*near), lambda v: v > 0)
    known = (F.col(value) > 0) & (F.size(kept) > 0)
    score = F.when(known, -F.abs(F.ln(F.col(value) / _middle(kept))))
    return out.withColumn("ratio_score", score).drop(*near)


def spacing_regularity(rows: DataFrame, cluster: list[str], order: list[str], gap) -> DataFrame:
    """Minus the worse |ln(gap / median gap)| of an item's two gaps.

    ``gap(here, there)`` gives the distance from column names of this row to the next row's.
    Groups under three items, and groups whose median gap is zero, are undefined.
    """
    names = gap.columns
    after = {f"__a_{c}": (c, 1) for c in names}
    groups = Ordered(rows, cluster, order)
    step = groups.neighbours(after)
    step = step.withColumn("__gap", gap({c: F.col(c) for c in names}, {c: F.col(f"__a_{c}") for c in names}))
    step = step.drop(*after)
    salt = [o.lstrip("-") for o in order]
    step = groups.on(step).with_quantiles("__gap", {"__med": 0.5}, salt)
    step = groups.on(step).neighbours({"__before": ("__gap", -1)})

    def off(g: Column) -> Column:
        return F.abs(F.ln(F.greatest(g, F.lit(1e-6)) / F.col("__med")))

    # two gaps in the group mean three items
    both = groups.on(step).with_stats({"__gaps": F.count("__gap")}, salt)
    usable = (F.col("__gaps") >= 2) & (F.col("__med") > 0)
    here = F.when(F.col("__gap").isNotNull(), off(F.col("__gap")))
    back = F.when(F.col("__before").isNotNull(), off(F.col("__before")))
    return both.withColumn("spacing_score", F.when(usable, -F.greatest(here, back))).drop(
        "__gap", "__med", "__before", "__gaps"
    )


class Gap:
    """A named distance between a row and the next one."""

    def __init__(self, columns: list[str], make):
        self.columns, self.make = columns, make

    def __call__(self, here: dict, there: dict) -> Column:
        return self.make(here, there)


def log_sessions(lines: DataFrame, source: list[str], order: list[str], header: Column) -> DataFrame:
    """Give every line the header most recently seen; lines before the first header drop out."""
    tagged = lines.withColumn("__h", header)
    return Ordered(tagged, source, order).carry("__h", "session").drop("__h").filter("session IS NOT NULL")


def series_regularity(rows: DataFrame, cluster: list[str], place: str, item: str) -> DataFrame:
    """Even spacing of a series: step from the ends, worst residual from that line, worst gap deviation."""
    groups = Ordered(rows, cluster, [place, item])
    stepped = groups.on(groups.position("i")).neighbours({"prev": (place, -1)})
    ends = {"n": F.count(F.lit(1)), "first": F.min(place), "last": F.max(place)}
    out = groups.on(stepped).with_stats(ends, [item])
    step = F.try_divide((F.col("last") - F.col("first")).cast("double"), (F.col("n") - 1).cast("double"))
    line = F.abs(F.col(place) - (F.col("first") + F.col("i") * step))
    gap = F.abs(F.col(place) - F.col("prev") - step)
    return out.groupBy(*cluster).agg(
        F.max("n").cast("bigint").alias("n"),
        F.max(step).alias("step"),
        F.max(line).alias("worst_residual"),
        F.max(gap).alias("worst_gap"),
    )


def strided(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """At most `limit` rows at an even stride over the whole order; short tables come back whole."""
    placed = Ordered(rows, [], order).position("place")
    step = F.greatest(F.lit(1), F.floor(rows.select(F.count(F.lit(1))).scalar() / limit))
    return placed.filter((F.pmod("place", step) == 0) & (F.col("place") < step * limit))


def alternate(rows: DataFrame, cluster: list[str], label: str) -> DataFrame:
    """First, third, fifth ... of the labels present."""
    placed = Ordered(rows.select(*cluster, label).distinct(), cluster, [label]).position("__k")
    return placed.filter(F.pmod("__k", F.lit(2)) == 0).drop("__k")


def renumber(rows: DataFrame, cluster: list[str], label: str, name: str) -> DataFrame:
    """Consecutive numbers from 1 for the labels present in each cluster."""
    present = Ordered(rows.select(*cluster, label).distinct(), cluster, [label]).position(name)
    return present.withColumn(name, F.col(name) + 1)
