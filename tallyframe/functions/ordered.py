"""Ordered and grouped work that survives one group holding most of the rows.

A window partitioned by a key sorts each key in one task.  ``Grouped`` counts the keys
first.  Keys within the limit take the ordinary window.  Larger keys are cut into ordered
pieces along the sort columns; each piece is worked on alone and the few per-piece totals
are carried from piece to piece.  Both ways give the same rows.
"""

from __future__ import annotations

import math
from copy import copy

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.session import BROADCAST_BYTES, GROUP_ROWS, cut, setting, stored_bytes

PIECE = "__piece"
ALL = "__all"


def small(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Hint a broadcast when the table was written and its stored size is within the bound; else Spark decides.

    ``of`` is the written table that ``df`` selects from, where that is another one.
    """
    size = stored_bytes(df if of is None else of)
    return F.broadcast(df) if size is not None and size <= setting(df.sparkSession, BROADCAST_BYTES) else df


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Partition by key for work that is heavy per row: a fixed number of partitions keeps
    the adaptive planner from folding small but costly groups into one task."""
    spark = df.sparkSession
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(count, *keys)


def _name(spec: str) -> str:
    return spec.lstrip("-")


def sort_columns(order: list[str]) -> list[Column]:
    return [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]


def matched(df: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys that may be NULL; ``other``'s keys are not kept."""
    there = other.select(*[F.col(c).alias(f"__k_{c}") if c in keys else F.col(c) for c in other.columns])
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    size = stored_bytes(other)
    if size is not None and size <= setting(df.sparkSession, BROADCAST_BYTES):
        there = F.broadcast(there)
    out = df.join(there, same, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__k_{k}" for k in keys])


class Grouped:
    """A table with a group key, and the knowledge of which groups are oversized.

    NULL is a key like any other where rows are ordered; statistics are joined on keys that are not NULL.
    """

    def __init__(self, df: DataFrame, keys: list[str], limit: int | None = None):
        self.spark = df.sparkSession
        self.limit = limit or setting(self.spark, GROUP_ROWS)
        self.keys = list(keys) or [ALL]
        self.df = self._keyed(df)
        sizes = self.df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("__n"))
        big = sizes.filter(F.col("__n") > self.limit)
        # at most rows/limit keys can be oversized
        self.big = cut(big) if big.take(1) else None

    def _keyed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(ALL, F.lit(0)) if self.keys == [ALL] else df

    def on(self, df: DataFrame):
        """The same groups over the same rows with other columns; nothing is counted again."""
        twin = copy(self)
        twin.df = twin._keyed(df)
        return twin

    def _drop(self, df: DataFrame) -> DataFrame:
        return df.drop(PIECE, ALL, "__n", "__salt")

    # ---- whole-group values back onto the rows
    def join_stats(self, stats: DataFrame, salt: list[str]) -> DataFrame:
        """Join one row per key onto the rows; oversized keys are spread by the salt columns."""
        if self.keys == [ALL] and ALL not in stats.columns:
            stats = stats.withColumn(ALL, F.lit(0))
        if self.big is None:
            return self._drop(self.df.join(stats, self.keys, "left"))
        spread = self.big.withColumn("__copies", F.ceil(F.col("__n") / self.limit).cast("int")).drop("__n")
        rows = self.df.join(small(spread), self.keys, "left").withColumn(
            "__salt",
            F.coalesce(F.pmod(F.xxhash64(*salt), F.col("__copies").cast("long")), F.lit(0)).cast("int"),
        ).drop("__copies")
        copies = stats.join(small(spread), self.keys, "left").withColumn(
            "__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__copies") - 1, F.lit(0))))
        ).drop("__copies")
        return self._drop(rows.join(copies, [*self.keys, "__salt"], "left"))

    def with_stats(self, aggs: dict[str, Column], salt: list[str]) -> DataFrame:
        """Add whole-group aggregates to every row."""
        if self.big is None:
            over = Window.partitionBy(*self.keys)
            out = self.df.select("*", *[a.over(over).alias(n) for n, a in aggs.items()])
            return self._drop(out)
        stats = self.df.groupBy(*self.keys).agg(*[a.alias(n) for n, a in aggs.items()])
        return self.join_stats(stats, salt)

    # ---- exact quantiles
    def quantiles(self, value: str, probs: dict[str, float]) -> DataFrame:
        """Exact linear-interpolation quantiles per key, NULL values ignored."""

        def plain(df: DataFrame) -> DataFrame:
            picks = [F.percentile(value, F.lit(float(p))).alias(n) for n, p in probs.items()]
            return df.groupBy(*self.keys).agg(*picks)

        if self.big is None:
            return self._drop(plain(self.df))
        names = self.big.select(*self.keys)
        usual = plain(self.df.join(small(names), self.keys, "left_anti"))
        counts = (
            self.df.join(small(names), self.keys, "left_semi")
            .filter(F.col(value).isNotNull())
            .groupBy(*self.keys, value)
            .agg(F.count(F.lit(1)).alias("__c"))
        )
        counts = cut(counts)
        total = cut(counts.groupBy(*self.keys).agg(F.sum("__c").alias("__t")))
        run = Ordered(counts, self.keys, [value], self.limit).prefix({"__upto": F.col("__c")})
        run = self._keyed(run).join(small(total), self.keys)

        def at(rank: Column) -> Column:
            hit = (F.col("__upto") - F.col("__c") <= rank) & (rank < F.col("__upto"))
            return F.max(F.when(hit, F.col(value)))

        picks = []
        for name, p in probs.items():
            spot = (F.col("__t") - 1) * F.lit(float(p))
            low, high = at(F.floor(spot)), at(F.ceil(spot))
            part = F.max(spot - F.floor(spot))
            picks.append((low + (high - low) * part).cast("double").alias(name))
        return self._drop(usual.unionByName(run.groupBy(*self.keys).agg(*picks)))

    def with_quantiles(self, value: str, probs: dict[str, float], salt: list[str]) -> DataFrame:
        if self.big is None:
            over = Window.partitionBy(*self.keys)
            picks = [F.percentile(value, F.lit(float(p))).over(over).alias(n) for n, p in probs.items()]
            return self._drop(self.df.select("*", *picks))
        return self.join_stats(self.quantiles(value, probs), salt)


class Ordered(Grouped):
    """``Grouped`` rows with a total order inside each key ('-name' sorts descending).

    Sort columns must not be NULL.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], limit: int | None = None):
        super().__init__(df, keys, limit)
        self.order = order
        self.pieced = self._pieces() if self.big is not None else None

    def on(self, df: DataFrame):
        twin = super().on(df)
        if self.pieced is not None:
            twin.pieced = twin._pieces()
        return twin

    def _pieces(self) -> DataFrame:
        """Oversized keys dealt into ranges of the sort columns, each a piece; all other keys are piece -1.

        Ranges work for every type and any number of pieces. Rows that tie on all sort columns are dealt by a hash of
        the whole row, so that many of them need not be one piece.
        """
        names = self.big.select(*self.keys)
        rest = matched(self.df, names, self.keys, "left_anti").withColumn(PIECE, F.lit(-1))
        large = matched(self.df, names, self.keys, "left_semi")
        rows = self.big.agg(F.sum("__n")).first()[0]
        pieces = max(2, 2 * math.ceil(rows / self.limit))
        flat = [f.name for f in self.df.schema.fields if not isinstance(f.dataType, T.MapType)]
        order = [*[F.col(k) for k in self.keys], *sort_columns(self.order), F.xxhash64(*flat)]
        ranged = large.repartitionByRange(pieces, *order).withColumn(PIECE, F.spark_partition_id())
        return rest.unionByName(cut(ranged))

    def _window(self):
        if self.pieced is None:
            return Window.partitionBy(*self.keys).orderBy(*sort_columns(self.order))
        return Window.partitionBy(*self.keys, PIECE).orderBy(*sort_columns(self.order))

    def _carried(self, totals: dict[str, Column], merge) -> DataFrame:
        """Per-piece totals of oversized keys, combined over the earlier pieces."""
        names = self.big.select(*self.keys)
        per = (
            matched(self.pieced, names, self.keys, "left_semi")
            .groupBy(*self.keys, PIECE)
            .agg(*[c.alias(n) for n, c in totals.items()])
        )
        before = (
            Window.partitionBy(*self.keys).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
        )
        # a few rows per rows/limit, written once
        return cut(per.select(*self.keys, PIECE, *[merge(n).over(before).alias(n) for n in totals]))

    def prefix(self, sums: dict[str, Column]) -> DataFrame:
        """Running totals including the current row."""
        run = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if self.pieced is None:
            return self._drop(self.df.select("*", *[F.sum(c).over(run).alias(n) for n, c in sums.items()]))
        base = self._carried({f"__b_{n}": F.sum(c) for n, c in sums.items()}, F.sum)
        rows = self.pieced.select("*", *[F.sum(c).over(run).alias(f"__l_{n}") for n, c in sums.items()])
        out = matched(rows, base, [*self.keys, PIECE], "left")
        for n in sums:
            out = out.withColumn(n, F.col(f"__l_{n}") + F.coalesce(F.col(f"__b_{n}"), F.lit(0)))
            out = out.drop(f"__l_{n}", f"__b_{n}")
        return self._drop(out)

    def position(self, name: str = "pos") -> DataFrame:
        """0-based place of each row in its key."""
        if self.pieced is None:
            out = self.df.withColumn(name, (F.row_number().over(self._window()) - 1).cast("long"))
            return self._drop(out)
        return self.prefix({name: F.lit(1).cast("long")}).withColumn(name, F.col(name) - 1)

    def carry(self, value: str, name: str) -> DataFrame:
        """Latest non-NULL value at or before the current row."""
        run = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        last = F.last(value, ignorenulls=True).over(run)
        if self.pieced is None:
            return self._drop(self.df.withColumn(name, last))
        order = F.struct(*[F.col(o) for o in self.order if not o.startswith("-")])
        if any(o.startswith("-") for o in self.order):
            raise ValueError("carry needs ascending sort columns")
        newest = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), order))
        base = self._carried({"__b": newest}, lambda n: F.last(n, ignorenulls=True))
        out = matched(self.pieced.withColumn("__l", last), base, [*self.keys, PIECE], "left")
        return self._drop(out.withColumn(name, F.coalesce("__l", "__b")).drop("__l", "__b"))

    def neighbours(self, picks: dict[str, tuple[str, int]]) -> DataFrame:
        """Values of nearby rows: name -> (column, offset), offset -1 is the row before."""

        def shifted(over) -> list[Column]:
            return [
                (F.lag(c, -k) if k < 0 else F.lead(c, k)).over(over).alias(n)
                for n, (c, k) in picks.items()
            ]

        if self.pieced is None:
            return self._drop(self.df.select("*", *shifted(self._window())))
        reach = max(abs(k) for _, k in picks.values())
        rows = self.position("__pos")
        if self.keys == [ALL]:
            rows = rows.withColumn(ALL, F.lit(0))
        # equal slices by place; rows near a border also visit the neighbouring slice
        slot = F.floor(F.col("__pos") / self.limit)
        rest = F.pmod(F.col("__pos"), F.lit(self.limit))
        visits = F.array_compact(
            F.array(
                slot,
                F.when((rest < reach) & (slot > 0), slot - 1),
                F.when(rest >= self.limit - reach, slot + 1),
            )
        )
        over = Window.partitionBy(*self.keys, "__slot").orderBy("__pos")
        out = rows.withColumn("__home", slot).withColumn("__slot", F.explode(visits))
        out = out.select("*", *shifted(over)).filter("__slot = __home")
        return self._drop(out.drop("__slot", "__home", "__pos"))
