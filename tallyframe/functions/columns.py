"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(col: Column | str) -> Column:
    """Doubles leave the library rounded to six places."""
    return F.round((F.col(col) if isinstance(col, str) else col).cast("double"), 6)


def defined(col: Column | str) -> Column:
    """NaN becomes NULL: NULL is the only 'undefined' inside the library."""
    col = (F.col(col) if isinstance(col, str) else col).cast("double")
    return F.nanvl(col, F.lit(None).cast("double"))


def count_if(cond: Column) -> Column:
    return F.count_if(cond).cast("bigint")


def ratio(num: Column, den: Column) -> Column:
    """Double ratio, NULL over an empty denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def hashed(*parts: Column) -> Column:
    """A reproducible 32-bit number from the joined parts."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def micros(col: Column | str) -> Column:
    """Microseconds since the epoch (session time zone pinned to UTC)."""
    return F.unix_micros((F.col(col) if isinstance(col, str) else col).cast("timestamp"))


def distance(a: list[Column], b: list[Column]) -> Column:
    total = F.lit(0.0)
    for left, right in zip(a, b):
        total = total + (left - right) * (left - right)
    return F.sqrt(total)


def affine(point: list[Column], matrix: list[list[float]], shift: list[float]) -> list[Column]:
    """matrix @ point + shift, written out per axis.

    Sign flips, unit rescales and axis permutations are matrices of this form.
    """
    out = []
    for row, offset in zip(matrix, shift):
        total = F.lit(float(offset))
        for weight, axis in zip(row, point):
            if weight:
                total = total + F.lit(float(weight)) * axis
        out.append(total)
    return out


def penalty(z: Column, threshold: float = 1.5, slope: float = 0.4, floor: float = 0.3) -> Column:
    """Multiplier that falls linearly once z passes the threshold; undefined z costs nothing."""
    cut = F.greatest(F.lit(floor), F.lit(1.0) - (z - F.lit(threshold)) * F.lit(slope))
    return F.when(z > threshold, cut).otherwise(F.lit(1.0))


def first_of(cases: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """Name of the first condition that holds, in the given order of precedence."""
    out = F.lit(otherwise).cast("string")
    for cond, name in reversed(cases):
        out = F.when(cond, F.lit(name)).otherwise(out)
    return out
