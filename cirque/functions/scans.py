"""Running values along a sequence without one task for a sequence: segments are scanned apart, and what earlier ones hold is carried in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bases of a segment.
SPAN = 500_000
SEGMENT = "_segment"


def cut(df: DataFrame, at: Column, span: int = SPAN) -> DataFrame:
    """``df`` with the segment that ``at`` lies in."""
    return df.withColumn(SEGMENT, F.floor(at / span))


def carried(df: DataFrame, place: list[str], values: dict[str, tuple[Callable[[Column | str], Column], Column]], rising: bool = True) -> DataFrame:
    """``df`` with {name}_before, the value over all earlier segments of its place, and {name}_whole, over all of them.

    A value is (F.max, F.min or F.sum, column). It is aggregated for each segment first; only these few rows are put in
    order for each place. Earlier segments are those of lower number, or of higher if not ``rising``.
    """
    per = df.groupBy(*place, SEGMENT).agg(*(f(c).alias(name) for name, (f, c) in values.items()))
    whole = Window.partitionBy(*place)
    before = whole.orderBy(F.col(SEGMENT) if rising else F.col(SEGMENT).desc()).rowsBetween(Window.unboundedPreceding, -1)
    known = per.select(*place, SEGMENT, *(f(name).over(before).alias(f"{name}_before") for name, (f, _) in values.items()), *(f(name).over(whole).alias(f"{name}_whole") for name, (f, _) in values.items()))
    return df.join(known, [*place, SEGMENT])


def inside(place: list[str], *order: Column | str, strict: bool = False):
    """The window of a row's segment up to it, or before it if ``strict``."""
    return Window.partitionBy(*place, SEGMENT).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
