"""Square grids of many levels: cells of step, 2 step, 4 step and so on, in degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 26  # of a step of 1e-5 degrees, the last covers the globe


def level_of(extent: Column, step: float) -> Column:
    """The lowest level whose cells are no smaller than an extent, so that it lies in two of them at most on an axis."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent / step, F.lit(1.0))))).cast("int")


def cell_of(degrees: Column, level: Column, step: float) -> Column:
    return F.floor(degrees / (F.pow(F.lit(2.0), level) * step)).cast("long")


def met_levels(posted: DataFrame) -> list[int]:
    """The levels that rows stand on: LEVELS numbers at most, over steps of 1e-5 degrees or more."""
    return sorted(r["level"] for r in posted.select("level").distinct().collect() if r["level"] is not None)


def levels(used: list[int]) -> Column:
    return F.array(*[F.lit(x) for x in used]).cast("array<int>")
