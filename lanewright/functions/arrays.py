"""Samplers, consecutive deduplication, running ways, clipping and interpolation of ordered points held in an array.

All are column expressions: nothing leaves the JVM. An array that is looked at again and again is bound once, by let().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewright.functions.geo import between_points_m

POINTS = "array<struct<lon:double,lat:double,z:double,timestamp:string>>"
SAME_DEG = 1e-12
SHORTEST_M = 1e-9  # segments no longer than that are passed over when a place is looked up
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once (a one-element transform binds it)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def places(n: Column, first: int = 0) -> Column:
    """first, first + 1, ... up to n - 1; none where n is no larger than first."""
    return F.when(n > first, F.sequence(F.lit(first), n - 1)).otherwise(F.array().cast("array<int>"))


def sample_even(items: Column, most: int) -> Column:
    """At most `most` items at evenly spread places, both ends among them; all where there are no more, one for most <= 1.

    Places are multiples of one step, rounded half to even, and each is taken once.
    """
    n = F.size(items)
    if most <= 1:
        return F.when(n > 0, F.slice(items, 1, 1)).otherwise(items)
    step = (n - 1) / F.lit(float(most - 1))
    places = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i.cast("double") * step).cast("int"))
    return F.when(n <= most, items).otherwise(F.transform(F.array_distinct(places), lambda i: F.get(items, i)))


def sample_stride(items: Column, most: int) -> Column:
    """Every ceil(n / most)-th item, and the last one where its value isn't that of the last taken."""
    n = F.size(items)
    stride = F.greatest(F.lit(1), F.ceil(n / F.lit(float(most)))).cast("int")
    taken = F.filter(items, lambda _, i: i % stride == 0)
    whole = F.when(F.element_at(taken, -1).eqNullSafe(F.element_at(items, -1)), taken).otherwise(F.concat(taken, F.slice(items, -1, 1)))
    return F.when(n <= most, items).otherwise(whole)


def differ(a: Column, b: Column) -> Column:
    return (F.abs(a["lon"] - b["lon"]) >= SAME_DEG) | (F.abs(a["lat"] - b["lat"]) >= SAME_DEG)


def dedup_consecutive(points: Column) -> Column:
    """The points without those equal to the last one kept (not merely to the one before them).

    Both are the same unless points creep on by less than SAME_DEG at a time without standing still. Only arrays in which some do
    are walked along point by point.
    """

    def walked(all_: Column) -> Column:
        none = F.struct(F.array().cast("array<int>").alias("kept"), F.lit(None).cast("int").alias("last"))
        step = lambda acc, i: F.when(acc["last"].isNull() | differ(F.get(all_, i), F.get(all_, acc["last"])), F.struct(F.concat(acc["kept"], F.array(i)).alias("kept"), i.alias("last"))).otherwise(acc)
        return F.transform(F.aggregate(places(F.size(all_)), none, step, lambda acc: acc["kept"]), lambda i: F.get(all_, i))

    def kept(all_: Column) -> Column:
        moved = lambda p, i: (i == 0) | differ(p, F.get(all_, i - 1))
        before = lambda i: F.get(all_, i - 1)
        creeps = F.exists(places(F.size(all_), 1), lambda i: ~differ(F.get(all_, i), before(i)) & ((F.get(all_, i)["lon"] != before(i)["lon"]) | (F.get(all_, i)["lat"] != before(i)["lat"])))
        return F.when(creeps, walked(all_)).otherwise(F.filter(all_, moved))

    return F.when(points.isNotNull(), let(points, kept))


def hops_m(points: Column) -> Column:
    """The way to each point from the one before it, 0 to the first."""
    return F.transform(points, lambda p, i: F.when(i == 0, F.lit(0.0)).otherwise(between_points_m(F.get(points, i - 1), p)))


def running(values: Column) -> Column:
    """The sum up to each value, that one included. Sums of blocks first, so an array of n takes about n x BLOCK additions."""
    add = lambda total, x: total + x
    sums = lambda of: F.transform(of, lambda x, i: F.aggregate(F.slice(of, 1, i + 1), F.lit(0.0), add))
    inside = lambda all_, j: F.slice(all_, j * BLOCK + 1, F.lit(BLOCK))

    def blocks(all_: Column) -> Column:
        numbers = places(F.ceil(F.size(all_) / F.lit(float(BLOCK))).cast("int"))
        whole = F.transform(numbers, lambda j: F.aggregate(inside(all_, j), F.lit(0.0), add))
        part = lambda before, j: F.transform(let(inside(all_, j), sums), lambda x: x + F.when(j > 0, F.get(before, j - 1)).otherwise(F.lit(0.0)))
        return let(let(whole, sums), lambda before: F.flatten(F.transform(numbers, lambda j: part(before, j))))

    return F.when(values.isNotNull(), let(values, blocks))


def running_m(points: Column) -> Column:
    """The way to each point along the line."""
    return running(let(points, hops_m))


def on_line(points: Column, way: Column, offset: Column) -> Column:
    """The point at an offset within the line: on the first segment that reaches it and has a length; else the last point.
    z only where both ends have one."""
    i = F.get(F.filter(places(F.size(points), 1), lambda i: (F.get(way, i) - F.get(way, i - 1) > SHORTEST_M) & (F.get(way, i) >= offset)), F.lit(0))

    def at(i: Column) -> Column:
        a, b, before = F.get(points, i - 1), F.get(points, i), F.get(way, i - 1)
        ratio = (offset - before) / (F.get(way, i) - before)
        between = lambda c: (a[c] + (b[c] - a[c]) * ratio).alias(c)
        return F.struct(between("lon"), between("lat"), between("z"), F.lit(None).cast("string").alias("timestamp"))

    return let(i, lambda i: F.when(i.isNotNull(), at(i)).otherwise(F.element_at(points, -1)))


def within(offset: Column, way: Column) -> Column:
    """The offset cut to the ends of the line."""
    return F.least(F.greatest(F.lit(0.0), offset.cast("double")), F.element_at(way, -1))


def with_way(points: Column, body: Callable[[Column, Column], Column]) -> Column:
    """body(points, way to each) where there are points, else null."""
    return F.when(F.size(points) > 0, let(points, lambda p: let(running_m(p), lambda way: body(p, way))))


def point_at_offset(points: Column, offset: Column) -> Column:
    """The point at an offset along the line, cut to its ends; null without points or offset."""
    return F.when(offset.isNotNull(), with_way(points, lambda p, way: let(within(offset, way), lambda x: on_line(p, way, x))))


def clip_polyline(points: Column, start: Column, end: Column) -> Column:
    """The line from one offset to another: none where end is before start, one point where they are equal, else both
    ends and the vertices strictly between. Null where one of the three is."""

    def part(p: Column, way: Column, a: Column, b: Column) -> Column:
        first = F.array(on_line(p, way, a))
        vertices = F.filter(p, lambda x, i: (F.get(way, i) > a) & (F.get(way, i) < b))
        line = lambda so_far: let(on_line(p, way, b), lambda last: F.when(differ(F.element_at(so_far, -1), last), F.concat(so_far, F.array(last))).otherwise(so_far))
        whole = F.when(F.abs(b - a) <= 1e-6, first).otherwise(let(F.concat(first, vertices), line))
        return F.when(b < a, F.array().cast(POINTS)).otherwise(whole)

    cut = with_way(points, lambda p, way: let(within(start, way), lambda a: let(within(end, way), lambda b: part(p, way, a, b))))
    return F.when(points.isNotNull() & start.isNotNull() & end.isNotNull(), F.coalesce(cut, F.array().cast(POINTS)))
