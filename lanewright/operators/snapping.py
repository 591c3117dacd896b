"""Points projected on lanes, and each point's nearest lanes.

A point first looks around in the cells within LOOK_DEG. Points whose k-th lane isn't settled by that go down a pyramid of cells: from
the few cells that cover the network to ever smaller ones, leaving out at each step those that are farther than k lanes are
known to be. So a stray point meets the segments of a few small cells, however far off it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewright.functions.arrays import hops_m, let, places, running
from lanewright.functions.geo import haversine_m, planar_x_m, planar_y_m
from lanewright.operators.grids import cell_of, level_of, levels, met_levels
from lanewright.operators.network import DEGREE_M
from lanewright.settings import EARTH_RADIUS_M
from lanewright.storage import written

GRID_DEG = 0.002
LOOK_DEG = 0.003
ACROSS = 4  # cells that cover the network on an axis at the top of the pyramid, one more at most
ALL_LEVELS = 24  # of two each: the largest cell is wider than the globe


def segments(lanes: DataFrame) -> DataFrame:
    """uid, lane_ord, segment_index (from 0), a, b, hop_m, before_m (the way to a), single, lane_length_m: a one-point lane is
    a segment of itself. Ways are running sums of a lane's own array: nothing is shuffled."""
    points = F.col("points")

    def pieces(hops: Column) -> Column:
        one = lambda way, i: F.struct(F.get(points, i).alias("a"), F.coalesce(F.get(points, i + 1), F.get(points, i)).alias("b"), F.coalesce(F.get(hops, i + 1), F.lit(0.0)).alias("hop_m"), F.get(way, i).alias("before_m"))
        return let(running(hops), lambda way: F.transform(places(F.greatest(F.size(points) - 1, F.lit(1))), lambda i: one(way, i)))

    rows = lanes.filter(F.size("points") > 0).select("uid", "lane_ord", F.col("length_m").alias("lane_length_m"), (F.size("points") == 1).alias("single"), F.posexplode(let(hops_m(points), pieces)).alias("segment_index", "s"))
    return rows.select("uid", "lane_ord", "segment_index", "s.a", "s.b", "single", "lane_length_m", "s.hop_m", "s.before_m")


def projection(lon: Column, lat: Column) -> dict[str, Column]:
    """Of a point on the segment a-b: place on it, distance in the plane about the point, and way along the lane."""
    a, b = F.col("a"), F.col("b")
    ax, ay = planar_x_m(a["lon"], lon, lat), planar_y_m(a["lat"], lat)
    bx, by = planar_x_m(b["lon"], lon, lat), planar_y_m(b["lat"], lat)
    square = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    ratio = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * (bx - ax) + ay * (by - ay)) / F.nullif(square, F.lit(0.0))))).otherwise(F.lit(0.0))
    x, y = ax + (bx - ax) * ratio, ay + (by - ay) * ratio
    return {"ratio": ratio, "snap_dist_m": F.sqrt(x * x + y * y)}


def measured(pairs: DataFrame) -> DataFrame:
    """Rows of a point (lon, lat) and a segment, with the projection's distance, offset and point."""
    rows = pairs.withColumns(projection(F.col("lon"), F.col("lat")))
    offset = F.col("before_m") + F.col("hop_m") * F.col("ratio")
    return rows.withColumns({
        "snap_dist_m": F.when(F.col("single"), haversine_m(F.col("lon"), F.col("lat"), F.col("a.lon"), F.col("a.lat"))).otherwise(F.col("snap_dist_m")),
        "offset_m": offset,
        "remain_m": F.greatest(F.lit(0.0), F.col("lane_length_m") - offset),
        "projected_lon": F.col("a.lon") + (F.col("b.lon") - F.col("a.lon")) * F.col("ratio"),
        "projected_lat": F.col("a.lat") + (F.col("b.lat") - F.col("a.lat")) * F.col("ratio"),
    })


RESULT = ("snap_dist_m", "offset_m", "remain_m", "projected_lon", "projected_lat", "segment_index", "lane_length_m")


def project(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Of each (keys, uid) the nearest segment, the first of equally near ones."""
    best = F.min_by(F.struct(*RESULT), F.struct("snap_dist_m", "segment_index"))
    return measured(pairs).groupBy(*keys, "uid", "lane_ord").agg(best.alias("p")).select(*keys, "uid", "lane_ord", "p.*")


def even(level: Column) -> Column:
    return level + level % 2


def posted(parts: DataFrame) -> DataFrame:
    """Segments in the cells they touch, of the even level whose cells are no smaller than they are: four cells each at most."""
    extent = F.greatest(F.abs(F.col("a.lon") - F.col("b.lon")), F.abs(F.col("a.lat") - F.col("b.lat")))
    rows = parts.withColumn("level", even(level_of(extent, GRID_DEG)))
    for name, axis in (("x", "lon"), ("y", "lat")):
        low, high = F.least(f"a.{axis}", f"b.{axis}"), F.greatest(f"a.{axis}", f"b.{axis}")
        rows = rows.withColumn(name, F.explode(F.sequence(cell_of(low, F.col("level"), GRID_DEG), cell_of(high, F.col("level"), GRID_DEG))))
    return rows


def looks(points: DataFrame, reach: float, used: list[int]) -> DataFrame:
    """Points in the cells that the square of their reach touches, on every level in use."""
    rows = points.select("*", F.explode(levels(used)).alias("level"))
    for name, axis in (("x", "lon"), ("y", "lat")):
        rows = rows.withColumn(name, F.explode(F.sequence(cell_of(F.col(axis) - reach, F.col("level"), GRID_DEG), cell_of(F.col(axis) + reach, F.col("level"), GRID_DEG))))
    return rows


CELL = ["level", "x", "y", "single"]


def pyramid(of_lanes: DataFrame) -> DataFrame:
    """level, x, y, single, lanes: the cells that hold segments at their own or a lower level, and how many lanes begin in them; lanes
    of one point, which are measured on the globe and not in the plane, have cells of their own."""
    own = of_lanes.groupBy(*CELL).agg(F.lit(0).cast("long").alias("lanes"))
    first = of_lanes.filter("segment_index = 0").select("uid", "single", F.col("a.lon").alias("lon"), F.col("a.lat").alias("lat")).distinct()
    begins = first.select(F.lit(0).alias("level"), *(cell_of(F.col(c), F.lit(0), GRID_DEG).alias(n) for n, c in (("x", "lon"), ("y", "lat"))), "single").groupBy(*CELL).agg(F.count("*").alias("lanes"))
    up = F.explode(F.transform(F.sequence(F.lit(0), F.lit(ALL_LEVELS), F.lit(2)), lambda n: F.col("level") + n)).alias("_up")
    raised = own.unionByName(begins).select("*", up).filter(F.col("_up") <= ALL_LEVELS)
    by = lambda c: F.expr(f"shiftright({c}, _up - level)").alias(c)
    return raised.select(F.col("_up").alias("level"), by("x"), by("y"), "single", "lanes").groupBy(*CELL).agg(F.sum("lanes").alias("lanes"))


def spans(level: int) -> tuple[Column, Column]:
    """Least and largest distance of a point (lon, lat) from a cell (x, y), in the plane about the point."""
    width = GRID_DEG * 2.0**level
    near, far = [], []
    for name, axis, scale in (("x", "lon", DEGREE_M * F.cos(F.radians("lat"))), ("y", "lat", F.lit(DEGREE_M))):
        low, high = F.col(name) * width - F.col(axis), (F.col(name) + 1) * width - F.col(axis)
        near.append(F.greatest(low, -high, F.lit(0.0)) * scale)
        far.append(F.greatest(F.abs(low), F.abs(high)) * scale)
    return tuple(F.sqrt(a * a + b * b) for a, b in (near, far))


def round_spans(level: int) -> tuple[Column, Column]:
    """Bounds of the great-circle distance of a point from a cell, whatever way around the globe: of each term the least and the most."""
    width = GRID_DEG * 2.0**level
    low, high = F.greatest(F.lit(-90.0), F.col("y") * width), F.least(F.lit(90.0), (F.col("y") + 1) * width)
    d_lat = F.greatest(low - F.col("lat"), F.col("lat") - high, F.lit(0.0)), F.greatest(F.abs(low - F.col("lat")), F.abs(high - F.col("lat")))
    middle = (F.col("x") + 0.5) * width - F.col("lon")
    off = F.abs(middle - 360.0 * F.round(middle / 360.0))
    d_lon = F.greatest(off - width / 2, F.lit(0.0)), F.least(off + width / 2, F.lit(180.0))
    cos = F.least(F.cos(F.radians(low)), F.cos(F.radians(high))), F.when((low <= 0) & (high >= 0), F.lit(1.0)).otherwise(F.greatest(F.cos(F.radians(low)), F.cos(F.radians(high))))
    half = lambda degrees: F.pow(F.sin(F.radians(degrees) / 2), 2)
    h = [half(d_lat[i]) + F.cos(F.radians("lat")) * F.greatest(F.lit(0.0), cos[i]) * half(d_lon[i]) for i in (0, 1)]
    return tuple(F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), x))) for x in h)


def descended(points: DataFrame, of_lanes: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys, lon, lat, level, x, y, single: the cells in which the k nearest lanes of each point can have segments.

    At each level a point's cells are put in order of their largest distance; as soon as k lanes begin in those so far, no
    farther cell is of use.
    """
    cells = written(pyramid(of_lanes), "cells")
    low, high = (of_lanes.agg(*(pick(side(f"a.{c}", f"b.{c}")) for c in ("lon", "lat")), F.max("level")).first() for pick, side in ((F.min, F.least), (F.max, F.greatest)))
    top = next((n for n in range(high[2], ALL_LEVELS, 2) if GRID_DEG * 2**n * ACROSS >= max(high[i] - low[i] for i in (0, 1))), ALL_LEVELS)
    some = cells.filter(F.col("level") == top).collect()  # 2 (ACROSS + 1)^2 at most
    roots = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("x", "y", "single", "lanes")]) for r in some])
    at = points.select(*keys, "lon", "lat", F.lit(float("inf")).alias("bound"), F.explode(roots).alias("c")).select(*keys, "lon", "lat", "bound", "c.*")
    point, visited = [*keys, "lon", "lat"], []
    in_order = Window.partitionBy(*keys).orderBy("far", "x", "y", "single").rowsBetween(Window.unboundedPreceding, 0)
    for level in range(top, -1, -2):
        near, far = (F.when(F.col("single"), r).otherwise(s) for r, s in zip(round_spans(level), spans(level), strict=True))
        rows = at.withColumns({"near": near * (1 - 1e-9) - 1e-6, "far": far * (1 + 1e-9) + 1e-6})
        enough = F.min(F.when(F.col("_so_far") >= k, F.col("far"))).over(Window.partitionBy(*keys))
        rows = rows.withColumn("_so_far", F.sum("lanes").over(in_order)).withColumn("bound", F.least("bound", F.coalesce(enough, F.lit(float("inf")))))
        rows = written(rows.filter("near <= bound").select(*point, "bound", "x", "y", "single"), "descent")
        visited.append(rows.select(*point, F.lit(level).alias("level"), "x", "y", "single"))
        if level:
            below = cells.filter(F.col("level") == level - 2).select(F.shiftright("x", 2).alias("_px"), F.shiftright("y", 2).alias("_py"), "x", "y", "single", "lanes")
            at = rows.withColumnsRenamed({"x": "_px", "y": "_py"}).join(below, ["_px", "_py", "single"]).select(*point, "bound", "x", "y", "single", "lanes")
    out = visited[0]
    for more in visited[1:]:
        out = out.unionByName(more)
    return out


def nearest_lanes(points: DataFrame, lanes: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """The k nearest lanes of each point (keys, lon, lat), ranked from 1 by distance, then by lane order.

    A point meets the segments in cells within LOOK_DEG and is settled when its k-th lane is nearer than anything beyond can be; the
    others go down the pyramid. Every point gets min(k, lanes) rows. lanes has uid, lane_ord, points and length_m; lanes without
    points are near to nothing.
    """
    parts = written(posted(segments(lanes)), "segments")
    k = min(k, lanes.filter(F.size("points") > 0).count())
    points = points.select(*keys, "lon", "lat")
    ranking = Window.partitionBy(*keys).orderBy("snap_dist_m", "lane_ord")

    def ranked(cells: DataFrame, on: list[str]) -> DataFrame:
        near = project(cells.join(parts, on).drop("level", "x", "y"), [*keys, "lon", "lat"])
        return written(near.withColumn("rank", F.row_number().over(ranking).cast("long")).filter(F.col("rank") <= k), "near")

    near = ranked(looks(points, LOOK_DEG, met_levels(parts)), CELL[:3])
    sure = F.lit(0.999 * LOOK_DEG * DEGREE_M) * F.cos(F.radians(F.least(F.lit(90.0), F.abs("lat") + LOOK_DEG)))
    settled = near.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(F.col("snap_dist_m") - sure).alias("_over")).filter((F.col("_n") == k) & (F.col("_over") < 0)).select(*keys)
    left = written(points.join(settled, keys, "left_anti"), "unsettled")
    if k == 0 or left.isEmpty():
        return near
    return near.join(settled, keys, "left_semi").unionByName(ranked(descended(left, parts, keys, k), CELL))
