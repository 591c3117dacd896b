"""Routes for many tasks at once: candidates, their metrics, the best, its drawn geometry and the summary."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.functions.arrays import clip_polyline
from lanewright.functions.geo import between_points_m
from lanewright.operators.paths import paths
from lanewright.operators.snapping import nearest_lanes
from lanewright.settings import DEFAULT, Settings
from lanewright.storage import written


PLACES = ["origin_lon", "origin_lat", "destination_lon", "destination_lat"]


def once_a_trip(ends: DataFrame, keys: list[str], of: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """of(trips, its key) over the distinct pairs of places, its rows given to every task (keys) of a trip: tasks that start and end
    at the same places have the same candidates and routes."""
    ends = written(ends.select(*keys, *PLACES), "ends")
    trips = written(ends.select(*PLACES).distinct().withColumn("_trip", F.monotonically_increasing_id()), "trips")
    rows = written(of(trips, ["_trip"]), "trip-rows")
    named = trips.withColumnsRenamed({c: f"_{c}" for c in PLACES})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PLACES))
    return ends.join(named, same).select(*keys, "_trip").join(rows, "_trip").drop("_trip")


def candidates(ends: DataFrame, lanes: DataFrame, keys: list[str], settings: Settings = DEFAULT) -> DataFrame:
    """Every nearest lane of a task's origin with every nearest lane of its destination, with both projections."""
    sides = F.explode(F.array(*[F.struct(F.lit(s[0]).alias("_side"), F.col(f"{s}_lon").alias("lon"), F.col(f"{s}_lat").alias("lat")) for s in ("origin", "destination")])).alias("_end")
    found = nearest_lanes(ends.select(*keys, sides).select(*keys, "_end.*"), lanes, [*keys, "_side"], settings.snap_candidates)
    projected = F.struct("snap_dist_m", "offset_m", "remain_m", "projected_lon", "projected_lat", "segment_index", "lane_length_m")
    near = {s: found.filter(F.col("_side") == s).select(*keys, F.col("uid").alias(f"{s}_uid"), F.col("rank").alias(f"{s}_rank"), projected.alias(f"{s}_proj")) for s in "od"}
    return near["o"].join(near["d"], keys)


def jumps(edges: DataFrame, links: DataFrame, lanes: DataFrame) -> DataFrame:
    """src, dst, jump_m of edges of the network: nothing between linked lanes however far apart, else the gap."""
    ends = lanes.select(F.col("uid").alias("src"), "end_point")
    starts = lanes.select(F.col("uid").alias("dst"), "start_point")
    linked = links.select("src", "dst", F.lit(True).alias("linked")).distinct()
    rows = edges.select("src", "dst").join(ends, "src").join(starts, "dst").join(linked, ["src", "dst"], "left")
    return rows.select("src", "dst", F.when(F.col("linked"), F.lit(0.0)).otherwise(between_points_m(F.col("end_point"), F.col("start_point"))).alias("jump_m"))


def hops(ways: DataFrame) -> DataFrame:
    """src, dst of every two lanes that follow each other on a path."""
    pairs = F.transform(F.slice("path", F.lit(2), F.size("path")), lambda v, i: F.struct(F.get("path", i).alias("src"), v.alias("dst")))
    return ways.select(F.explode(pairs).alias("hop")).select("hop.src", "hop.dst").distinct()


def metrics(found: DataFrame, ways: DataFrame, lanes: DataFrame, jump: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The candidates that have a way, with lane_m, jump_m, snap_m, total_m, objective_m.

    On one lane the destination must not lie before the origin. Lengths are added in the order of the path.
    """
    steps = ways.select("src", "dst", F.posexplode("path").alias("pos", "uid"), F.size("path").alias("n"))
    middle = steps.filter((F.col("pos") > 0) & (F.col("pos") < F.col("n") - 1)).join(lanes.select("uid", "length_m"), "uid").select("src", "dst", "pos", "length_m")
    hops = ways.select("src", "dst", F.posexplode(F.transform(F.slice("path", F.lit(2), F.size("path")), lambda v, i: F.struct(F.get("path", i).alias("u"), v.alias("v")))).alias("pos", "hop"))
    gaps = hops.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), "pos", F.col("hop.u").alias("src"), F.col("hop.v").alias("dst")).join(jump, ["src", "dst"]).select(F.col("_s").alias("src"), F.col("_d").alias("dst"), "pos", "jump_m")
    add = lambda column: F.aggregate(F.sort_array(F.collect_list(F.struct("pos", column))), F.lit(0.0), lambda t, x: t + x[column])
    through = ways.join(middle.groupBy("src", "dst").agg(add("length_m").alias("middle_m")), ["src", "dst"], "left").join(gaps.groupBy("src", "dst").agg(add("jump_m").alias("jump_m")), ["src", "dst"], "left")
    rows = found.join(through.withColumnsRenamed({"src": "o_uid", "dst": "d_uid"}), ["o_uid", "d_uid"])
    along = F.col("d_proj.offset_m") - F.col("o_proj.offset_m")
    lane = F.when(F.size("path") == 1, along).otherwise(F.col("o_proj.remain_m") + F.coalesce("middle_m", F.lit(0.0)) + F.col("d_proj.offset_m"))
    rows = rows.filter((F.size("path") > 1) | (along >= 0)).withColumns({"lane_m": lane, "jump_m": F.coalesce("jump_m", F.lit(0.0)), "snap_m": F.col("o_proj.snap_dist_m") + F.col("d_proj.snap_dist_m")}).drop("middle_m")
    return rows.withColumns({
        "total_m": F.col("lane_m") + F.col("jump_m") + F.col("snap_m"),
        "objective_m": F.col("lane_m") + F.col("jump_m") * settings.jump_penalty + F.col("snap_m") * settings.snap_penalty,
    })


def best(measured: DataFrame, keys: list[str]) -> DataFrame:
    """Each task's candidate of least objective, then least origin rank, then least destination rank; tried_count of all."""
    rest = [c for c in measured.columns if c not in keys]
    chosen = F.min_by(F.struct(*rest), F.struct("objective_m", "o_rank", "d_rank"))
    return measured.groupBy(*keys).agg(chosen.alias("_best"), F.count("*").alias("tried_count")).select(*keys, "_best.*", "tried_count")


def tried(ends: DataFrame, lanes: DataFrame, links: DataFrame, edges: DataFrame, keys: list[str], settings: Settings = DEFAULT) -> DataFrame:
    """metrics() of all candidates of every task. Ways are searched once for each pair of lanes, however many tasks ask."""
    found = written(candidates(ends, lanes, keys, settings), "candidates")
    ways = written(paths(edges, found.select(F.col("o_uid").alias("src"), F.col("d_uid").alias("dst")).distinct()), "paths")
    return metrics(found, ways, lanes, jumps(hops(ways), links, lanes), settings)


def plan(ends: DataFrame, lanes: DataFrame, links: DataFrame, edges: DataFrame, keys: list[str], settings: Settings = DEFAULT) -> DataFrame:
    """The best route of every task that has one."""
    return once_a_trip(ends, keys, lambda trips, key: best(tried(trips, lanes, links, edges, key, settings), key))


def summary(planned: DataFrame, tracks: DataFrame, keys: list[str]) -> DataFrame:
    """Driven against planned: tracks has history_point_count and history_distance_m of each task."""
    return planned.join(tracks, keys).select(
        *keys, "history_point_count", "history_distance_m", F.col("total_m").alias("planned_distance_m"), (F.col("history_distance_m") - F.col("total_m")).alias("distance_difference_m"),
        F.col("o_uid").alias("start_lane_uid"), F.col("d_uid").alias("end_lane_uid"), F.size("path").cast("long").alias("planned_lane_count"), F.col("path").alias("planned_lane_uids"),
        "tried_count", "objective_m", F.col("snap_m").alias("snap_distance_m"), F.col("jump_m").alias("jump_distance_m"),
    )


def visible(planned: DataFrame, lanes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, uid, points: the drawn part of every lane of the planned path, from its start to its end."""
    rows = planned.select(*keys, "o_proj", "d_proj", F.size("path").alias("n"), F.posexplode("path").alias("pos", "uid")).join(lanes.select("uid", "points", "length_m"), "uid")
    first, last = F.col("pos") == 0, F.col("pos") == F.col("n") - 1
    start, end = F.when(first, F.col("o_proj.offset_m")).otherwise(F.lit(0.0)), F.when(last, F.col("d_proj.offset_m")).otherwise(F.col("length_m"))
    return rows.select(*keys, "pos", "uid", F.when(first | last, clip_polyline(F.col("points"), start, end)).otherwise(F.col("points")).alias("points"))


def visible_line(parts: DataFrame, keys: list[str]) -> DataFrame:
    """All drawn points of each task in order; joints stay doubled."""
    return parts.groupBy(*keys).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "points"))), lambda x: x["points"])).alias("points"))
