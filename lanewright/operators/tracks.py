"""Operators over track points: a row per point, with the columns of its task, its place and lon, lat."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewright.functions.geo import haversine_m, in_box


def lengths(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Points and length (metres, the sum of the ways between neighbours) of each track."""
    before = Window.partitionBy(*keys).orderBy(order)
    step = haversine_m(F.lag("lon").over(before), F.lag("lat").over(before), F.col("lon"), F.col("lat"))
    return points.select(*keys, step.alias("step_m")).groupBy(*keys).agg(F.count("*").alias("points"), F.coalesce(F.sum("step_m"), F.lit(0.0)).alias("length_m"))


def boxes(points: DataFrame, keys: list[str], margin: float = 0.0) -> DataFrame:
    """South, west, north, east of each track's points, widened by a margin in degrees."""
    return points.groupBy(*keys).agg(
        (F.min("lat") - margin).alias("south"), (F.min("lon") - margin).alias("west"), (F.max("lat") + margin).alias("north"), (F.max("lon") + margin).alias("east"),
    )


def top_speeds(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points and largest speed of each track, over points with coordinates and a speed; null where there is none."""
    return points.groupBy(*keys).agg(F.count("*").alias("raw_count"), F.max(F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.col("speed"))).alias("max_speed"))


def ends(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First and last point of each track."""
    at = lambda pick, c: pick(c, order)
    return points.groupBy(*keys).agg(
        at(F.min_by, "lon").alias("origin_lon"), at(F.min_by, "lat").alias("origin_lat"), at(F.max_by, "lon").alias("destination_lon"), at(F.max_by, "lat").alias("destination_lat"),
    )


def as_arrays(points: DataFrame, keys: list[str], order: str, columns: tuple[str, ...] = ("lon", "lat")) -> DataFrame:
    """A row per track, its points an array of structs in order."""
    return points.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("points"))


def inside(points: DataFrame, box: DataFrame, keys: list[str]) -> DataFrame:
    """The points that lie in the box of their own key, borders included."""
    joined = points.join(box, keys)
    return joined.filter(in_box(F.col("lon"), F.col("lat"), F.col("south"), F.col("west"), F.col("north"), F.col("east"))).select(points.columns)


def first_match(tasks: DataFrame, order: list[str]) -> DataFrame:
    """The first task of each (sn, task_id) in the order of files and places within them."""
    rest = [c for c in tasks.columns if c not in ("sn", "task_id")]
    return tasks.groupBy("sn", "task_id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")).select("sn", "task_id", "_first.*")
