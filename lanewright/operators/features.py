"""Batch routes and map features: per-task rows, and the features that a box meets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.functions.arrays import sample_stride
from lanewright.functions.geo import in_box
from lanewright.operators.grids import cell_of, level_of, levels, met_levels
from lanewright.settings import DEFAULT, Settings
from lanewright.storage import written

GRID_DEG = 0.01
FINE_DEG, CUT = 0.001, 4  # least cells of boxes that are counted in; how many cells a box is cut into on an axis, one more at most
SIDES = ["south", "west", "north", "east"]


def task_routes(tasks: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Of each task with two points or more: raw_count, max_speed, and the points by stride. Repeats are kept."""
    rows = tasks.filter(F.size("points") >= 2)
    speed = F.array_max(F.filter(F.transform("points", lambda p: p["speed"]), lambda s: s.isNotNull()))
    return rows.withColumns({"raw_count": F.size("points").cast("long"), "max_speed": speed, "points": sample_stride(F.transform("points", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))), settings.batch_task_points)})


def met_by_boxes(vertices: DataFrame, of: list[str], boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (keys, of): features with a vertex in the box, borders included; an edge that only crosses doesn't count.

    A box is posted on the grid whose cells are no smaller than itself, so in four cells at most, however large it is; a
    vertex looks at its cell of every level that a box is on. No vertex is compared with boxes far from it.
    """
    step = level_of(F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south")), GRID_DEG)
    covers = boxes.select(*keys, "south", "west", "north", "east", step.alias("level"))
    used = met_levels(covers)
    for axis, low, high in (("x", "west", "east"), ("y", "south", "north")):
        covers = covers.withColumn(axis, F.explode(F.sequence(cell_of(F.col(low), F.col("level"), GRID_DEG), cell_of(F.col(high), F.col("level"), GRID_DEG))))
    posted = vertices.select(*of, "lon", "lat", F.explode(levels(used)).alias("level"))
    posted = posted.withColumns({"x": cell_of(F.col("lon"), F.col("level"), GRID_DEG), "y": cell_of(F.col("lat"), F.col("level"), GRID_DEG)})
    met = posted.join(covers, ["level", "x", "y"]).filter(in_box(F.col("lon"), F.col("lat"), F.col("south"), F.col("west"), F.col("north"), F.col("east")))
    return met.select(*keys, *of).distinct()


def counted_by_boxes(vertices: DataFrame, of: str, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, features, first: of each box that meets features by met_by_boxes() their number and the least.

    Equal boxes are looked at once, and so are features of the same vertices. A feature counts at the first of its vertices that lies
    in a box, so pairs of box and feature are added up where they are found, neither kept nor shuffled. Boxes are posted on
    cells smaller than themselves, which leaves fewer vertices outside to compare with.
    """
    boxes = written(boxes.select(*keys, *SIDES), "boxes")
    covers = boxes.select(*SIDES).distinct().withColumn("level", level_of(F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south")) / CUT, FINE_DEG))
    used = met_levels(covers)
    for axis, low, high in (("x", "west", "east"), ("y", "south", "north")):
        covers = covers.withColumn(axis, F.explode(F.sequence(cell_of(F.col(low), F.col("level"), FINE_DEG), cell_of(F.col(high), F.col("level"), FINE_DEG))))
    known = vertices.filter("lon is not null and lat is not null").groupBy(of).agg(F.sort_array(F.collect_set(F.struct("lon", "lat"))).alias("shape"))
    shapes = known.groupBy("shape").agg(F.count("*").alias("features"), F.min(of).alias("first")).select("*", F.posexplode("shape").alias("place", "p"))
    posted = shapes.select("features", "first", "p.lon", "p.lat", F.slice("shape", F.lit(1), F.col("place")).alias("earlier"), F.explode(levels(used)).alias("level"))
    posted = posted.withColumns({"x": cell_of(F.col("lon"), F.col("level"), FINE_DEG), "y": cell_of(F.col("lat"), F.col("level"), FINE_DEG)})
    cells, tasks = ["level", "x", "y"], int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    covers, posted = covers.repartition(tasks, *cells), posted.repartition(tasks, *cells)  # few bytes, but much to compare: Spark would join them in one task
    inside = lambda lon, lat: in_box(lon, lat, *(F.col(c) for c in SIDES))
    met = posted.join(covers, cells).filter(inside(F.col("lon"), F.col("lat")) & ~F.exists("earlier", lambda p: inside(p["lon"], p["lat"])))
    return boxes.join(met.groupBy(*SIDES).agg(F.sum("features").alias("features"), F.min("first").alias("first")), SIDES).select(*keys, "features", "first")
