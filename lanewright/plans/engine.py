"""The two ways the library is used: a route on request, and maps of whole folders."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewright.functions.arrays import dedup_consecutive, sample_stride
from lanewright.functions.geo import polyline_m
from lanewright.operators import features, network, routes, tracks
from lanewright.plans import layers
from lanewright.settings import DEFAULT, Settings
from lanewright.sources import json_files as J
from lanewright.sources import search
from lanewright.sources.text_files import write_texts
from lanewright.storage import written

KEYS = ["sn", "task_id"]
OD_SOURCE = "first and last point"  # what origin and destination are taken from, in words


class TaskNotFound(LookupError):
    """No task has the number and id asked for."""


class NoTrack(ValueError):
    """The first matching task has no track of two points or more that can be read."""


class Engine:
    """Plans routes for tasks under a folder over the network of a resource file. Loaded at first use; no result cache.

    strict raises where a file, a task or a lane can't be read; otherwise it is left out.
    """

    def __init__(self, spark: SparkSession, tasks_path: str, resource_path: str, settings: Settings = DEFAULT, strict: bool = False) -> None:
        self.spark, self.tasks_path, self.resource_path, self.settings, self.strict = spark, tasks_path, resource_path, settings, strict
        self._network: tuple[DataFrame, DataFrame, DataFrame] | None = None

    def network(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """lanes, links, edges. FileNotFoundError where either path isn't there, ValueError where no lane was read."""
        if self._network is None:
            J.existing(self.spark, self.tasks_path)
            found, bad = J.records(J.existing(self.spark, self.resource_path, recursive=False), scalars=False)
            lanes, rejects = J.lanes(found, self.settings)
            self._checked(rejects.unionByName(bad))
            lanes = written(lanes, "lanes")
            if lanes.isEmpty():
                raise ValueError(f"no lanes in {self.resource_path}: {[r['reason'] for r in rejects.unionByName(bad).limit(5).collect()]}")
            links = network.declared_links(lanes)
            self._network = lanes, links, written(network.edges(links, lanes, self.settings), "edges")
        return self._network

    def _checked(self, rejects: DataFrame) -> None:
        if self.strict and (r := rejects.first()):
            raise ValueError(f"{r['file']}: {r['reason']}")

    def reload(self) -> int:
        """Reads the network anew; the number of lanes."""
        self._network = None
        return self.network()[0].count()

    def health(self) -> dict:
        return {"tasks_path": self.tasks_path, "resource_path": self.resource_path, "lane_count": self.network()[0].count()}

    def tasks(self) -> tuple[DataFrame, DataFrame]:
        """The first task of every (sn, task_id), its points without repeats, and the rejects of files and records.

        The first one decides also where its track can't be read (bad): it has no points then, and no later task takes its place.
        """
        found, bad = J.records(J.existing(self.spark, self.tasks_path))
        rows = J.tasks(found)
        unread = bad.unionByName(rows.filter("bad").select("file", F.lit("a message without coordinates").alias("reason")))
        self._checked(unread)
        return tracks.first_match(rows, ["order", "pos"]).withColumn("points", dedup_consecutive(F.col("points"))), unread

    def histories(self, tasks: DataFrame) -> DataFrame:
        end = lambda i: F.element_at("points", i)
        return tasks.select(
            *KEYS, F.element_at("order", -1).alias("source_file"), "points", F.size("points").cast("long").alias("history_point_count"), polyline_m(F.col("points")).alias("history_distance_m"),
            end(1)["lon"].alias("origin_lon"), end(1)["lat"].alias("origin_lat"), end(-1)["lon"].alias("destination_lon"), end(-1)["lat"].alias("destination_lat"),
        )

    def plan(self, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(planned, summary) of many tasks; those without a possible route are in neither."""
        lanes, links, edges = self.network()
        history = written(self.histories(tasks.filter(F.size("points") >= 2)), "histories")
        planned = written(routes.plan(history, lanes, links, edges, KEYS, self.settings), "plans")
        summary = routes.summary(planned, history, KEYS).join(history.select(*KEYS, "source_file"), KEYS).withColumn("od_source", F.lit(OD_SOURCE))
        return planned, summary

    def summaries(self) -> DataFrame:
        """The summary of every task under the folder."""
        return self.plan(self.tasks()[0])[1]

    def find(self, sn: str, task_id: str) -> DataFrame:
        """The first task with this number and id; the first match decides even where it can't be used."""
        asked = self.spark.createDataFrame([(sn, task_id)], search.ASKED)
        tasks, rejects = search.find_tasks(self.spark, self.tasks_path, asked)
        self._checked(rejects.unionByName(tasks.filter("bad").select("file", F.lit("a message without coordinates").alias("reason"))))
        one = written(tasks.withColumn("points", dedup_consecutive(F.col("points"))), "task")
        row = one.select("file", "bad", F.size("points").alias("n")).first()
        if row is None:
            reasons = [f"{os.path.basename(r['file'])}: {r['reason']}" for r in rejects.limit(5).collect()]
            raise TaskNotFound(f"no task {sn} {task_id}; unread: {reasons}")
        if row["bad"] or row["n"] < 2:
            raise NoTrack(f"task {sn} {task_id} in {row['file']} has no track of two points or more")
        return one

    def route(self, sn: str, task_id: str, show_lanes: bool = False) -> dict:
        """summary (16 fields) and map_html of one task. With show_lanes the page has all lanes of the network."""
        if not sn.strip() or not task_id.strip():
            raise ValueError("sn and task_id must not be blank")
        one = self.find(sn, task_id)
        planned, summary = self.plan(one)
        row = summary.first()
        if row is None:
            raise ValueError("no possible route")
        lanes = self.network()[0]
        parts = written(routes.visible(planned, lanes, KEYS).join(lanes.select("uid", "type_id", "name", "length_m"), "uid"), "parts")
        ends = planned.join(self.histories(one), KEYS)
        for side in ("origin", "destination"):
            ends = ends.withColumn(side, F.struct(F.col(f"{side}_lon").alias("lon"), F.col(f"{side}_lat").alias("lat")))
        shown = layers.route_layers(ends, parts, one, lanes if show_lanes else None, self.settings)
        box = layers.bounds(parts, one, self.settings.fit_padding_deg).first()
        legend = [f"sn {sn.strip()}", f"task {task_id.strip()}", f"driven (red): {row['history_distance_m']:.1f} m", f"planned (blue): {row['planned_distance_m']:.1f} m", f"planned lanes: {row['planned_lane_count']}"]
        return {"summary": row.asDict(), "map_html": layers.page(shown.collect(), f"{sn} {task_id}", (box["south"], box["west"], box["north"], box["east"]), legend, (box["centre_lat"], box["centre_lon"]))}


@F.pandas_udf(T.StringType())
def _page(title: pd.Series, rows: pd.Series, south: pd.Series, west: pd.Series, north: pd.Series, east: pd.Series) -> pd.Series:
    return pd.Series([layers.page(r, t, box) for t, r, *box in zip(title, rows, south, west, north, east, strict=True)])


def drawn(spark: SparkSession, tasks_path: str, resource_path: str, settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(layers, boxes, tasks, status): rows of the map of every file that can be drawn; its box; its tasks; file, order, status of
    every file. Features and boxes of all files meet in one join."""
    texts = J.existing(spark, tasks_path, recursive=False)
    found, bad = J.records(texts, strict=True)
    tasks = written(J.batch_tasks(found), "batch-tasks")
    unread = tasks.filter("bad").select("file", F.lit("a number that can't be read").alias("reason")).distinct()
    bad = bad.unionByName(unread)
    rows = written(features.task_routes(tasks.join(unread, "file", "left_anti"), settings), "routes")
    exact = tracks.boxes(rows.select("file", F.explode("points").alias("p")).select("file", "p.lon", "p.lat"), ["file"])
    boxes = exact.select("file", *[(F.col(c) + sign * settings.bbox_margin_deg).alias(c) for c, sign in (("south", -1), ("west", -1), ("north", 1), ("east", 1))])
    resources, unread = J.records(J.existing(spark, resource_path, recursive=False), strict=True)
    found = written(J.shapes(resources), "shapes")
    if (r := unread.unionByName(J.unusable(found)).first()) is not None:
        raise ValueError(f"{r['file']}: {r['reason']}")
    met = []
    for table in J.drawable(found):
        vertices = table.select("feature", F.explode("points").alias("p")).select("feature", "p.lon", "p.lat")
        met.append(features.met_by_boxes(vertices, ["feature"], boxes, ["file"]).join(table, "feature"))
    areas, lines = met
    lines = lines.withColumn("points", sample_stride(F.col("points"), settings.batch_lane_points))
    reasons = bad.groupBy("file").agg(F.min("reason").alias("reason"))
    status = texts.select("file", "order").join(reasons, "file", "left").join(rows.select("file", F.lit("written").alias("written")).distinct(), "file", "left")
    status = status.select("file", "order", F.coalesce("reason", "written", F.lit("no track of two points or more")).alias("status"))
    return layers.batch_layers(rows, areas, lines), exact, rows, status


def pages(spark: SparkSession, tasks_path: str, resource_path: str, settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(pages, status): file, order, device, tasks, html of every task file that can be drawn; file, order, status of every file.

    Pages are made on the executors, one row each.
    """
    rows, boxes, tasks, status = drawn(spark, tasks_path, resource_path, settings)
    shown = rows.groupBy("file").agg(F.collect_list(F.struct(*layers.COLUMNS)).alias("rows"))
    files = tasks.groupBy("file").agg(F.min("order").alias("order"), F.min("device").alias("device"), F.count("*").alias("tasks"))
    made = files.join(shown, "file").join(boxes, "file").select("file", "order", "device", "tasks", _page("device", "rows", "south", "west", "north", "east").alias("html"))
    return made, status


def batch_maps(spark: SparkSession, tasks_path: str, resource_path: str, target: str, settings: Settings = DEFAULT) -> list[dict]:
    """A page per task file, named by its device, and what became of each file, in their order. Of files of one device the last
    has the page. The executors write the pages; the target is any folder that they share, of any file system."""
    made, status = pages(spark, tasks_path, resource_path, settings)
    made = written(made.withColumn("name", F.concat("device", F.lit("矿车路线地图.html"))), "pages")
    last = made.groupBy("name").agg(F.max_by("html", "order").alias("text"))
    write_texts(written(last, "last-pages"), target)
    rows = status.join(made.select("file", "name", "tasks"), "file", "left").orderBy("order").select("file", "status", "name", "tasks")
    return [{"file": r["file"], "status": r["status"], **({"target": os.path.join(target, r["name"]), "tasks": r["tasks"]} if r["name"] else {})} for r in rows.collect()]
