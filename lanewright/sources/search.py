"""The first task with a number and id among the files of a folder, for many asked at once, without reading on behind it."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.functions.text import stripped
from lanewright.operators.tracks import first_match
from lanewright.sources import json_files as J
from lanewright.storage import written

FIRST_FILES, MOST_FILES = 64, 16_384  # files read at once: the first group, and the largest (each four times the one before)
ASKED = "sn string, task_id string"


def listed(spark: SparkSession, path: str, recursive: bool = True) -> list[str]:
    """The JSON files of a folder in order of their path components. Spark lists them on the driver in any case to plan a scan."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.json")
    try:
        names = read.load(path).inputFiles()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(path) from error
        raise
    if not names:
        raise FileNotFoundError(f"no JSON file under {path}")
    return sorted(map(unquote, names), key=lambda name: name.split("/"))


def groups(names: list[str]) -> list[list[str]]:
    """The names in order, in groups that grow."""
    out, at, size = [], 0, FIRST_FILES
    while at < len(names):
        out.append(names[at : at + size])
        at, size = at + size, min(4 * size, MOST_FILES)
    return out


def read_named(spark: SparkSession, names: list[str]) -> DataFrame:
    """file, stem, order and text of the named files; signs that would be read as patterns are escaped."""
    plain = [re.sub(r"([\\{}\[\]*?])", r"\\\1", name) for name in names]
    return J.texts_of(spark.read.format("binaryFile").load(plain))


def find_tasks(spark: SparkSession, path: str, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks, rejects) for asked (sn, task_id): the first task of each pair that is there, as tasks() has it, and file, reason of
    the files read that are no JSON.

    Files are read in the order of their path components, group by group, until every pair has been met: a file behind the
    last first match is read only if it is in the same group. A pair is compared stripped, in its case; null pairs match nothing and
    pairs asked twice give one row. The first match decides, also where its track can't be read (bad).
    """
    left = asked.select(stripped(F.col("sn")).alias("sn"), stripped(F.col("task_id")).alias("task_id")).filter("sn is not null and task_id is not null").distinct()
    left, found, rejects = written(left, "asked"), [], []
    for names in groups(listed(spark, path)):
        records, bad = J.records(read_named(spark, names))
        met = J.tasks(records).join(left, ["sn", "task_id"], "left_semi")
        met = written(first_match(met, ["order", "pos"]), "found")
        found.append(met)
        rejects.append(written(bad, "unread"))
        left = written(left.join(met.select("sn", "task_id"), ["sn", "task_id"], "left_anti"), "asked")
        if left.isEmpty():
            break
    whole = lambda parts: parts[0] if len(parts) == 1 else whole([parts[0].unionByName(parts[1]), *parts[2:]])
    return whole(found), whole(rejects)
