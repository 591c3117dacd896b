"""Texts written as named files: the executors write them, the driver only gives them their names.

Spark's own writer puts each text into a folder of its own under a staging folder, with its commit protocol, so a lost task or
executor leaves nothing behind. Then the files are renamed to their places on whatever file system the target is. A failed
write removes the staging folder and leaves the target as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_system(spark: SparkSession, path: str):
    """(file system, its Path class) of a path. On a local one renames take no checksum files along."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    system = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return (system.getRawFileSystem() if system.getUri().getScheme() == "file" else system), hadoop.Path


def write_texts(texts: DataFrame, target: str) -> list[str]:
    """Writes each row (name, text) to the file target/name and returns the names, sorted. Files that are there are replaced.

    Names must be unique and without slashes; null names or texts raise. texts is read twice, so it should be a stored table; it is
    names alone, as many as files, that reach the driver.
    """
    spark = texts.sparkSession
    named = texts.select("name", F.md5("name").alias("folder"))
    names = {r["folder"]: r["name"] for r in named.collect()}
    if None in names or any("/" in name for name in names.values()) or len(names) < texts.count() or not texts.filter("text is null").isEmpty():
        raise ValueError("names of files must be unique and without slashes, and their texts not null")
    system, path = file_system(spark, target)
    staging = f"{target.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    try:
        texts.select(F.col("text").alias("value"), F.md5("name").alias("folder")).write.partitionBy("folder").text(staging)
        for folder, name in names.items():
            part = next(s.getPath() for s in system.listStatus(path(f"{staging}/folder={folder}")) if s.getPath().getName().startswith("part-"))
            place = path(f"{target.rstrip('/')}/{name}")
            system.delete(place, False)
            if not system.rename(part, place):
                raise OSError(f"{place} could not be put in place")
    finally:
        system.delete(path(staging), True)
    return sorted(names.values())
