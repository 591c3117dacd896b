"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewright.llm.common import written


SALTS = 64
MOST_LINKS = 4096  # of a node whose links are held together by one task; nodes with more are spread over SALTS parts


def with_least(edges: DataFrame, key: str, value: str) -> DataFrame:
    """edges with _m, the least value of each key. A key with most rows is spread over SALTS parts: their minima are joined
    first, and then given back to the parts."""
    salted = edges.withColumn("_s", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(key, "_s").agg(F.min(value).alias("_of_part"))
    whole = parts.groupBy(key).agg(F.min("_of_part").alias("_m"), F.collect_list("_s").alias("_parts"))
    return salted.join(whole.select(key, "_m", F.explode("_parts").alias("_s")), [key, "_s"]).drop("_s")


def with_least_of_few(edges: DataFrame, key: str, value: str) -> DataFrame:
    """with_least() where no key has many rows: one shuffle, no join."""
    return edges.withColumn("_m", F.min(value).over(Window.partitionBy(key)))


def large_star(edges: DataFrame, least: Callable[[DataFrame, str, str], DataFrame] = with_least) -> DataFrame:
    """Each node's larger neighbours are linked to the least of the node and its neighbours instead. Links can come twice."""
    moved = least(edges.union(edges.select("b", "a")), "a", "b").filter("b > a")
    return moved.select(F.least("a", "_m").alias("a"), "b")


def small_star(edges: DataFrame, least: Callable[[DataFrame, str, str], DataFrame] = with_least) -> DataFrame:
    """Each node, and its smaller neighbours, are linked to the least of those neighbours (edges have a < b)."""
    moved = least(edges, "b", "a")
    return moved.select(F.col("_m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a <> b").distinct()


def shape(edges: DataFrame) -> tuple[bool, int]:
    """Whether every node but the roots has one link, to a root that is linked to no smaller node; and the most links of a node."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")), F.struct(F.col("b").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))))
    nodes = edges.select(ends.alias("_of")).groupBy("_of.node").agg(F.sum("_of.up").alias("up"), F.sum("_of.down").alias("down"))
    wrong = (F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") > 0))
    found = nodes.agg(F.max(wrong), F.max(F.col("up") + F.col("down"))).first()
    return not found[0], found[1] or 0


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the links (a, b): root is the least node reachable. Nodes can be of any type with an order.

    Links of a node with itself and nulls are dropped. Every step is written to the shared folder; the steps end when the
    links are stars, after about the square of the logarithm of the number of nodes at most. A step shuffles three times while no
    node has more than MOST_LINKS links, and then holds the links of a node together.
    """
    edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    while True:
        stars, most = shape(edges)
        if stars:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        if most > MOST_LINKS:
            edges = small_star(large_star(edges).distinct())
        else:
            edges = small_star(large_star(edges, with_least_of_few), with_least_of_few)
        edges = written(edges, "links")
