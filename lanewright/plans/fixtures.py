"""Lanes, links, tracks and areas derived from the driver's tables by one SQL text for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.functions.geo import polyline_m

FOUR = "(select 0 as k union all select 1 union all select 2 union all select 3)"
VIEWS = {
    "fx_lane_points": f"""
select p_partkey as lane, k,
  110.0e0 + ((p_partkey % 20) * 100 + k * 30) / 1.0e5 as lon,
  40.0e0 + (cast(floor(p_partkey / 20.0e0) as bigint) * 80 + (p_size % 3) * (case when k in (1, 2) then 4 else 0 end)) / 1.0e5 as lat
from {{part}} cross join {FOUR} s""",
    "fx_lane_links": """
select p_partkey as src, p_partkey + 1 as dst, case when p_partkey % 2 = 0 then 'successor' else 'predecessor' end as declared_by
from {part} where p_partkey % 20 < 19 and p_partkey % 3 <> 0""",
    "fx_track_points": """
select user_id, i, ts, value as speed,
  110.0e0 + ((user_id * 37 + s * 7) % 2000) / 1.0e5 as lon,
  40.0e0 + ((user_id * 53 + s * 3) % 1600) / 1.0e5 as lat
from (select user_id, ts, value, i, i - cast(floor(i / 5.0e0) as bigint) as s
      from (select user_id, ts, value, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as i from {events}) a) b""",
    "fx_area_points": f"""
select s_suppkey as area, s_nationkey % 9 as area_type, k,
  110.0e0 + ((s_suppkey * 131) % 2000 + (case when k in (1, 2) then 50 else 0 end)) / 1.0e5 as lon,
  40.0e0 + ((s_suppkey * 71) % 1600 + (case when k in (2, 3) then 40 else 0 end)) / 1.0e5 as lat
from {{supplier}} cross join {FOUR} q""",
}
TABLE_OF = {"fx_lane_points": "part", "fx_lane_links": "part", "fx_track_points": "events", "fx_area_points": "supplier"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = TABLE_OF[name]
    return spark.sql(VIEWS[name], **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def duck(*names: str) -> str:
    """The views as common table expressions."""
    return ",\n".join(f"{n} as ({VIEWS[n].format(**{TABLE_OF[n]: TABLE_OF[n]})})" for n in names)


def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, lane_ord, points, length_m, start_point, end_point."""
    points = F.transform(F.sort_array(F.collect_list(F.struct("k", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"), F.lit(None).cast("double").alias("z"), F.lit(None).cast("string").alias("timestamp")))
    rows = view(spark, sf_dir, "fx_lane_points").groupBy("lane").agg(points.alias("points"))
    rows = rows.select(F.col("lane").cast("string").alias("uid"), F.col("lane").alias("lane_ord"), "points")
    return rows.withColumns({"length_m": polyline_m(F.col("points")), "start_point": F.element_at("points", 1), "end_point": F.element_at("points", -1)})


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_lane_links").select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
