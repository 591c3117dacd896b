"""Registered queries that read JSON files through the sources, and the same in SQL over the records with DuckDB's JSON functions.

The files are derived from the driver's tables first (json_fixtures), so the work grows with these.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.functions.arrays import dedup_consecutive, sample_stride
from lanewright.functions.geo import polyline_m
from lanewright.operators import features, routes
from lanewright.plans import engine, layers
from lanewright.plans import queries as Q
from lanewright.plans.json_fixtures import BROKEN, MARKED, STRAY, VIEWS, duck, resource_folder, task_folder
from lanewright.plans.queries import DEDUP, DRAWN, ROUTES, hop
from lanewright.settings import DEFAULT
from lanewright.sources import json_files as J
from lanewright.sources import search

QUERIES, ORACLE_SQL = {}, {}

#: Pairs of number and id asked for: most are there, those with a small s never are, for case counts.
VIEWS["fx_asked"] = (
    """
select distinct case user_id % 3 when 0 then cast(user_id % 10 as string) when 1 then ' ' || user_id % 10 || ' ' else case when user_id % 2 = 0 then 's' else 'S' end || user_id % 10 end as sn,
  case when t % 11 = 10 then 'None' else cast(t as string) end as task_id
from (select distinct user_id, i div 25 as t from (select user_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as i from {events}) x) a""",
    "events",
)


def registered(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return add


def file_no(name: Column) -> Column:
    return F.regexp_extract(name, r"f(\d+)\.json$", 1).cast("long").alias("file_no")


def weighted(points: Column, axis: str) -> Column:
    """A sum in which every vertex counts by its place."""
    return F.round(F.aggregate(F.transform(points, lambda p, i: p[axis] * (i + 1)), F.lit(0.0), lambda total, x: total + x), 5)


ITEMS = f"""items as (
  select *, row_number() over (partition by file_no order by k) - 1 + case when {STRAY} then 1 else 0 end as pos, cast(record as json) as j from {{view}}),
payloads as (
  select *, coalesce(j->>'资源类型', '') as type, case json_type(j->'数据') when 'OBJECT' then j->'数据' when 'VARCHAR' then case when json_valid(j->>'数据') then cast(j->>'数据' as json) end end as data from items)"""
IDS = """case json_type(data->'{0}') when 'ARRAY' then list_transform(json_extract(data, '$.{0}[*]'), lambda v: trim(coalesce(v->>'$', 'None')))
    when 'NULL' then [] else case when (data->'{0}') is null then [] else [trim(data->>'{0}')] end end"""


@registered(
    f"""with {duck("fx_resources")},
{ITEMS.replace("{view}", f"fx_resources where not ({BROKEN})")},
typed as (
  select *, list_filter(list_transform(json_extract(data, '$.central_curve.segment[*].line_segment.point[*]'), lambda p: {{'lon': try_cast(p->>'x' as double), 'lat': try_cast(p->>'y' as double),
    'z': try_cast(p->>'z' as double), 'wrong': (p->>'z') is not null and try_cast(p->>'z' as double) is null}}), lambda q: q.lon is not null and q.lat is not null and not q.wrong) as points,
    {IDS.format("successor_uid")} as after, {IDS.format("predecessor_uid")} as ahead
  from payloads where json_type(j->'资源类型ID') in ('UBIGINT', 'BIGINT', 'DOUBLE') and cast(j->>'资源类型ID' as double) in (101, 116)),
good as (
  select coalesce(data->>'uid', 'None') as uid, *, dense_rank() over (order by file_no) - 1 as file_rank from typed where len(points) > 0),
last as (
  select *, row_number() over (partition by uid order by file_no desc, pos desc) as nth, first_value(file_rank) over (partition by uid order by file_no, pos) as first_file,
    first_value(pos) over (partition by uid order by file_no, pos) as first_pos from good)
select uid, first_file as file_rank, first_pos as pos, j->>'资源名称' as name, cast(cast(j->>'资源类型ID' as double) as int) as type_id, j->>'资源类型' as type_name,
  data->>'width' as width, data->>'speed_limit' as speed_limit, data->>'direction' as direction, data->>'temp_road' as temp_road,
  array_to_string(list_filter(after, lambda t: t not in ('', 'None')), ',') as successors, array_to_string(list_filter(ahead, lambda t: t not in ('', 'None')), ',') as predecessors,
  len(points) as n_points, round(coalesce(list_sum([{hop("points[i].", "points[i + 1].")} for i in range(1, len(points))]), 0), 4) as length_m,
  points[1].lon as start_lon, points[1].lat as start_lat, points[-1].lon as end_lon, points[-1].lat as end_lat, coalesce(list_sum(list_transform(points, lambda p: p.z)), 0) as z_sum
from last where nth = 1"""
)
def lanes_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes of a folder of resource files, the last of a repeated uid at the place of the first."""
    found, _ = J.records(J.existing(spark, resource_folder(spark, sf_dir, "fx_resources")), scalars=False)
    rows, _ = J.lanes(found, replace(DEFAULT, lane_type_ids=(101, 116)))
    z_sum = F.aggregate("points", F.lit(0.0), lambda total, p: total + F.coalesce(p["z"], F.lit(0.0)))
    return rows.select(
        "uid", F.shiftright("lane_ord", 32).alias("file_rank"), F.col("lane_ord").bitwiseAND(F.lit((1 << 32) - 1)).alias("pos"), "name", "type_id", "type_name", "width", "speed_limit", "direction", "temp_road",
        F.array_join("successor_uid", ",").alias("successors"), F.array_join("predecessor_uid", ",").alias("predecessors"), F.size("points").cast("long").alias("n_points"), F.round("length_m", 4).alias("length_m"),
        F.col("start_point.lon").alias("start_lon"), F.col("start_point.lat").alias("start_lat"), F.col("end_point.lon").alias("end_lon"), F.col("end_point.lat").alias("end_lat"), z_sum.alias("z_sum"),
    )


VERTICES = """list_filter(list_transform({list}, lambda p: {{'lon': try_cast(p->>'x' as double), 'lat': try_cast(p->>'y' as double)}}), lambda q: q.lon is not null and q.lat is not null)"""
SEGMENT = "coalesce(json_extract(data, '$.central_curve.segment[{0}].line_segment.point[*]'), [])"


FEATURES = f"""named as (
  select *, case when json_exists(j, '$."资源名称"') then j->>'资源名称' else '' end as name, regexp_replace(j->>'资源类型ID', '\\.0$', '') as type_id from payloads where json_type(data) = 'OBJECT'),
parts as (
  select *, {VERTICES.format(list=SEGMENT.format(0))} as one, {VERTICES.format(list=SEGMENT.format(3))} as two, {VERTICES.format(list="coalesce(json_extract(data, '$.polygon.point[*]'), [])")} as ring from named),
shapes as (
  select 'area' as kind, *, ring as points from parts where len(ring) >= 3
  union all
  select 'line', *, list_concat(one, case when len(one) > 0 and one[-1] = two[1] then two[2:] else two end) as points from parts),
drawn as (select *, cast(ceil(len(points) / 3.0e0) as bigint) as step from shapes where kind = 'area' or len(points) >= 2),
sampled as (
  select *, case when kind = 'area' or len(points) <= 3 then points else list_transform(list_filter(range(1, len(points) + 1), lambda i: (i - 1) % step = 0), lambda i: points[i]) end as taken from drawn),
whole as (select *, case when taken[-1] <> points[-1] then list_append(taken, points[-1]) else taken end as shown from sampled)"""


@registered(
    f"""with {duck("fx_features")},
{ITEMS.replace("{view}", "fx_features").replace(f"case when {STRAY} then 1 else 0 end", "0")},
{FEATURES}
select kind, file_no, pos, name, type, type_id, coalesce(name, 'None') || ' | ' || type || ' | 类型ID=' || type_id as tooltip, len(points) as raw_count, len(shown) as n_points,
  round(list_sum([shown[i].lon * i for i in range(1, len(shown) + 1)]), 5) as lon_sum, round(list_sum([shown[i].lat * i for i in range(1, len(shown) + 1)]), 5) as lat_sum
from whole"""
)
def features_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas and lines of a folder of resource files, the lines sampled to 3 vertices or one more."""
    found, _ = J.records(J.existing(spark, resource_folder(spark, sf_dir, "fx_features", plain=True)), strict=True)
    areas, lines = J.features(found)
    rows = areas.select(F.lit("area").alias("kind"), *areas.columns, F.size("points").cast("long").alias("raw_count")).unionByName(
        lines.select(F.lit("line").alias("kind"), *lines.drop("points").columns, sample_stride(F.col("points"), 3).alias("points"))
    )
    return rows.select(
        "kind", file_no(F.element_at("feature.order", -1)), F.col("feature.pos").cast("long").alias("pos"), "name", "type", "type_id", "tooltip", "raw_count", F.size("points").cast("long").alias("n_points"),
        weighted(F.col("points"), "lon").alias("lon_sum"), weighted(F.col("points"), "lat").alias("lat_sum"),
    )


TASKS = f"""placed as (
  select *, row_number() over (partition by file_no order by user_id, t) - 1 as place, cast('{{' || fields || '}}' as json) as j from fx_fields),
messages as (
  select user_id, t, i, try_cast(m->>'longitude' as double) as lon, try_cast(m->>'latitude' as double) as lat, try_cast(m->>'speed' as double) as speed, coalesce(m->>'received_at', '') as time
  from (select *, cast(message as json) as m from fx_messages)),
found as (
  select p.*, place + case when {STRAY} then 1 else 0 end as pos, trim(coalesce(j->>'sn', 'None')) as sn, trim(coalesce(j->>'task_id', 'None')) as task_id,
    silent or (select count(*) from messages m where m.user_id = p.user_id and m.t = p.t and m.lon is null) > 0 as bad from placed p where not ({BROKEN})),
kept as (
  select user_id, t, i, lon, lat, coalesce(lag(lon) over w = lon and lag(lat) over w = lat, false) as again from messages window w as (partition by user_id, t order by i)),
walked as (
  select *, {hop("p", "").replace("plat", "lag(lat) over w").replace("plon", "lag(lon) over w")} as step_m from kept where not again window w as (partition by user_id, t order by i)),
tracks as (select user_id, t, count(*) as n, arg_min(lon, i) as lon, arg_max(lat, i) as lat, round(coalesce(sum(step_m), 0), 3) as length_m from walked group by user_id, t),
tasks as (
  select file_no, pos, sn, task_id, bad, case when bad then 0 else n end as n_points, case when bad then null else r.lon end as origin_lon, case when bad then null else r.lat end as destination_lat,
    case when bad then 0 else length_m end as length_m from found join tracks r using (user_id, t))"""


def described(tasks: DataFrame) -> DataFrame:
    rows = tasks.withColumn("points", dedup_consecutive(F.col("points")))
    return rows.select(
        file_no(F.col("file")), F.col("pos").cast("long").alias("pos"), "sn", "task_id", "bad", F.size("points").cast("long").alias("n_points"),
        F.get("points", F.lit(0))["lon"].alias("origin_lon"), F.try_element_at("points", F.lit(-1))["lat"].alias("destination_lat"), F.round(polyline_m(F.col("points")), 3).alias("length_m"),
    )


@registered(f"with {duck('fx_fields', 'fx_messages')},\n{TASKS} select * from tasks")
def tasks_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every task of a folder, in the lookup way."""
    return described(J.tasks(J.records(J.existing(spark, task_folder(spark, sf_dir)))[0]))


@registered(
    f"with {duck('fx_fields', 'fx_messages', 'fx_asked')},\n{TASKS},\nasked as (select distinct trim(sn) as sn, trim(task_id) as task_id from fx_asked)"
    " select file_no, pos, sn, task_id, bad, n_points, origin_lon, destination_lat, length_m"
    " from (select *, row_number() over (partition by sn, task_id order by file_no, pos) as nth from tasks semi join asked using (sn, task_id)) where nth = 1"
)
def find_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first task of each asked pair, files searched in order until all are met."""
    asked = spark.sql(VIEWS["fx_asked"][0].replace("{events}", f"parquet.`{sf_dir}/events.parquet`"))
    return described(search.find_tasks(spark, task_folder(spark, sf_dir), asked)[0])


BATCH = f"""ordered as (select *, row_number() over (partition by user_id, t order by time, i) as nth from messages where lon is not null and lat is not null),
lists as (select user_id, t, count(*) as raw_count, max(speed) as max_speed, list({{'lon': lon, 'lat': lat}} order by nth) as points from ordered group by user_id, t having count(*) >= 2),
taken as (
  select *, case when raw_count <= 10 then points else list_transform(list_filter(range(1, raw_count + 1), lambda i: (i - 1) % cast(ceil(raw_count / 10.0e0) as bigint) = 0), lambda i: points[i]) end as part from lists),
shown as (select *, case when part[-1] <> points[-1] then list_append(part, points[-1]) else part end as drawn from taken),
batch as (
  select file_no, place as pos, 'f' || lpad(cast(file_no as varchar), 9, '0') as device, case when json_exists(j, '$.task_id') then j->>'task_id' else 'unknown' end as task_id,
    case when json_exists(j, '$.actual_start_time') then j->>'actual_start_time' else '' end as start_time, raw_count, max_speed, len(drawn) as n_points, drawn
  from placed join shown using (user_id, t) where not silent and not ({BROKEN}) and not ({MARKED}) and not ({STRAY}))"""


@registered(
    f"""with {duck("fx_fields", "fx_messages")},
{TASKS},
{BATCH}
select file_no, pos, device, task_id, start_time, raw_count, max_speed, n_points,
  round(list_sum([drawn[i].lon * i for i in range(1, len(drawn) + 1)]), 5) as lon_sum, round(list_sum([drawn[i].lat * i for i in range(1, len(drawn) + 1)]), 5) as lat_sum from batch"""
)
def batch_tasks_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every task of the files that the batch way can read, with 10 points or one more."""
    rows = J.batch_tasks(J.records(J.existing(spark, task_folder(spark, sf_dir), recursive=False), strict=True)[0])
    unread = rows.filter("bad").select("file").distinct()
    rows = features.task_routes(rows.join(unread, "file", "left_anti"), replace(DEFAULT, batch_task_points=10))
    return rows.select(
        file_no(F.col("file")), F.col("pos").cast("long").alias("pos"), "device", "task_id", "start_time", "raw_count", "max_speed", F.size("points").cast("long").alias("n_points"),
        weighted(F.col("points"), "lon").alias("lon_sum"), weighted(F.col("points"), "lat").alias("lat_sum"),
    )


LAYERED = replace(DEFAULT, batch_task_points=10, batch_lane_points=3)
BEHIND = 1 << 30


@registered(
    f"""with {duck("fx_fields", "fx_messages", "fx_features")},
{TASKS},
{BATCH},
{ITEMS.replace("{view}", "fx_features").replace(f"case when {STRAY} then 1 else 0 end", "0")},
{FEATURES},
files as (
  select file_no, min(p.lat) as south, min(p.lon) as west, max(p.lat) as north, max(p.lon) as east from (select file_no, unnest(drawn) as p from batch) group by file_no),
met as (
  select distinct f.file_no as map_no, w.kind, w.file_no as in_file, w.pos as in_pos from files f join (select *, unnest(points) as p from whole) w
    on w.p.lat between f.south - 0.01 and f.north + 0.01 and w.p.lon between f.west - 0.01 and f.east + 0.01),
features as (
  select map_no, w.*, row_number() over (partition by map_no, w.kind order by w.file_no, w.pos) - 1 as item from met m join whole w on w.kind = m.kind and w.file_no = m.in_file and w.pos = m.in_pos),
numbered as (select *, row_number() over (partition by file_no order by pos) - 1 as nth from batch),
shapes_of as (
  select file_no, nth as place, 'Task ' || (nth + 1) || ': ' || coalesce(task_id, 'None') || ' | ' || coalesce(start_time, 'None') as layer, 0 as item, 'line' as kind, {list(layers.TASK_COLOURS)}[nth % 20 + 1] as colour, 4.0 as weight, 0.9 as opacity, raw_count, drawn as coords from numbered
  union all
  select file_no, nth, 'Task ' || (nth + 1) || ': ' || coalesce(task_id, 'None') || ' | ' || coalesce(start_time, 'None'), 1, 'mark', {list(layers.TASK_COLOURS)}[nth % 20 + 1], 4.0, 1.0, 1, [drawn[1]] from numbered
  union all
  select file_no, nth, 'Task ' || (nth + 1) || ': ' || coalesce(task_id, 'None') || ' | ' || coalesce(start_time, 'None'), 2, 'mark', 'red', 4.0, 1.0, 1, [drawn[-1]] from numbered
  union all
  select map_no, {BEHIND}, 'lanes', item, 'line', '#555555', 2.0, 0.35, len(points), shown from features where kind = 'line'
  union all
  select map_no, {BEHIND} + 1, 'areas', item, 'area', '#3388ff', 2.0, 0.18, len(points), shown from features where kind = 'area')
select file_no, cast(place as int) as place, layer, item, kind, colour, cast(weight as double) as weight, cast(opacity as double) as opacity, raw_count, len(coords) as n_points,
  round(list_sum([coords[i].lon * i for i in range(1, len(coords) + 1)]), 5) as lon_sum, round(list_sum([coords[i].lat * i for i in range(1, len(coords) + 1)]), 5) as lat_sum
from shapes_of"""
)
def map_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shape of the batch maps of all files, in order, with its style and the points before sampling."""
    rows, *_ = engine.drawn(spark, task_folder(spark, sf_dir), resource_folder(spark, sf_dir, "fx_features", plain=True), LAYERED)
    return rows.select(
        file_no(F.col("file")), "place", "layer", "item", "kind", "colour", "weight", "opacity", "raw_count", F.size("coords").cast("long").alias("n_points"),
        weighted(F.col("coords"), "lon").alias("lon_sum"), weighted(F.col("coords"), "lat").alias("lat_sum"),
    )


@registered(
    f"""{ROUTES},
{DRAWN},
{DEDUP},
shown as (select user_id, v.lat as lat, v.lon as lon from (select user_id, unnest(line) as v from drawn) union all select user_id, lat, lon from kept where user_id in (select user_id from drawn))
select user_id, round(min(lat) - 0.001, 6) as south, round(min(lon) - 0.001, 6) as west, round(max(lat) + 0.001, 6) as north, round(max(lon) + 0.001, 6) as east, round(avg(lat), 6) as centre_lat, round(avg(lon), 6) as centre_lon
from shown group by user_id"""
)
def map_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The padded box and the centre of the route map of every track: of all its driven points and the drawn lanes."""
    lanes = Q.made_lanes(spark, sf_dir)
    planned = Q.planned(spark, sf_dir, lanes)
    parts = routes.visible(planned, lanes, Q.USER)
    history = Q.histories(spark, sf_dir).join(planned.select("user_id"), "user_id")
    return Q.rounded(layers.bounds(parts, history, DEFAULT.fit_padding_deg, Q.USER))
