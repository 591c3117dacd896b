"""Registered queries over the driver's tables, and the same in SQL for DuckDB where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.functions.arrays import dedup_consecutive, sample_even, sample_stride
from lanewright.functions.geo import polyline_m
from lanewright.functions.text import device_id
from lanewright.operators import features, network, paths, routes, snapping, tracks
from lanewright.plans.fixtures import duck, lanes, links, view
from lanewright.settings import DEFAULT
from lanewright.storage import written

USER = ["user_id"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c, t in df.dtypes if t == "double"})


def points_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_track_points")


def hop(a: str, b: str) -> str:
    """The great-circle way between two points in SQL."""
    return (
        f"(2 * 6371000.0e0 * asin(sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2)"
        f" + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"
    )


STEPS = f"""steps as (
  select user_id, i, lon, lat, {hop("p", "").replace("plat", "lag(lat) over w").replace("plon", "lag(lon) over w")} as step_m
  from fx_track_points window w as (partition by user_id order by i))"""
LANES = f"""lane_steps as (
  select lane, k, lon, lat, coalesce({hop("p", "").replace("plat", "lag(lat) over w").replace("plon", "lag(lon) over w")}, 0) as step_m
  from fx_lane_points window w as (partition by lane order by k)),
lanes as (
  select lane, cast(lane as varchar) as uid, sum(step_m order by k) as length_m, arg_min(lon, k) as s_lon, arg_min(lat, k) as s_lat, arg_max(lon, k) as e_lon, arg_max(lat, k) as e_lat
  from lane_steps group by lane)"""
GAP = hop("a.e_", "b.s_")
EDGES = f"""topology as (
  select distinct cast(l.src as varchar) as src, b.uid as dst, b.length_m as weight
  from fx_lane_links l join lanes b on l.dst = b.lane join lanes a on l.src = a.lane),
proximity as (
  select a.uid as src, b.uid as dst, b.length_m + 10 * {GAP} as weight
  from lanes a join lanes b on a.lane <> b.lane and b.s_lat between a.e_lat - 0.001 and a.e_lat + 0.001 and {GAP} <= 100),
edges as (select src, dst, min(weight) as weight from (select * from topology union all select * from proximity) u group by src, dst)"""

QUERIES, ORACLE_SQL = {}, {}


def registered(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


@registered(f"with {duck('fx_track_points')},\n{STEPS} select user_id, count(*) as points, round(coalesce(sum(step_m), 0), 3) as length_m from steps group by user_id")
def track_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tracks.lengths(points_of(spark, sf_dir), USER, "i"), 3)


@registered(f"with {duck('fx_track_points')} select user_id, round(min(lat), 6) as south, round(min(lon), 6) as west, round(max(lat), 6) as north, round(max(lon), 6) as east from fx_track_points group by user_id")
def track_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tracks.boxes(points_of(spark, sf_dir), USER))


@registered(f"with {duck('fx_track_points')} select user_id, count(*) as raw_count, max(case when lon is not null and lat is not null then speed end) as max_speed from fx_track_points group by user_id")
def track_max_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.top_speeds(points_of(spark, sf_dir), USER)


@registered(
    f"with {duck('fx_track_points')} select user_id, round(arg_min(lon, i), 6) as origin_lon, round(arg_min(lat, i), 6) as origin_lat,"
    " round(arg_max(lon, i), 6) as destination_lon, round(arg_max(lat, i), 6) as destination_lat from fx_track_points group by user_id"
)
def track_origin_destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tracks.ends(points_of(spark, sf_dir), USER, "i"))


DEDUP = f"""kept as (
  select user_id, i, lon, lat from (
    select *, lag(lon) over w as b_lon, lag(lat) over w as b_lat from fx_track_points window w as (partition by user_id order by i)) x
  where b_lon is null or abs(lon - b_lon) >= 1e-12 or abs(lat - b_lat) >= 1e-12)"""


@registered(
    f"with {duck('fx_track_points')},\n{DEDUP},\n{STEPS.replace('fx_track_points', 'kept').replace('steps as', 'steps as', 1)}"
    " select user_id, count(*) as history_point_count, round(coalesce(sum(step_m), 0), 3) as history_distance_m from steps group by user_id"
)
def track_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(histories(spark, sf_dir).drop("points"), 3)


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, points without consecutive repeats, their count and length."""
    arrays = tracks.as_arrays(points_of(spark, sf_dir), USER, "i").select("user_id", dedup_consecutive(F.col("points")).alias("points"))
    return arrays.select("user_id", "points", F.size("points").cast("long").alias("history_point_count"), polyline_m(F.col("points")).alias("history_distance_m"))


def sampled(spark: SparkSession, sf_dir: str, sampler, most: int) -> DataFrame:
    arrays = tracks.as_arrays(points_of(spark, sf_dir), USER, "i", ()).select("user_id", F.transform("points", lambda p: p["i"]).alias("places"))
    return arrays.select("user_id", F.posexplode(sampler(F.col("places"), most)).alias("place", "i")).withColumn("place", F.col("place").cast("long"))


@registered(
    f"with {duck('fx_track_points')}, c as (select user_id, count(*) as n from fx_track_points group by user_id),"
    " chosen as (select distinct user_id, cast(round_even(k * (cast(n - 1 as double) / 39.0e0), 0) as bigint) as i from c, range(40) r(k) where n > 40"
    " union all select user_id, k from c, lateral (select unnest(range(n)) as k) where n <= 40)"
    " select user_id, row_number() over (partition by user_id order by i) - 1 as place, i from chosen"
)
def sample_evenly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(spark, sf_dir, sample_even, 40)


@registered(
    f"with {duck('fx_track_points')}, c as (select user_id, count(*) as n, cast(ceil(count(*) / 40.0e0) as bigint) as step from fx_track_points group by user_id)"
    " select user_id, row_number() over (partition by user_id order by i) - 1 as place, i from fx_track_points join c using (user_id) where i % step = 0 or i = n - 1"
)
def sample_by_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(spark, sf_dir, sample_stride, 40)


@registered(f"with {duck('fx_lane_points')},\n{LANES} select uid, round(length_m, 6) as length_m from lanes")
def lane_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lanes(spark, sf_dir).select("uid", "length_m"))


SEGMENTS = """walked as (select *, sum(step_m) over (partition by lane order by k) as way_m from lane_steps),
segments as (
  select a.lane, a.k as segment_index, a.lon as a_lon, a.lat as a_lat, b.lon as b_lon, b.lat as b_lat, a.way_m as before_m, b.step_m as hop_m
  from walked a join walked b on a.lane = b.lane and b.k = a.k + 1)"""
FLAT = """radians(a_lon - lon) * 6371000.0e0 * cos(radians(lat)) as ax, radians(a_lat - lat) * 6371000.0e0 as ay,
    radians(b_lon - lon) * 6371000.0e0 * cos(radians(lat)) as bx, radians(b_lat - lat) * 6371000.0e0 as by_"""
RATIO = "greatest(0.0e0, least(1.0e0, -(ax * (bx - ax) + ay * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))))"
SNAPPED = "sqrt(pow(ax + (bx - ax) * ratio, 2) + pow(ay + (by_ - ay) * ratio, 2))"
SNAP = f"""with {duck("fx_track_points", "fx_lane_points")},
{LANES},
origins as (select user_id, arg_min(lon, i) as lon, arg_min(lat, i) as lat from fx_track_points group by user_id),
{SEGMENTS},
flat as (select user_id, s.*, lon, lat, {FLAT} from origins cross join segments s),
placed as (select *, {RATIO} as ratio from flat),
near as (select user_id, lane, segment_index, before_m + hop_m * ratio as offset_m, {SNAPPED} as snap_dist_m from placed),
one as (select *, row_number() over (partition by user_id, lane order by snap_dist_m, segment_index) as nth from near),
ranked as (select *, row_number() over (partition by user_id order by snap_dist_m, lane) as rank from one where nth = 1)
select user_id, uid, rank, round(snap_dist_m, 6) as snap_dist_m, round(offset_m, 6) as offset_m, round(greatest(0, length_m - offset_m), 6) as remain_m
from ranked join lanes using (lane) where rank <= 5"""


@registered(SNAP)
def lane_snap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    origins = tracks.ends(points_of(spark, sf_dir), USER, "i").select("user_id", F.col("origin_lon").alias("lon"), F.col("origin_lat").alias("lat"))
    return rounded(snapping.nearest_lanes(origins, lanes(spark, sf_dir), USER, 5).select("user_id", "uid", "rank", "snap_dist_m", "offset_m", "remain_m"))


@registered(f"with {duck('fx_lane_points', 'fx_lane_links')},\n{LANES},\n{EDGES} select src, dst, round(weight, 6) as weight from topology")
def edges_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(network.topology_edges(links(spark, sf_dir), lanes(spark, sf_dir)))


@registered(f"with {duck('fx_lane_points', 'fx_lane_links')},\n{LANES},\n{EDGES} select src, dst, round(weight, 6) as weight from proximity")
def edges_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(network.proximity_edges(lanes(spark, sf_dir)))


@registered(f"with {duck('fx_lane_points', 'fx_lane_links')},\n{LANES},\n{EDGES} select src, dst, round(weight, 6) as weight from edges")
def edges_all_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(network.edges(links(spark, sf_dir), lanes(spark, sf_dir)))


SP = """e as (select src, dst, round(weight * 1000) as weight from edges),
sp(s, v, c) using key (s, v) as (
  select uid, uid, 0.0e0 from sources
  union
  select sp.s, e.dst, min(sp.c + e.weight) from sp join e on e.src = sp.v left join recurring.sp r on r.s = sp.s and r.v = e.dst
  where r.c is null or sp.c + e.weight < r.c group by sp.s, e.dst),
before as (select b.s, b.v, arg_min(a.v, (a.c, a.v)) as pred from sp a join e on e.src = a.v join sp b on b.s = a.s and b.v = e.dst and a.c + e.weight = b.c where b.s <> b.v group by b.s, b.v)"""
EVERY = 50
WAYS = f"with recursive {duck('fx_lane_points', 'fx_lane_links')},\n{LANES},\n{EDGES},\nsources as (select uid from lanes where lane % {EVERY} = 1),\n{SP}"


def made_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lanes, put together once for all steps that ask for them."""
    return written(lanes(spark, sf_dir), "lanes")


def millimetre_edges(known: DataFrame, own: DataFrame) -> DataFrame:
    """Weights in whole millimetres: sums are exact in either engine, so equally short ways stay equal."""
    return network.edges(known, own).withColumn("weight", F.round(F.col("weight") * 1000))


def from_every_lane(spark: SparkSession, sf_dir: str, preds: bool) -> DataFrame:
    """Ways from lanes 1, 51, 101 and so on to all lanes."""
    own = made_lanes(spark, sf_dir)
    return paths.from_sources(millimetre_edges(links(spark, sf_dir), own), own.filter(F.col("lane_ord") % EVERY == 1).select(F.col("uid").alias("src")), preds)


@registered(f"{WAYS} select s as src, v as dst, c as cost from sp")
def sp_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_every_lane(spark, sf_dir, preds=False).drop("pred")


@registered(f"{WAYS} select sp.s as src, sp.v as dst, pred from sp left join before using (s, v)")
def sp_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_every_lane(spark, sf_dir, preds=True).drop("cost")


ROUTES = f"""with recursive {duck("fx_track_points", "fx_lane_points", "fx_lane_links")},
{LANES},
{EDGES},
ends as (
  select user_id, 'o' as side, arg_min(lon, i) as lon, arg_min(lat, i) as lat from fx_track_points group by user_id
  union all select user_id, 'd', arg_max(lon, i), arg_max(lat, i) from fx_track_points group by user_id),
{SEGMENTS},
flat as (select user_id, side, s.*, lon, lat, {FLAT} from ends cross join segments s),
placed as (select *, {RATIO} as ratio from flat),
near as (select user_id, side, lane, segment_index, before_m + hop_m * ratio as offset_m, a_lon + (b_lon - a_lon) * ratio as lon, a_lat + (b_lat - a_lat) * ratio as lat, {SNAPPED} as snap_m from placed),
one as (select *, row_number() over (partition by user_id, side, lane order by snap_m, segment_index) as nth from near),
ranked as (select *, row_number() over (partition by user_id, side order by snap_m, lane) as rank from one where nth = 1),
cand as (select user_id, side, uid, rank, snap_m, offset_m, greatest(0, length_m - offset_m) as remain_m, lon, lat from ranked join lanes using (lane) where rank <= 5),
sources as (select distinct uid from cand where side = 'o'),
{SP},
pairs as (select o.user_id, o.uid as o_uid, d.uid as d_uid, o.rank as o_rank, d.rank as d_rank, o.snap_m + d.snap_m as snap_m,
    o.offset_m as o_offset, o.remain_m as o_remain, d.offset_m as d_offset, o.lon as o_lon, o.lat as o_lat, d.lon as d_lon, d.lat as d_lat
  from cand o join cand d on o.user_id = d.user_id and o.side = 'o' and d.side = 'd'),
walk(s, d, v, path) as (
  select o_uid, d_uid, d_uid, [d_uid] from (select distinct o_uid, d_uid from pairs) p join sp on sp.s = o_uid and sp.v = d_uid
  union all
  select w.s, w.d, b.pred, list_prepend(b.pred, w.path) from walk w join before b on b.s = w.s and b.v = w.v where w.v <> w.s),
ways as (select s, d, path from walk where v = s),
steps as (select s, d, len(path) as n, unnest(path) as uid, unnest(range(len(path))) as pos from ways),
hops as (
  select a.s, a.d, b.pos, b.n, b.uid, case when exists (select 1 from fx_lane_links l where cast(l.src as varchar) = a.uid and cast(l.dst as varchar) = b.uid) then 0.0e0 else {GAP.replace("a.e_", "x.e_").replace("b.s_", "y.s_")} end as jump_m, y.length_m
  from steps a join steps b on a.s = b.s and a.d = b.d and b.pos = a.pos + 1 join lanes x on x.uid = a.uid join lanes y on y.uid = b.uid),
through as (select s, d, sum(jump_m order by pos) as jump_m, coalesce(sum(case when pos < n - 1 then length_m end order by pos), 0) as middle_m from hops group by s, d),
raw as (
  select p.*, w.path, sp.c as cost, coalesce(t.jump_m, 0) as jump_m, case when len(path) = 1 then d_offset - o_offset else o_remain + coalesce(t.middle_m, 0) + d_offset end as lane_m
  from pairs p join ways w on w.s = p.o_uid and w.d = p.d_uid join sp on sp.s = p.o_uid and sp.v = p.d_uid left join through t on t.s = p.o_uid and t.d = p.d_uid),
measured as (
  select *, lane_m + jump_m + snap_m as total_m, round(lane_m + jump_m * 10 + snap_m * 5, 6) as objective_m from raw where len(path) > 1 or lane_m >= 0),
best as (
  select *, row_number() over (partition by user_id order by objective_m, o_rank, d_rank) as nth, count(*) over (partition by user_id) as tried_count from measured)"""


def of_tracks(spark: SparkSession, sf_dir: str, own: DataFrame, of=lambda tried, key: tried) -> DataFrame:
    """of() the candidates of every track with their metrics, over the network in millimetres; the objective is rounded before it
    decides, so that equal ones are equal in either engine."""
    known = links(spark, sf_dir)
    tried = lambda trips, key: routes.tried(trips, own, known, millimetre_edges(known, own), key).withColumn("objective_m", F.round("objective_m", 6))
    return routes.once_a_trip(tracks.ends(points_of(spark, sf_dir), USER, "i"), USER, lambda trips, key: of(tried(trips, key), key))


def planned(spark: SparkSession, sf_dir: str, own: DataFrame) -> DataFrame:
    return of_tracks(spark, sf_dir, own, routes.best)


@registered(
    f"{ROUTES} select user_id, o_uid, d_uid, o_rank, d_rank, cost, round(lane_m, 6) as lane_m, round(jump_m, 6) as jump_m, round(snap_m, 6) as snap_m, round(total_m, 6) as total_m, objective_m from measured"
)
def route_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(of_tracks(spark, sf_dir, made_lanes(spark, sf_dir), lambda tried, key: tried.drop("path")).select("user_id", "o_uid", "d_uid", "o_rank", "d_rank", "cost", "lane_m", "jump_m", "snap_m", "total_m", "objective_m"))


@registered(f"{ROUTES} select user_id, o_uid, d_uid, array_to_string(path, ',') as path, round(total_m, 6) as total_m, objective_m, tried_count from best where nth = 1")
def route_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(planned(spark, sf_dir, made_lanes(spark, sf_dir)).select("user_id", "o_uid", "d_uid", F.array_join("path", ",").alias("path"), "total_m", "objective_m", "tried_count"))


@registered(
    f"{ROUTES},\n{DEDUP},\n{STEPS.replace('fx_track_points', 'kept')},\ndriven as (select user_id, count(*) as n, coalesce(sum(step_m), 0) as m from steps_ group by user_id)".replace("steps as (\n  select user_id, i", "steps_ as (\n  select user_id, i")
    + " select user_id, n as history_point_count, round(m, 3) as history_distance_m, round(total_m, 3) as planned_distance_m, round(m - total_m, 3) as distance_difference_m, o_uid as start_lane_uid, d_uid as end_lane_uid,"
    " len(path) as planned_lane_count, array_to_string(path, ',') as planned_lane_uids, tried_count, round(objective_m, 3) as objective_m, round(snap_m, 3) as snap_distance_m, round(jump_m, 3) as jump_distance_m"
    " from best join driven using (user_id) where nth = 1"
)
def route_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = routes.summary(planned(spark, sf_dir, made_lanes(spark, sf_dir)), histories(spark, sf_dir), USER)
    return rounded(rows.withColumn("planned_lane_uids", F.array_join("planned_lane_uids", ",")), 3)


@registered(
    f"{ROUTES},\nparts as (select user_id, unnest(path) as uid, unnest(range(len(path))) as pos, len(path) as n, o_offset, d_offset, o_lon, o_lat, d_lon, d_lat from best where nth = 1)"
    " select user_id, cast(pos as int) as pos, uid, round(case when pos = n - 1 then d_offset else length_m end - case when pos = 0 then o_offset else 0 end, 3) as length_m,"
    " round(case when pos = 0 then o_lon else s_lon end, 6) as from_lon, round(case when pos = 0 then o_lat else s_lat end, 6) as from_lat,"
    " round(case when pos = n - 1 then d_lon else e_lon end, 6) as to_lon, round(case when pos = n - 1 then d_lat else e_lat end, 6) as to_lat from parts join lanes using (uid)"
)
def route_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and ends of the drawn part of every lane of the best routes."""
    own = made_lanes(spark, sf_dir)
    parts = routes.visible(planned(spark, sf_dir, own), own, USER)
    end = lambda place, axis, name: F.round(F.element_at("points", place)[axis], 6).alias(name)
    ends = [end(1, "lon", "from_lon"), end(1, "lat", "from_lat"), end(-1, "lon", "to_lon"), end(-1, "lat", "to_lat")]
    return parts.select("user_id", F.col("pos").cast("int").alias("pos"), "uid", F.round(polyline_m(F.col("points")), 3).alias("length_m"), *ends)


DRAWN = """vertices as (select lane, list({'way': way_m, 'lon': lon, 'lat': lat} order by k) as points from walked group by lane),
parts as (select user_id, unnest(path) as uid, unnest(range(len(path))) as pos, len(path) as n, o_offset, d_offset, o_lon, o_lat, d_lon, d_lat from best where nth = 1),
cut as (
  select *, pos > 0 and pos < n - 1 as whole, case when pos = 0 then o_offset else 0 end as a, case when pos = n - 1 then d_offset else length_m end as b,
    {'way': null, 'lon': case when pos = 0 then o_lon else s_lon end, 'lat': case when pos = 0 then o_lat else s_lat end} as start_point,
    {'way': null, 'lon': case when pos = n - 1 then d_lon else e_lon end, 'lat': case when pos = n - 1 then d_lat else e_lat end} as end_point
  from parts join lanes using (uid) join vertices using (lane)),
begun as (select *, list_concat([start_point], list_filter(points, lambda v: v.way > a + 1e-9 and v.way < b - 1e-9 and b - a > 1e-6)) as line from cut),
drawn as (
  select user_id, pos, uid, case when whole then points when b - a > 1e-6 and (abs(line[-1].lon - end_point.lon) >= 1e-12 or abs(line[-1].lat - end_point.lat) >= 1e-12) then list_append(line, end_point) else line end as line from begun)"""


@registered(
    f"""{ROUTES},
{DRAWN}
select user_id, cast(pos as int) as pos, uid, cast(v as int) as vertex, round(line[v + 1].lon, 6) as lon, round(line[v + 1].lat, 6) as lat
from (select *, unnest(range(len(line))) as v from drawn)"""
)
def route_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every drawn vertex of the best routes, lane by lane."""
    own = made_lanes(spark, sf_dir)
    parts = routes.visible(planned(spark, sf_dir, own), own, USER)
    rows = parts.select("user_id", F.col("pos").cast("int").alias("pos"), "uid", F.posexplode("points").alias("vertex", "p"))
    return rows.select("user_id", "pos", "uid", "vertex", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))


BOXES = "boxes as (select area_type, min(lat) as south, min(lon) as west, max(lat) as north, max(lon) as east from fx_area_points group by area_type)"


@registered(
    f"with {duck('fx_track_points', 'fx_area_points')}, {BOXES}"
    " select user_id, i, area_type from fx_track_points join boxes on user_id % 9 = area_type where lat between south and north and lon between west and east"
)
def bbox_point_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = tracks.boxes(view(spark, sf_dir, "fx_area_points"), ["area_type"])
    points = points_of(spark, sf_dir).withColumn("area_type", (F.col("user_id") % 9).cast("int"))
    return tracks.inside(points, box, ["area_type"]).select("user_id", "i", "area_type")


@registered(
    f"with {duck('fx_track_points', 'fx_area_points')},"
    " boxes as (select user_id, min(lat) as south, min(lon) as west, max(lat) as north, max(lon) as east from fx_track_points group by user_id)"
    " select user_id, count(distinct area) as areas, min(area) as first_area from boxes join fx_area_points on lat between south and north and lon between west and east group by user_id"
)
def area_bbox_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = tracks.boxes(points_of(spark, sf_dir), USER)
    return features.counted_by_boxes(view(spark, sf_dir, "fx_area_points").select("area", "lon", "lat"), "area", box, USER).withColumnsRenamed({"features": "areas", "first": "first_area"})


@registered(
    "select event_type as sn, cast(user_id as varchar) as task_id, event_id from (select *, row_number() over (partition by event_type, user_id order by ts, event_id) as nth from events) x where nth = 1"
)
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("sn"), F.col("user_id").cast("string").alias("task_id"), "ts", "event_id")
    return tracks.first_match(rows, ["ts", "event_id"]).select("sn", "task_id", "event_id")


@registered("select c_custkey, case when regexp_extract(c_name, '^[A-Za-z0-9]+') = '' then c_name else regexp_extract(c_name, '^[A-Za-z0-9]+') end as device from customer")
def device_id_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", device_id(F.col("c_name")).alias("device"))
