"""Task and map-resource JSON files as DataFrames, with the rows that could not be read kept apart.

Files are read whole and parsed to VARIANT, since one file may hold a list, a single object or nothing usable. The lenient
way (lookup) strips a byte-order mark and drops items that are no objects; the strict way (batch) takes neither.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from lanewright.functions.arrays import POINTS
from lanewright.functions.geo import polyline_m
from lanewright.functions.text import device_id, stripped
from lanewright.settings import DEFAULT, Settings

BOM = "\ufeff"
#: Field names of the resource file (type id, type name, name, payload).
TYPE_ID, TYPE_NAME, NAME, PAYLOAD = "资源类型ID", "资源类型", "资源名称", "数据"


def got(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def given(value: Column, path: str) -> Column:
    """Whether there is a value other than null at a path."""
    return F.coalesce(F.schema_of_variant(got(value, path, "variant")) != "VOID", F.lit(False))


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def is_array(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))


def files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """file, stem, order (path components, as files are searched) and text of every JSON file."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.json")  # the text reader hides a byte-order mark
    return texts_of(read.load(path))


def texts_of(read: DataFrame) -> DataFrame:
    """file, stem, order and text of binary files."""
    order = F.split("path", "/")
    return read.select(F.col("path").alias("file"), F.regexp_replace(F.element_at(order, -1), r"\.json$", "").alias("stem"), order.alias("order"), F.col("content").cast("string").alias("text"))


def existing(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """files(), or FileNotFoundError where the path isn't there or has no JSON file."""
    try:
        found = files(spark, path, recursive)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(path) from error
        raise
    if found.select("file").isEmpty():
        raise FileNotFoundError(f"no JSON file under {path}")
    return found


def records(texts: DataFrame, strict: bool = False, scalars: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): file, stem, order, pos, record per item; file, reason per file that can't be read.

    A file that holds neither a list nor an object has no records; it is rejected when strict, or unless scalars are let pass.
    """
    marked = F.startswith("text", F.lit(BOM))
    body = F.when(marked, F.lit(None)).otherwise(F.col("text")) if strict else F.when(marked, F.substring("text", 2, 2**31 - 1)).otherwise(F.col("text"))
    parsed = texts.withColumn("root", F.try_parse_json(body))
    usable = is_object(F.col("root")) | is_array(F.col("root"))
    reason = F.when(F.col("root").isNull(), "not JSON")
    reason = reason.when(~usable, "neither a list nor an object") if strict or not scalars else reason
    rejects = parsed.select("file", reason.alias("reason")).filter("reason is not null")
    items = F.when(is_object(F.col("root")), F.array("root")).otherwise(got(F.col("root"), "$", "array<variant>"))
    found = parsed.filter(usable).select("file", "stem", "order", F.posexplode(items).alias("pos", "record"))
    return (found if strict else found.filter(is_object(F.col("record")))), rejects


def as_text(value: Column, path: str) -> Column:
    """A field as compared text: stripped; 'None' where absent or null."""
    return stripped(F.coalesce(got(value, path, "string"), F.lit("None")))


def messages(value: Column) -> Column:
    """rt_message as array of structs lon, lat, timestamp (text), speed, unread (it is no object, or a number among them can't be
    read), kind and number of the time (0: text or absent, 1: a number, 2: neither); null where it is no list."""
    unread = lambda m, name: got(m, f"$.{name}", "string").isNotNull() & got(m, f"$.{name}", "double").isNull()
    odd = lambda m, name: unread(m, name) | is_array(got(m, f"$.{name}", "variant")) | is_object(got(m, f"$.{name}", "variant"))
    there = lambda m: given(m, "$.longitude") & given(m, "$.latitude")
    time = lambda m: F.schema_of_variant(got(m, "$.received_at", "variant"))
    number = lambda m: got(m, "$.received_at", "double")
    kind = lambda m: F.when((time(m) == "STRING") | ~has(m, "received_at"), 0).when(time(m).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)"), 1).otherwise(2)
    one = lambda m: F.struct(
        got(m, "$.longitude", "double").alias("lon"), got(m, "$.latitude", "double").alias("lat"),
        got(m, "$.received_at", "string").alias("timestamp"), got(m, "$.speed", "double").alias("speed"),
        (~is_object(m) | (there(m) & (odd(m, "longitude") | odd(m, "latitude") | odd(m, "speed")))).alias("unread"),
        F.when(is_object(m), kind(m)).alias("kind"), F.when(kind(m) == 1, number(m)).alias("number"),
    )
    return F.transform(got(value, "$.rt_message", "array<variant>"), one)


def tasks(found: DataFrame) -> DataFrame:
    """Tasks of the lookup way, their points in the order of the file. bad: no list of messages, or one of them lacks a
    coordinate; such a task has no points."""
    rows = found.select("file", "order", "pos", as_text(F.col("record"), "$.sn").alias("sn"), as_text(F.col("record"), "$.task_id").alias("task_id"), messages(F.col("record")).alias("messages"))
    bad = F.col("messages").isNull() | F.exists("messages", lambda m: m["lon"].isNull() | m["lat"].isNull())
    points = F.transform("messages", lambda m: F.struct(m["lon"].alias("lon"), m["lat"].alias("lat"), F.lit(None).cast("double").alias("z"), m["timestamp"].alias("timestamp")))
    return rows.withColumns({"bad": bad, "points": F.when(bad, F.array().cast(POINTS)).otherwise(points)}).drop("messages")


def batch_tasks(found: DataFrame) -> DataFrame:
    """Tasks of the batch way: messages by time (stable), those without coordinates left out, defaults for absent fields.

    An explicit null stays null. device comes from the file's stem. bad spoils the whole file: the item or a message is no object,
    a number can't be read, or two times can't be compared (text, numbers and others among each other; an absent one is an empty text).
    """
    field = lambda name, default: F.when(has(F.col("record"), name), got(F.col("record"), f"$.{name}", "string")).otherwise(F.lit(default))
    found, all_ = found.withColumn("messages", messages(F.col("record"))), F.col("messages")  # read once for all that follows
    place = lambda m, i: F.struct(F.coalesce(m["number"], F.lit(0.0)).alias("number"), F.coalesce(m["timestamp"], F.lit("")).alias("timestamp"), i.alias("pos"), m["lon"].alias("lon"), m["lat"].alias("lat"), m["speed"].alias("speed"))
    placed = F.transform(all_, lambda m, i: F.when(m["kind"] == 1, place(m, i).withField("timestamp", F.lit(""))).otherwise(place(m, i)))
    kinds = F.array_distinct(F.transform(all_, lambda m: m["kind"]))
    mixed = (F.size(all_) > 1) & ((F.size(kinds) > 1) | F.array_contains(kinds, 2))
    valid = F.filter(F.array_sort(placed), lambda m: m["lon"].isNotNull() & m["lat"].isNotNull())
    return found.select(
        "file", "order", "pos", device_id(F.col("stem")).alias("device"), field("task_id", "unknown").alias("task_id"),
        field("actual_start_time", "").alias("start_time"), field("actual_end_time", "").alias("end_time"),
        (~is_object(F.col("record")) | F.coalesce(F.exists(all_, lambda m: m["unread"]) | mixed, F.lit(False))).alias("bad"),
        F.coalesce(F.transform(valid, lambda m: m.dropFields("number")), F.array().cast("array<struct<timestamp:string,pos:int,lon:double,lat:double,speed:double>>")).alias("points"),
    )


def has(value: Column, name: str) -> Column:
    """Whether an object has a field at all, null or not."""
    return F.array_contains(F.map_keys(got(value, "$", "map<string,variant>")), name)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def payload(record: Column) -> Column:
    """The payload object: itself, or parsed from text; null for anything else."""
    parsed = lambda raw: F.when(is_object(raw), raw).otherwise(F.try_parse_json(got(record, f"$['{PAYLOAD}']", "string")))
    whole = lambda raw: bound(parsed(raw), lambda p: F.when(is_object(p), p))
    return bound(got(record, f"$['{PAYLOAD}']", "variant"), whole)


def id_list(value: Column, path: str) -> Column:
    """Ids of a field: a list's stripped texts without empty ones and 'None', a scalar as a list of one, else none."""
    raw = got(value, path, "variant")
    many = F.transform(got(value, path, "array<variant>"), lambda v: stripped(F.coalesce(got(v, "$", "string"), F.lit("None"))))
    one = F.array(stripped(got(value, path, "string")))
    ids = F.when(is_array(raw), many).when(got(value, path, "string").isNotNull(), one).otherwise(F.array().cast("array<string>"))
    return F.filter(ids, lambda t: ~t.isin("", "None"))


def curve(value: Column) -> Column:
    """Points of the centre line, segment after segment, joints repeated; points without numbers left out."""
    point = lambda p: F.struct(got(p, "$.x", "double").alias("lon"), got(p, "$.y", "double").alias("lat"), got(p, "$.z", "double").alias("z"), F.lit(None).cast("string").alias("timestamp"))
    readable = lambda p: got(p, "$.x", "double").isNotNull() & got(p, "$.y", "double").isNotNull() & (got(p, "$.z", "string").isNull() | got(p, "$.z", "double").isNotNull())
    segment = lambda s: F.transform(F.filter(F.coalesce(got(s, "$.line_segment.point", "array<variant>"), F.array().cast("array<variant>")), readable), point)
    return F.coalesce(F.flatten(F.transform(got(value, "$.central_curve.segment", "array<variant>"), segment)), F.array().cast(POINTS))


def joined_curve(value: Column) -> Column:
    """The centre line of the batch way: a segment's first point is left out where it equals the last one so far."""
    point = lambda p: F.struct(got(p, "$.x", "double").alias("lon"), got(p, "$.y", "double").alias("lat"))
    whole = lambda s: F.filter(F.transform(got(s, "$.line_segment.point", "array<variant>"), point), lambda p: p["lon"].isNotNull() & p["lat"].isNotNull())
    parts = F.filter(F.transform(got(value, "$.central_curve.segment", "array<variant>"), whole), lambda p: F.size(p) > 0)

    def cut(all_: Column) -> Column:
        again = lambda p, i: (i > 0) & (F.element_at(F.get(all_, i - 1), -1) == F.element_at(p, 1))
        return F.flatten(F.transform(all_, lambda p, i: F.when(again(p, i), F.slice(p, F.lit(2), F.size(p))).otherwise(p)))

    none = F.array().cast("array<struct<lon:double,lat:double>>")
    return F.coalesce(F.element_at(F.transform(F.array(parts), cut), 1), none)


def area(value: Column) -> Column:
    point = lambda p: F.struct(got(p, "$.x", "double").alias("lon"), got(p, "$.y", "double").alias("lat"))
    return F.filter(F.transform(got(value, "$.polygon.point", "array<variant>"), point), lambda p: p["lon"].isNotNull() & p["lat"].isNotNull())


def type_number(record: Column) -> Column:
    """The type id where it is a number, not text."""
    raw = got(record, f"$['{TYPE_ID}']", "variant")
    return F.when(F.schema_of_variant(raw).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), got(record, f"$['{TYPE_ID}']", "double"))


def lanes(found: DataFrame, settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(lanes, rejects): one row per uid, the last one's values at the first one's place (lane_ord).

    Lanes of a kept type without a usable point are rejected. An absent uid is the text 'None'.
    """
    types = [t for t in settings.lane_type_ids if t != settings.temporary_type_id or settings.use_temporary_lanes]
    kept = found.withColumn("type_id", type_number(F.col("record"))).filter(F.col("type_id").isin([float(t) for t in types])).withColumn("data", payload(F.col("record")))
    text = lambda path: got(F.col("data"), path, "string")
    rows = kept.select(
        "file", F.struct("order", "pos").alias("place"), F.coalesce(text("$.uid"), F.lit("None")).alias("uid"), got(F.col("record"), f"$['{NAME}']", "string").alias("name"),
        F.col("type_id").cast("int"), got(F.col("record"), f"$['{TYPE_NAME}']", "string").alias("type_name"), curve(F.col("data")).alias("points"),
        text("$.width").alias("width"), text("$.speed_limit").alias("speed_limit"), text("$.direction").alias("direction"), text("$.temp_road").alias("temp_road"),
        id_list(F.col("data"), "$.successor_uid").alias("successor_uid"), id_list(F.col("data"), "$.predecessor_uid").alias("predecessor_uid"),
    )
    rejects = rows.filter(F.size("points") == 0).select("file", F.concat(F.lit("lane without points: "), "uid").alias("reason"))
    good = rows.filter(F.size("points") > 0)
    values = [c for c in good.columns if c not in ("uid", "place", "file")]
    numbers = good.select("place.order").distinct().select("order", (F.row_number().over(Window.orderBy("order")) - 1).alias("file_no"))  # a row per resource file
    good = good.join(numbers, good["place.order"] == numbers["order"]).withColumn("place", F.col("file_no") * F.lit(1 << 32) + F.col("place.pos"))
    last = good.groupBy("uid").agg(F.min("place").alias("lane_ord"), F.max_by(F.struct(*values), "place").alias("v"))
    ranked = last.select("uid", "lane_ord", *[F.col(f"v.{c}").alias(c) for c in values])
    return ranked.withColumns({"length_m": polyline_m(F.col("points")), "start_point": F.element_at("points", 1), "end_point": F.element_at("points", -1)}), rejects


def spoiled(point: Column) -> Column:
    """Whether a vertex has both coordinates and one of them is no number."""
    wrong = lambda axis: got(point, f"$.{axis}", "double").isNull()
    return is_object(point) & given(point, "$.x") & given(point, "$.y") & (wrong("x") | wrong("y"))


def shapes(found: DataFrame) -> DataFrame:
    """Of every item its feature (the place of the item, which tells equal resources apart), labels, payload's area (ring) and centre line
    (line), there (it has a payload object), and the reason why the batch way can't read its file: it is no object, or a coordinate no number.

    A payload is parsed once for all of these; store the rows where more than one is asked for.
    """

    def of(data: Column) -> Column:
        listed = lambda x: F.coalesce(x, F.array().cast("array<variant>"))
        curves = F.flatten(F.transform(got(data, "$.central_curve.segment", "array<variant>"), lambda s: listed(got(s, "$.line_segment.point", "array<variant>"))))
        wrong = F.exists(F.concat(listed(got(data, "$.polygon.point", "array<variant>")), listed(curves)), spoiled)
        return F.struct(data.isNotNull().alias("there"), area(data).alias("ring"), joined_curve(data).alias("line"), wrong.alias("wrong"))

    record = F.col("record")
    rows = found.select("file", F.struct("order", "pos").alias("feature"), "record", F.map_keys(got(record, "$", "map<string,variant>")).alias("keys"), bound(payload(record), of).alias("of"))
    label = lambda key: F.when(F.array_contains("keys", key), got(record, f"$['{key}']", "string")).otherwise(F.lit(""))
    reason = F.when(~is_object(record), "an item that is no object").when(F.col("of.wrong"), "a coordinate that is no number")
    return rows.select("file", "feature", label(NAME).alias("name"), label(TYPE_NAME).alias("type"), label(TYPE_ID).alias("type_id"), "of.there", "of.ring", "of.line", reason.alias("reason"))


def unusable(shapes_: DataFrame) -> DataFrame:
    """file, reason of the resource files that the batch way can't read, from shapes()."""
    return shapes_.select("file", "reason").filter("reason is not null").distinct()


def drawable(shapes_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(areas, lines) of shapes(): one resource can give both; an item without a payload object gives none."""
    none = lambda c: F.coalesce(F.col(c), F.lit("None"))
    rows = shapes_.filter("there").withColumn("tooltip", F.concat(none("name"), F.lit(" | "), none("type"), F.lit(" | 类型ID="), none("type_id")))
    columns = ["feature", "name", "type", "type_id", "tooltip"]
    areas = rows.filter(F.size("ring") >= 3).select(*columns, F.col("ring").alias("points"))
    lines = rows.filter(F.size("line") >= 2).select(*columns, F.col("line").alias("points"))
    return areas, lines.withColumn("raw_count", F.size("points").cast("long"))


def features(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(areas, lines) of the batch way. Files that are unusable() should be kept out or raise."""
    return drawable(shapes(found))
