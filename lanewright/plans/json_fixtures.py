"""JSON files derived from the driver's tables, and the same records in SQL.

One SQL text makes the records in both engines: fields missing, null, of other types or unreadable, payloads as objects and as text,
repeated ids. Spark puts them into files, some with a byte-order mark, with items that are no records, or broken, and reads
these back through the sources; DuckDB reads the records with its own JSON functions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.sources.json_files import BOM
from lanewright.sources.text_files import write_texts
from lanewright.storage import shared_folder, written

PER_FILE, PER_TASK, USERS = 50, 25, 5


def point(j: int, bad: str) -> str:
    """Vertex j of lane k as JSON. x can be text, null or absent; z too; bad stands for a number that can't be read."""
    x = f"'110.' || lpad(cast((k % 20) * 100 + {j * 30} as string), 5, '0')"
    y = f"cast(40 + n div 100000 as string) || '.' || lpad(cast(n % 100000 + {j % 3} as string), 5, '0')"
    return (
        f"'{{' || case when k % 7 = 2 and {j} = 1 then '\"x\": {bad}, ' when k % 7 = 3 and {j} = 2 then '\"x\": null, ' when k % 37 = 5 and {j} = 2 then '' when k % 5 = 0 then '\"x\": \"' || {x} || '\", ' else '\"x\": ' || {x} || ', ' end"
        f" || '\"y\": ' || {y} || case k % 4 when 0 then ', \"z\": 3' when 1 then ', \"z\": null' when 2 then '' else case when k % 17 = 3 and {j} = 3 then ', \"z\": {bad}' else ', \"z\": \"4.5\"' end end || '}}'"
    )


def resources(bad: str) -> str:
    """k, file_no, record: map resources, one per part."""
    p = [point(j, bad) for j in range(4)]
    curve = f"""'{{"segment": [{{"line_segment": {{"point": [' || {p[0]} || ', ' || {p[1]} || ']}}}}, "stray", {{"line_segment": null}}, {{"line_segment": {{"point": [' || {p[1]} || ', 5, ' || {p[2]} || ', ' || {p[3]} || ']}}}}]}}'"""
    after = """case k % 6 when 0 then ', "successor_uid": [' || (k + 1) || ', null, " None ", " 12 ", ""]' when 1 then ', "successor_uid": ' || (k + 1) when 2 then ', "successor_uid": " ' || (k + 1) || ' "' when 3 then ', "successor_uid": null' when 4 then '' else ', "successor_uid": []' end"""
    uid = "case when k % 97 = 0 then '' when k % 2 = 0 then '\"uid\": ' || u || ', ' else '\"uid\": \"' || u || '\", ' end"
    shape = f"""case k % 4 when 1 then ', "polygon": {{"point": [' || {p[0]} || ', ' || {p[2]} || ', ' || {p[3]} || ', "stray"]}}' when 2 then ', "polygon": {{"point": [' || {p[0]} || ']}}' else '' end"""
    payload = f"""'{{' || {uid} || '"width": 3.5, "speed_limit": "' || k % 60 || '", "direction": null, "temp_road": ' || case when k % 2 = 0 then 'true' else 'false' end || {after} || ', "predecessor_uid": "' || (k - 1) || '", "central_curve": ' || case when k % 31 = 7 then 'null' else {curve} end || {shape} || '}}'"""
    quoted = "'\"' || replace(payload, '\"', chr(92) || '\"') || '\"'"
    return f"""
select k, file_no, '{{"资源类型ID": ' || case k % 11 when 0 then '116' when 1 then '7' when 2 then '"101"' when 3 then '101.0' else '101' end || ', "资源类型": "lane"'
  || case when k % 29 = 1 then '' when k % 23 = 0 then ', "资源名称": null' else ', "资源名称": "n' || k || '"' end
  || ', "数据": ' || case when k % 19 = 4 then '"{{broken"' when k % 3 = 0 then {quoted} else payload end || '}}' as record
from (select k, file_no, {payload} as payload
      from (select p_partkey as k, p_partkey div {PER_FILE} as file_no, (p_partkey div 20) * 80 as n, case when p_partkey % 13 = 5 then p_partkey - 1 else p_partkey end as u from {{part}}) a) b"""


MESSAGES = f"""
select user_id, t, i, '{{' || case when user_id % 6 = 1 and i % 13 = 5 then '"longitude": null, ' when i % 3 = 0 then '"longitude": "' || lon || '", ' else '"longitude": ' || lon || ', ' end || '"latitude": ' || lat
  || case when i % 10 = 7 then '' else ', "received_at": "' || lpad(cast((i * 7919) % 97 as string), 3, '0') || '"' end || case when i % 4 = 1 then ', "speed": null' else ', "speed": ' || speed end || '}}' as message
from (select user_id, i, i div {PER_TASK} as t, speed, '110.' || lpad(cast((user_id * 37 + s * 7) % 2000 as string), 5, '0') as lon, '40.' || lpad(cast((user_id * 53 + s * 3) % 1600 as string), 5, '0') as lat
      from (select user_id, i, speed, i - i div 5 as s
            from (select user_id, cast(floor(value) as bigint) as speed, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as i from {{events}}) x) a) b"""
FIELDS = f"""
select user_id, t, user_id div {USERS} as file_no, '"sn": ' || case user_id % 3 when 0 then cast(user_id % 10 as string) when 1 then '" ' || user_id % 10 || ' "' else '"S' || user_id % 10 || '"' end
  || case when t % 11 = 10 then '' when t % 2 = 0 then ', "task_id": ' || t else ', "task_id": " ' || t || '"' end
  || case t % 3 when 0 then '' when 1 then ', "actual_start_time": null' else ', "actual_start_time": "s' || t || '"' end as fields, t % 9 = 8 as silent
from (select distinct user_id, i div {PER_TASK} as t from (select user_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as i from {{events}}) x) a"""
VIEWS = {"fx_resources": (resources('"east"'), "part"), "fx_features": (resources("null"), "part"), "fx_messages": (MESSAGES, "events"), "fx_fields": (FIELDS, "events")}


def over(name: str, place: str) -> str:
    """The SQL of a view over a table that stands at a place."""
    text, table = VIEWS[name]
    return text.replace(f"{{{table}}}", place)


def duck(*names: str) -> str:
    """The views as common table expressions."""
    return ",\n".join(f"{n} as ({over(n, VIEWS[n][1]).replace(' div ', ' // ')})" for n in names)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(over(name, f"parquet.`{sf_dir}/{VIEWS[name][1]}.parquet`"))


#: Of the files of a folder: those broken, those with a byte-order mark, and those with items before and behind their records.
BROKEN, MARKED, STRAY = "file_no % 7 = 3", "file_no % 5 = 0", "file_no % 5 = 1"


def folder(records: DataFrame, order: list[str], plain: bool = False) -> str:
    """Writes the records (file_no, order, record) as JSON lists, a file each file_no, to the shared folder. Odd files unless plain."""
    spark = records.sparkSession
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "record"))), lambda r: r["record"]), ",\n")
    text = F.concat(F.lit("["), "items", F.lit("]"))
    if not plain:
        text = F.when(F.expr(BROKEN), F.concat(F.lit("["), "items")).when(F.expr(MARKED), F.concat(F.lit(BOM + "["), "items", F.lit("]")))
        text = text.when(F.expr(STRAY), F.concat(F.lit("[7, "), "items", F.lit(', "stray"]'))).otherwise(F.concat(F.lit("["), "items", F.lit("]")))
    name = F.concat(F.lit("f"), F.lpad(F.col("file_no").cast("string"), 9, "0"), F.lit(".json"))
    files = written(records.groupBy("file_no").agg(listed.alias("items")).select(name.alias("name"), text.alias("text")), "json-texts")
    target = f"{shared_folder(spark)}/lanewright/json-{uuid.uuid4().hex}"
    write_texts(files, target)
    return target


def resource_folder(spark: SparkSession, sf_dir: str, name: str, plain: bool = False) -> str:
    return folder(view(spark, sf_dir, name), ["k"], plain)


def task_folder(spark: SparkSession, sf_dir: str, plain: bool = False) -> str:
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "message"))), lambda m: m["message"]), ", ")
    messages = view(spark, sf_dir, "fx_messages").groupBy("user_id", "t").agg(listed.alias("messages"))
    list_ = F.when(F.col("silent"), F.lit("null")).otherwise(F.concat(F.lit("["), "messages", F.lit("]")))
    rows = view(spark, sf_dir, "fx_fields").join(messages, ["user_id", "t"])
    return folder(rows.select("user_id", "t", "file_no", F.concat(F.lit("{"), "fields", F.lit(', "rt_message": '), list_, F.lit("}")).alias("record")), ["user_id", "t"], plain)
