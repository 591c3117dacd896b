"""Sharding by a two-pass external shuffle, in DataFrame operations only.

First pass: rows scatter into memory-sized buckets by a seeded hash. Second pass: each bucket's rows, in the fixed order
of another hash, are permuted by a Fisher-Yates shuffle (Spark's shuffle() of the bucket's row numbers). Buckets stand
one after the other, so a row's place in the whole is its bucket's offset plus its place in the bucket; equal runs of
places are the shards, so their row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewright.llm.common import free, prefix_sums, written

ROW_BYTES = 16
MOST_TASKS = 20_000


def with_shards(docs: DataFrame, shards: int = 40, seed: int = 20, bucket_bytes: int = 8 << 20) -> DataFrame:
    """All columns of docs, then _size, _shard (from 0) and _slot (gapless from 0 in each shard), with further underscores
    before a name that docs has itself.

    Null texts have no bytes. Rows are told apart by doc_id and text; rows equal in both are interchangeable, and share a
    bucket. The permutations are written to the shared folder before use, so a task run again sees the same ones. An empty
    table stays empty. Texts are moved whole, however long, and one that is larger than a bucket fills one. Shards differ by one row at most, also where there are fewer rows than shards.
    """
    size, bucket, draw, count, offset, order, number, place, shard, slot = free(docs.columns, "_size", "_bucket", "_draw", "_rows", "_offset", "_order", "_number", "_place", "_shard", "_slot")
    rows = docs.withColumn(size, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES)
    n, total_size = rows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    buckets = max(1, -(-total_size // bucket_bytes))
    rows = rows.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(buckets))).withColumn(draw, F.xxhash64(F.lit(seed + 1), "doc_id", "text"))
    counts = prefix_sums(rows.groupBy(bucket).agg(F.count("*").alias(count)), [], bucket, count, offset)
    tasks = max(1, min(1000, buckets // 64))
    permuted = (
        counts.repartition(tasks, bucket).sortWithinPartitions(bucket)
        .select(bucket, offset, F.shuffle(F.sequence(F.lit(0), (F.col(count) - 1).cast("int")), F.lit(seed)).alias(order))
    )
    permuted = written(permuted, "bucket-order")
    # 8 buckets a task, so their number grows with the table, but no more tasks than a driver can look after: then each has more buckets
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, buckets // 8))
    nth = F.row_number().over(Window.partitionBy(bucket).orderBy(draw, "doc_id"))
    placed = rows.repartition(parts, bucket).withColumn(number, nth).join(permuted, bucket).withColumn(place, F.col(offset) + F.get(order, F.col(number) - 1))
    total = F.lit(max(1, n)).cast("long")
    placed = placed.withColumn(shard, F.expr(f"cast({place} * {shards}L div {max(1, n)}L as int)"))
    first = F.floor((F.col(shard) * total + (shards - 1)) / F.lit(shards)).cast("long")
    return placed.select(*docs.columns, size, shard, (F.col(place) - first).alias(slot))


def write_shards(sharded: DataFrame, path: str, tasks: int) -> None:
    """Writes the rows of with_shards as folders by shard, each in files that follow one another in slot order."""
    _, shard, slot = sharded.columns[-3:]
    sharded.repartitionByRange(tasks, shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def digest(sharded: DataFrame) -> DataFrame:
    size, shard, slot = sharded.columns[-3:]
    return sharded.select(
        "doc_id",
        F.col(size).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col(shard).alias("shard"),
        F.col(slot).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
