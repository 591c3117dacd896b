"""Helpers shared by the corpus operators: tables, shared storage, batches, order and prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local one only where that is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: cuts the lineage and fixes the rows against re-execution."""
    path = f"{shared_folder(df.sparkSession)}/lanewright/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores put before it as it takes to be none of the columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


BATCH_BYTES = 1 << 20
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_arrow(spark: SparkSession) -> None:
    """Batches of 4 MB to and from Python, unless the session names a size: an executor and its workers keep the buffers of the
    largest one, so Spark's own 64 MB cost several times that in each of them."""
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, "4m")


def parts(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows and BATCH_BYTES of text; a row with more of it stands alone."""
    ends = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            ends += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(ends)
    at = 0
    while at < batch.num_rows:
        full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES, "right"))
        end = max(at + 1, min(full, at + rows))
        yield batch.slice(at, end - at)
        at = end


def map_batches(df: DataFrame, function: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, rows: int = 128) -> DataFrame:
    """mapInArrow over parts() of at most `rows` rows. function() runs once a task and returns the batch function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = function()
        for batch in batches:
            for part in parts(batch, rows):
                yield apply(part)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    small_arrow(df.sparkSession)
    return df.mapInArrow(run, schema)


def keep_where(docs: DataFrame, function: Callable[[], Callable[[list], list[bool]]], rows: int = 128) -> DataFrame:
    """The rows of docs whose text function() finds worth keeping, all columns as they are: nothing is shuffled."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = function()
        for batch in batches:
            for part in parts(batch, rows):
                yield part.filter(pa.array(judge(part.column(at).to_pylist()), pa.bool_()))
        pa.default_memory_pool().release_unused()

    small_arrow(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod 3 is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once (a one-element transform binds it)."""
    return F.element_at(F.transform(F.array(value), body), 1)


FILTER_BITS = 1 << 24


def _places(columns: list[Column]) -> list[Column]:
    return [F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(FILTER_BITS)) for seed in (1, 2)]


def bits_of(keys: DataFrame) -> DataFrame:
    """One row with bits, a Bloom filter of the rows of keys: FILTER_BITS in longs (2 MB, however many rows), two of them set a row."""
    at = keys.select(F.explode(F.array(*_places([F.col(c) for c in keys.columns]))).alias("_at"))
    words = at.select(F.shiftright("_at", 6).alias("_word"), F.expr("shiftleft(1L, int(_at & 63))").alias("_bits"))
    every = words.union(keys.sparkSession.range(FILTER_BITS // 64).select("id", F.lit(0).cast("long")))
    listed = lambda *names: F.sort_array(F.collect_list(F.struct(*names))).getField(names[-1])
    runs = every.groupBy("_word").agg(F.bit_or("_bits").alias("_bits")).groupBy(F.shiftright("_word", 10).alias("_run")).agg(listed("_word", "_bits").alias("_of"))
    return runs.agg(F.flatten(listed("_run", "_of")).alias("bits"))


def perhaps_in(bits: DataFrame, *columns: Column) -> Column:
    """False only where no row of the keys of bits equals the columns (of the same types); a join settles the others."""
    of = bits.scalar()
    one, two = (F.getbit(F.get(of, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1 for at in _places(list(columns)))
    return one & two


def prefix_sums(df: DataFrame, keys: list[str], order: str, value: str, out: str, width: int = 1024) -> DataFrame:
    """Adds out: the sum of value over the rows of the same keys with a smaller order (integers from 0, unique within keys).

    Sums within runs of `width` orders first, then over the runs, so that a key with most rows is spread over many tasks.
    """
    run = F.floor(F.col(order) / width).alias("_run")
    runs = df.groupBy(*keys, run).agg(F.sum(value).alias("_of_run"))
    over = Window.partitionBy(*keys, F.floor(F.col("_run") / width)).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    top = runs.groupBy(*keys, F.floor(F.col("_run") / width).alias("_top")).agg(F.sum("_of_run").alias("_of_top"))
    tops = top.withColumn("_before_top", F.coalesce(F.sum("_of_top").over(Window.partitionBy(*keys, F.lit(0)).orderBy("_top").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = (
        runs.withColumn("_in_top", F.coalesce(F.sum("_of_run").over(over), F.lit(0)))
        .withColumn("_top", F.floor(F.col("_run") / width))
        .join(tops.drop("_of_top"), [*keys, "_top"])
        .select(*keys, "_run", (F.col("_in_top") + F.col("_before_top")).alias("_before"))
    )
    inside = Window.partitionBy(*keys, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_run", F.floor(F.col(order) / width))
        .withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(runs, [*keys, "_run"])
        .withColumn(out, F.col("_inside") + F.col("_before"))
        .drop("_run", "_inside", "_before")
    )
