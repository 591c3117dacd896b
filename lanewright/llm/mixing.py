"""Mixing sources to target weights by a splitting tree of multivariate hypergeometric draws.

Each source's documents are dealt into blocks by a seeded hash; the order of its blocks, and of documents in a block by
another hash, is its random order. A source's quota is taken as whole passes over that order and a part of one more. The
quotas, counted in blocks, are split over the output shards: a node of the tree holds the blocks of a range of shards,
and a multivariate hypergeometric draw says how many of each source go left. Every leaf gets the next blocks of each
source's order, so blocks are disjoint, the counts add up exactly, and the draws depend only on seed and node.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewright.llm.common import free, prefix_sums, written

WORD = r"[^\x20\x09-\x0D]+"
LEAST_SHARDS, MOST_BLOCK_WORDS = 32, 1 << 16
WEIGHTS = (5, 2, 1)


@dataclass(frozen=True)
class Source:
    """A source's number and name, its words and documents, its target, blocks, whole passes and words of the last pass."""

    sid: int
    name: str | None
    words: int
    target: float
    blocks: int
    passes: int
    rest: int


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """share x all sizes, split by weight; none above most x its size, what is over going to the others by weight."""
    left, out = share * sum(sizes), [0.0] * len(sizes)
    open_ = list(range(len(sizes)))
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * level > most * sizes[i]]
        for i in full or open_:
            out[i] = most * sizes[i] if full else weights[i] * level
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def split(total: int, shards: int, quotas: np.ndarray, seed: int, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, starts, counts) of the shards first to last - 1: each source's next blocks, by the draws of the whole tree."""
    stack = [(0, shards, quotas, np.zeros_like(quotas))]
    while stack:
        low, high, held, start = stack.pop()
        if high <= first or low >= last:
            continue
        if high - low == 1:
            yield low, start, held
            continue
        mid = (low + high) // 2
        left = total * mid // shards - total * low // shards
        drawn = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(held, left, method="marginals")
        stack += [(mid, high, held - drawn, start + drawn), (low, mid, drawn, start)]


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words), _text (a hash), _copies and _nth: rows equal in id, text and source are numbered from 1.

    Written once: all later steps move these rows only. Equal rows are counted where they are read, so many of them don't meet.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("_text"))
    counted = rows.groupBy("doc_id", "source", "size", "_text").agg(F.count("*").alias("_copies"))
    return written(counted.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))), "sizes")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, seed: int = 31, block_words: int | None = None, shard_blocks: int = 64, most_sources: int = 100_000) -> DataFrame:
    """doc_id, _text, source, _copies, _nth, size, source_size, target, taken, draws: a row per row of docs.

    draws holds, for each time the mix takes the document, the pass, the output shard and the words taken: all of them but
    for at most one document a source, which its quota cuts. A block has block_words words; unless named, so many that the tree
    has LEAST_SHARDS shards, and MOST_BLOCK_WORDS at most. Sources are weighted in code point order, a null source last.
    Null and empty texts have size 0 and take nothing, but stay in the result. Rows equal in doc_id, text and source are
    numbered and dealt one by one. A document of any length is in one block. Other columns are left out; an empty table stays empty. Only the table of sources reaches the driver; more than most_sources raise ValueError.
    """
    spark = docs.sparkSession
    rows = sized(docs)
    found = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).limit(most_sources + 1).collect()
    if len(found) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets([r["words"] for r in found], [weights[i % len(weights)] for i in range(len(found))], share)
    words = sum(r["words"] for r in found)
    if block_words is None:
        block_words = max(1, min(MOST_BLOCK_WORDS, int(share * words) // (LEAST_SHARDS * shard_blocks)))
    block_words = max(block_words, words // 250_000_000 + 1)  # the draws hold for under 10^9 blocks
    sources = []
    for i, (r, t) in enumerate(zip(found, goal, strict=True)):
        quota = min(round(t), 2 * r["words"])
        passes = quota // r["words"] if r["words"] else 0
        sources.append(Source(i, r["source"], r["words"], float(t), max(1, -(-r["words"] // block_words), -(-r["n"] // 4096)), passes, quota - passes * r["words"]))
    schema = "sid int, source string, source_size long, target double, blocks long, passes int, rest long"
    plan = F.broadcast(spark.createDataFrame([(s.sid, s.name, s.words, s.target, s.blocks, s.passes, s.rest) for s in sources], schema))
    dealt = rows.join(plan, rows["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "_text", "_nth"), F.col("blocks")))
    blocks = prefix_sums(dealt.groupBy("sid", "block", "blocks", "passes", "rest").agg(F.sum("size").alias("words")), ["sid"], "block", "words", "before")
    blocks = written(blocks, "blocks")
    begun = {r["sid"]: r["n"] for r in blocks.filter("before < rest").groupBy("sid").agg((F.max("block") + 1).alias("n")).collect()}
    quotas = np.array([s.passes * s.blocks + begun.get(s.sid, 0) for s in sources], np.int64)
    total = int(quotas.sum())
    shards = max(1, -(-total // shard_blocks))

    def leaves(batches):
        for batch in batches:
            for low in batch.column(0).to_pylist():
                found = [(shard, i, int(start[i]), int(n[i])) for shard, start, n in split(total, shards, quotas, seed, low, min(shards, low + 256)) for i in np.flatnonzero(n)]
                columns = list(zip(*found, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=["shard", "sid", "start", "n"])

    tree = spark.range(0, shards, 256, numPartitions=max(1, min(2000, shards // 2048))).mapInArrow(leaves, "shard int, sid int, start long, n long")
    turns = tree.select("shard", "sid", F.explode(F.expr("sequence(start, start + n - 1)")).alias("turn"))
    turns = turns.join(plan.select("sid", "blocks"), "sid").select("sid", F.col("turn") % F.col("blocks"), F.expr("cast(turn div blocks as int)"), "shard").toDF("sid", "block", "pass", "shard")
    drawn = blocks.join(turns, ["sid", "block"], "left").groupBy("sid", "block", "before").agg(F.sort_array(F.collect_list(F.when(F.col("pass").isNotNull(), F.struct("pass", "shard")))).alias("turns"))
    inside = Window.partitionBy("sid", "block").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "_text", "_nth"), "doc_id", "size", "_nth").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = dealt.join(drawn, ["sid", "block"]).withColumn("_ahead", ahead)
    part = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("rest") - F.col("_ahead")))
    draws = F.transform("turns", lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), F.when(d["pass"] < F.col("passes"), F.col("size")).otherwise(part).alias("words")))
    placed = placed.withColumn("draws", F.filter(draws, lambda d: d["words"] > 0))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return placed.select("doc_id", "_text", "source", "_copies", "_nth", "size", "source_size", "target", taken.alias("taken"), "draws")


def drawn(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """doc (a row of docs as a struct), size, draw (pass, shard, words) and order (random, fixed by the seed of the plan's
    hashes): a row for each draw. Rows equal in id, text and source get the draws of one of them each."""
    keys = ["id", "hash", "source"]
    draws = plan.filter("size(draws) > 0").select(F.col("doc_id").alias("id"), F.col("_text").alias("hash"), "source", "_copies", "_nth", "size", "draws")
    draws = written(draws, "draws")
    packed = docs.select(docs["doc_id"].alias("own_id"), F.xxhash64(docs["text"]).alias("own_hash"), docs["source"].alias("own_source"), F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    same = [F.col(f"own_{k}").eqNullSafe(F.col(k)) for k in keys]
    out = packed.join(draws.filter("_copies = 1"), same)
    several = draws.filter("_copies > 1")
    if not several.isEmpty():
        rows = packed.join(several.select(*keys).distinct(), same, "left_semi")
        rows = rows.withColumn("own_nth", F.row_number().over(Window.partitionBy("own_id", "own_hash", "own_source").orderBy(F.xxhash64("doc"))).cast("long"))
        out = out.unionByName(rows.join(several, [*same, F.col("own_nth") == F.col("_nth")]).drop("own_nth"))
    out = out.select("doc", "size", "id", "hash", "_nth", F.explode("draws").alias("draw"))
    return out.select("doc", "size", "draw", F.xxhash64("id", "hash", "_nth", "draw.pass").alias("order"))


def cut(text: Column, words: Column) -> Column:
    """The text up to the end of its words-th word."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), words.cast("int")), "")


def taken_rows(rows: DataFrame, docs: DataFrame) -> list[Column]:
    """The columns of docs from drawn(); where a draw takes a part of a document, text ends there and n_chars says how long it is."""
    part = F.col("draw.words") < F.col("size")
    text = F.when(part, cut(F.col("doc.text"), F.col("draw.words"))).otherwise(F.col("doc.text"))
    own = {"text": text, "n_chars": F.when(part, F.length(text)).otherwise(F.col("doc.n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": text}
    return [own.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns]


def mixed(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The columns of docs, a row for each time the mix takes a document. What it takes of a document that a quota cuts (one a
    source at most) is the text up to there; all others are whole. Null and empty texts are never taken. Rows of an output shard
    stand together, in a random order (a hash of id, text and pass)."""
    rows = drawn(docs, plan).withColumn("shard", F.col("draw.shard"))
    return rows.repartition("shard").sortWithinPartitions("shard", "order").select(*taken_rows(rows, docs))


def write_mix(docs: DataFrame, plan: DataFrame, path: str, tasks: int) -> None:
    """Writes the rows of mixed(), a folder _shard=... each, in a random order (a hash of id, text and pass), with _words, the
    words taken. A name that docs has itself gets further underscores."""
    rows = drawn(docs, plan)
    shard, words, order = free(docs.columns, "_shard", "_words", "_order")
    rows = rows.select(*taken_rows(rows, docs), F.col("draw.shard").alias(shard), F.col("draw.words").alias(words), F.col("order").alias(order))
    rows.repartitionByRange(tasks, shard, order).sortWithinPartitions(shard, order).drop(order).write.partitionBy(shard).parquet(path)


def digest(plan: DataFrame) -> DataFrame:
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.transform("draws", lambda d: d["shard"].cast("string")), ",").alias("shards"))
