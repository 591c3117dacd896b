"""The prefix trie of conversations by partition refinement.

All conversations start in one class. Each turn splits a class by who says what next; a class is named by its smallest
conversation. A round refines the classes that are left by up to TURNS turns. Classes of one conversation retire: what follows in it
is a chain of nodes that needs no comparison. Then the classes are folded back to their nodes: what lies below a node is
the sum, over its conversations, of what lies at or behind that depth on the paths that they are the smallest of.

Conversations are told apart by MD5 of their turns (role and text); texts are hashed once and not shuffled. A conversation
or class with most rows is spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import prefix_sums, written

TURNS = 16
IDS = 4096  # conversation ids of one range that are joined to a text at once
NOTHING = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), key, n_bytes of every turn: in order of turn (null first), role and MD5 of the text.

    One global sort; a conversation may go on through many partitions, and counts its turns on from those before. Rows without
    conv_id belong to no conversation.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.md5(text.cast("binary")).alias("of_text"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    key = F.unhex(F.md5(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "of_text").cast("binary")))
    ordered = rows.orderBy("conv_id", F.col("turn").asc_nulls_first(), "role", "of_text").select("conv_id", key.alias("key"), "n_bytes", F.monotonically_increasing_id().alias("at"))
    ordered = written(ordered.withColumn("part", F.shiftright("at", 33)), "turns")
    parts = ordered.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    of = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "first", "n"))).alias("of"))  # as many as partitions at most
    before = lambda x, i: F.aggregate(F.slice("of", 1, i), F.lit(0).cast("long"), lambda total, y: total + y["n"]) - x["first"]
    moved = of.select("conv_id", F.explode(F.transform("of", lambda x, i: F.struct(x["part"].alias("part"), before(x, i).alias("by")))).alias("x")).select("conv_id", "x.*")
    return ordered.join(moved, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("by") + 1).alias("pos"), "key", "n_bytes")


def rebuilt(conversations: DataFrame, every: int = 5, heads: int = 9) -> DataFrame:
    """conv_id, depth (from 1), key, n_bytes: each conversation c with its first h turns replaced by those of conversation
    c - c mod `every`, h = crc32 of the id mod `heads`; a row of depth 0 and null key stands for each conversation itself."""
    turns = written(numbered(conversations), "numbered")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", h, (F.col("conv_id") - F.col("conv_id") % every).alias("source"))
    lengths = convs.select(F.col("conv_id").alias("source"), F.col("n").alias("_n"))
    convs = convs.join(lengths, "source", "left").select("conv_id", "source", "h", F.least("h", F.coalesce("_n", F.lit(0))).alias("taken"))
    convs = written(convs, "conversations")
    first = turns.filter(F.col("pos") < heads).select(F.col("conv_id").alias("source"), "pos", "key", "n_bytes")
    head = convs.join(first, "source").filter("pos <= h").select("conv_id", F.col("pos").alias("depth"), "key", "n_bytes")
    tail = turns.join(convs, "conv_id").filter("pos > h").select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "key", "n_bytes")
    root = convs.select("conv_id", F.lit(0).cast("long"), F.lit(None).cast("binary"), F.lit(0).cast("long"))
    return head.union(tail).union(root)


def split(turns: DataFrame, classes: DataFrame, low: int) -> DataFrame:
    """conv_id, depth, parent, rep, n, n_bytes: the classes (conv_id, rep) split by their turns low + 1 to low + TURNS. parent is the
    class a turn before (null at low + 1: the class given)."""
    of = turns.filter(F.col("depth").between(low + 1, low + TURNS)).join(classes, "conv_id")
    listed = of.groupBy("conv_id", "rep").agg(F.sort_array(F.collect_list(F.struct("depth", "key", "n_bytes"))).alias("of"))
    # what is said from here to each turn tells members of a class apart
    so_far = lambda x, i: F.struct(x["depth"].alias("depth"), F.unhex(F.md5(F.aggregate(F.slice(F.col("of.key"), 1, i + 1), F.lit(b""), lambda a, k: F.concat(a, k)))).alias("said"), x["n_bytes"].alias("n_bytes"))
    rows = written(listed.select("conv_id", F.col("rep").alias("given"), F.explode(F.transform("of", so_far)).alias("x")).select("conv_id", "given", "x.*"), "said")
    found = written(rows.groupBy("given", "depth", "said").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n")), "split")
    return rows.join(found, ["given", "depth", "said"]).select("conv_id", "depth", "given", "rep", "n", "n_bytes")


def refined(turns: DataFrame) -> DataFrame:
    """conv_id, depth, rep, n, n_bytes: the class of each conversation at each depth as long as it has several, and once where it has
    become the only one."""
    roots = turns.filter("depth = 0")
    whole = roots.agg(F.min("conv_id"), F.count("*")).first()
    steps = [roots.select("conv_id", "depth", F.lit(whole[0]).cast("long").alias("rep"), F.lit(whole[1]).cast("long").alias("n"), "n_bytes")]
    low, classes = 0, steps[0].filter("n > 1").select("conv_id", "rep")
    while not classes.isEmpty():
        step = written(split(turns, classes, low), "step")
        # of a class that has become single only the first turn is kept
        single = step.filter("n = 1").groupBy("conv_id").agg(F.min("depth").alias("depth"))
        tops = step.join(single, ["conv_id", "depth"]).filter("n = 1")
        steps.append(step.filter("n > 1").union(tops).select("conv_id", "depth", "rep", "n", "n_bytes"))
        low += TURNS
        classes = step.filter((F.col("n") > 1) & (F.col("depth") == low)).select("conv_id", "rep")
    out = steps[0]
    for step in steps[1:]:
        out = out.union(step)
    return out


def streamed_hashes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined ids of each node, from rows (rep, depth, chunk, ids) that come in order: only one state is held."""
    now, state, reps, depths, hashes = None, None, [], [], []

    def end() -> None:
        if state:
            reps.append(now[0])
            depths.append(now[1])
            hashes.append(state.hexdigest())

    for batch in rows:
        for rep, depth, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if (rep, depth) == now:
                state.update(b"," + ids.encode())
            else:
                end()
                now, state = (rep, depth), hashlib.sha256(ids.encode())
        if len(reps) > 10_000:
            yield pa.RecordBatch.from_pydict({"rep": pa.array(reps, pa.int64()), "depth": pa.array(depths, pa.int64()), "ends": pa.array(hashes, pa.string())})
            reps.clear(), depths.clear(), hashes.clear()
    end()
    yield pa.RecordBatch.from_pydict({"rep": pa.array(reps, pa.int64()), "depth": pa.array(depths, pa.int64()), "ends": pa.array(hashes, pa.string())})


def ends_of(ends: DataFrame) -> DataFrame:
    """rep, depth, ends: the hash of the ascending ids (conv_id) of the conversations that end in a node. Ids are joined by ranges of
    IDS first, so a node in which most conversations end has few rows."""
    chunk = F.floor(F.col("conv_id") / IDS).alias("chunk")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = ends.groupBy("rep", "depth", chunk).agg(joined.alias("ids"))
    return chunks.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "chunk").mapInArrow(streamed_hashes, "rep long, depth long, ends string")


def nodes(conversations: DataFrame, every: int = 5, heads: int = 9) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (conv_id, turn, role, text), the root among them.

    conv_id is the smallest conversation that starts with the node's turns, depth the number of these. Null roles and texts are
    empty; turns of equal number, nulls before the others, go by role and MD5 of the text; rows that repeat are turns of their
    own; rows without conv_id are left out; other columns are ignored, whatever their names; no row gives no node. Texts are
    read whole, however long, and hashed where they are read.
    """
    turns = written(rebuilt(conversations, every, heads), "rebuilt")
    rows = written(refined(turns), "refined")
    lengths = turns.groupBy("conv_id").agg(F.max("depth").alias("length"))
    lasts = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "rep", "n")).alias("last"))
    # where each conversation leaves what it shares: in a node it ends in, or in the first node of its own
    lasts = written(lasts.join(lengths, "conv_id").select("conv_id", "length", "last.*"), "lasts")

    shared = rows.filter("n > 1")
    parent = rows.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("rep").alias("parent_conv_id"))
    own = rows.filter("conv_id = rep").join(parent, ["conv_id", "depth"], "left")
    named = written(own.select("conv_id", "depth", "parent_conv_id", "n", "n_bytes"), "named")  # one row a node: its smallest conversation's
    children = named.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    several = written(named.filter("n > 1").join(children, ["conv_id", "depth"], "left").fillna(0, ["n_children"]), "several")

    leaf = several.filter("n_children = 0").select(F.col("conv_id").alias("rep"), "depth", F.lit(True).alias("_leaf"))
    leaves = lasts.join(leaf, ["rep", "depth"], "left")
    leaves = leaves.select("conv_id", ((F.col("n") == 1) | (F.coalesce("_leaf", F.lit(False)) & (F.col("conv_id") == F.col("rep")))).cast("long").alias("leaf"))
    saves = F.when(F.col("conv_id") == F.col("rep"), (F.col("n") - 1) * F.col("n_bytes")).otherwise(F.lit(0)).cast("long")
    below = prefix_sums(shared.withColumn("saves", saves), ["conv_id"], "depth", "saves", "passed")
    whole = shared.groupBy("conv_id").agg(F.sum(saves).alias("_whole"))
    below = below.join(whole.join(leaves, "conv_id"), "conv_id").withColumn("behind", F.col("_whole") - F.col("passed"))
    folded = below.groupBy(F.col("rep").alias("conv_id"), "depth").agg(F.sum("leaf").alias("n_leaves"), F.sum("behind").alias("saved_tokens"))

    ended = ends_of(lasts.filter("n > 1 and depth = length").select("rep", "depth", "conv_id")).withColumnRenamed("rep", "conv_id")
    several = several.join(folded, ["conv_id", "depth"]).join(ended, ["conv_id", "depth"], "left")
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    several = several.select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))

    chains = lasts.filter("n = 1").select("conv_id", "depth", "length").join(named.select("conv_id", "depth", "parent_conv_id"), ["conv_id", "depth"])
    chains = chains.select("conv_id", "length", F.col("depth").alias("top"), "parent_conv_id", F.explode(F.sequence("depth", "length")).alias("depth"))
    one, at_end = F.lit(1).cast("long"), F.col("depth") == F.col("length")
    chains = chains.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("parent_conv_id")).otherwise(F.col("conv_id")), one, (~at_end).cast("long"), one, one - 1,
        F.when(at_end, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(NOTHING)),
    ).toDF(*columns)
    return several.union(chains)
