"""Near-duplicates by MinHash: an inverted join on signature coordinates, confirmed on full shingle sets.

Documents with equal shingle sets form a class, and one of each class goes on. Its signature has COORDINATES minima; each
(coordinate, value) is posted with its document. Pairs that agree in MATCHES coordinates or more are candidates. A value
that only one document has can't agree with any; of the others, in the order from rare to frequent, two such documents
must already share one in a prefix that leaves MATCHES - 1 of all coordinates out. Only prefixes are joined.

Large groups of near copies would give all their pairs. So every posting is first held against one hub only, the
document whose values are the most common; pairs that collide in MATCHES coordinates are confirmed, and these links join most of such a group into one component. Only pairs
of different components are compared afterwards, each at the first value that their prefixes share, by what either is
known to have in common with the hub and besides it: no pair is made that isn't a link. At a value, a node meets only those
of a size that could be similar to it given how many of its shingles any other node has at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewright.llm.common import bits_of, map_batches, parts, perhaps_in, written
from lanewright.llm.components import components
from lanewright.llm.shingles import Powers, shingle_sets, stirred

COORDINATES, MATCHES = 48, 24
LEADING = COORDINATES - MATCHES + 1
THRESHOLD = (75, 100)  # similarity of a link: 75 / 100 or more


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, two hashes of the shingle set, and the minima of its shingles under COORDINATES
    hashes."""
    seeds = np.random.default_rng(3).integers(0, 1 << 64, COORDINATES, dtype=np.uint64)

    def start():
        powers = Powers()

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(batch.column(2).to_pylist(), powers)
            sizes = np.array([len(s) for s in sets], np.int64)
            full = sizes > 0
            minima = np.zeros((len(sets), COORDINATES), np.uint64)
            keys = np.zeros((2, len(sets)), np.uint64)
            if full.any():
                every = np.concatenate(sets)
                at = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                for j, seed in enumerate(seeds):
                    minima[full, j] = np.minimum.reduceat(stirred(every ^ seed), at)
                minima ^= seeds * np.uint64(0x9E3779B97F4A7C15)
                keys[0, full] = np.add.reduceat(stirred(every), at)
                keys[1, full] = np.bitwise_xor.reduceat(stirred(every + np.uint64(1)), at)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * COORDINATES, pa.int32()), pa.array(minima.reshape(-1).view(np.int64)))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), lists], names=["doc_id", "text_hash", "n_shingles", "key", "key2", "minima"])

        return apply

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text"), start, "doc_id long, text_hash long, n_shingles long, key long, key2 long, minima array<long>")


def classes_of(able: DataFrame) -> DataFrame:
    """key, key2, node, rep, n: the classes of equal sets, by both hashes (128 bits), with their least doc_id and size.

    node is unique: the first hash, changed where classes share it.
    """
    found = able.groupBy("key", "key2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("key2")).cast("long") - 1
    return found.select("key", "key2", F.col("key").bitwiseXOR(nth).alias("node"), "rep", "n")


def perhaps_shared(able: DataFrame) -> DataFrame:
    """key, key2, minima of the classes that may have a partner: rows that agree in MATCHES of all coordinates agree in one of any
    LEADING, so only the first LEADING minima are counted, without their documents, and a filter of fixed size passes over the rest."""
    leading = F.explode(F.slice("minima", 1, LEADING)).alias("value")
    counted = able.select(leading).groupBy("value").agg(F.count("*").alias("times"))
    bits = written(bits_of(counted.filter("times > 1").select("value")), "bits")
    rows = able.select("key", "key2", "minima", leading).filter(perhaps_in(bits, F.col("value")))
    return rows.groupBy("key", "key2").agg(F.first("minima").alias("minima"))


def postings(able: DataFrame, classes: DataFrame) -> DataFrame:
    """node, key, rep, n, shared (its values that others have, rare ones first), common (how often all of them occur) of the
    classes with MATCHES such values or more."""
    firsts = written(perhaps_shared(able).join(classes, ["key", "key2"]), "perhaps-shared")
    posted = firsts.select("node", F.explode("minima").alias("value"))
    frequent = posted.groupBy("value").agg(F.count("*").alias("times")).filter("times > 1")
    kept = posted.join(frequent, "value").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("times", "value"))).alias("_of"))
    common = F.aggregate("_of", F.lit(0).cast("long"), lambda total, x: total + x["times"]).alias("common")
    kept = kept.filter(F.size("_of") >= MATCHES).select("node", F.col("_of.value").alias("shared"), common)
    return kept.join(firsts.drop("minima", "key2"), "node").select("node", "key", "rep", "n", "shared", "common")


def prefix(shared: str = "shared") -> Column:
    """Of a node with s shared values the first s - MATCHES + 1; the values of its own stand before them."""
    return F.slice(shared, F.lit(1), F.size(shared) - (MATCHES - 1))


def alike_in_size(n: Column, m: Column) -> Column:
    """Whether sets of n and m can be similar enough at all."""
    return F.least(n, m) * THRESHOLD[1] >= F.greatest(n, m) * THRESHOLD[0]


def key_of(shingles: np.ndarray) -> int:
    return int(np.add.reduce(stirred(shingles)).view(np.int64))


def candidate_texts(docs: DataFrame, posted: DataFrame) -> DataFrame:
    """node, text of the posted classes. Where an id repeats with other texts, only the one with the node's set counts. A filter of
    fixed size keeps most texts of other documents out of the shuffle."""
    bits = written(bits_of(posted.select("rep")), "bits")
    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").filter(perhaps_in(bits, F.col("rep")))
    found = rows.join(posted.select("rep", "node", "key"), "rep").select("node", "text", "key")

    def start():
        powers = Powers()

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(batch.column(1).to_pylist(), powers)
            return batch.select([0, 1]).filter(pa.array([key_of(s) == k for s, k in zip(sets, batch.column(2).to_pylist(), strict=True)], pa.bool_()))

        return apply

    return map_batches(found, start, "node long, text string")


def linked_to_hubs(pairs: DataFrame, posted: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (hub, node) that are links: those that collide in MATCHES coordinates are confirmed on their whole texts. No text
    moves for the others."""
    of = lambda x: posted.select(F.col("node").alias(x), F.col("shared").alias(f"shared_{x}"), F.col("n").alias(f"n_{x}"))
    both = pairs.filter("hub <> node").join(of("hub"), "hub").join(of("node"), "node")
    both = both.filter((F.size(F.array_intersect("shared_hub", "shared_node")) >= MATCHES) & alike_in_size(F.col("n_hub"), F.col("n_node")))
    return against_hubs(written(both.select(*pairs.columns), "colliding"), texts).filter("linked").select(*pairs.columns)


def against_hubs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """hub, node, hub_rep, rep, common, linked, bits, out of each pair (hub, node), from the full sets made anew from the whole texts.

    bits tells which of the hub's shingles the node has, in words of 64; out are the node's other shingles. With a hub's
    bits and out of two nodes, what they have in common is known exactly. A hub paired with itself has one text moved, not two.
    """
    own = texts.select("node", F.col("text").alias("text_node"))
    hub = texts.select(F.col("node").alias("hub"), F.col("text").alias("text_hub"))
    columns = ("hub", "node", "text_hub", "text_node", "hub_rep", "rep")
    both = pairs.filter("hub <> node").join(hub, "hub").join(own, "node").select(*columns)
    both = both.union(pairs.filter("hub = node").join(own, "node").withColumn("text_hub", F.lit(None).cast("string")).select(*columns))
    longs = pa.list_(pa.int64())

    def start():
        powers = Powers()

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            alone = pc.is_null(batch.column(2)).to_pylist()
            sets = shingle_sets([*batch.column(2).to_pylist(), *batch.column(3).to_pylist()], powers)
            common, linked, bits, out = [], [], [], []
            for x, y, self in zip(sets[: batch.num_rows], sets[batch.num_rows :], alone, strict=True):
                x = y if self else x
                place = np.minimum(np.searchsorted(x, y), max(0, len(x) - 1))
                of_hub = x[place] == y
                has = np.zeros(-(-len(x) // 64) * 64, bool)
                has[place[of_hub]] = True
                n = int(of_hub.sum())
                common.append(n)
                linked.append(n * THRESHOLD[1] >= (len(x) + len(y) - n) * THRESHOLD[0])
                bits.append(np.packbits(has).view(np.int64))
                out.append(y[~of_hub].view(np.int64))
            made = [pa.array(common, pa.int64()), pa.array(linked, pa.bool_()), pa.array(bits, longs), pa.array(out, longs)]
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 4, 5)), *made], names=["hub", "node", "hub_rep", "rep", "common", "linked", "bits", "out"])

        return apply

    return map_batches(both, start, "hub long, node long, hub_rep long, rep long, common long, linked boolean, bits array<long>, out array<long>", 64)


def own_shingles(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """node, own: how many of a node's shingles no other of the nodes has."""

    def run(batches):
        powers = Powers()
        for batch in batches:
            for part in parts(batch, 128):
                sets = shingle_sets(part.column(1).to_pylist(), powers)
                ids = np.repeat(np.array(part.column(0).to_pylist(), np.int64), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], names=["node", "shingle"])

    rows = texts.join(nodes.select("node"), "node").select("node", "text").mapInArrow(run, "node long, shingle long")
    alone = rows.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("_other")).filter("node = _other")
    return alone.groupBy("node").agg(F.count("*").alias("own"))


def block(n: Column) -> Column:
    """Sets that differ by less than a third in size are in the same block or in the next."""
    return F.floor(F.log(n) / float(np.log(THRESHOLD[1] / THRESHOLD[0]))).cast("int")


def links(docs: DataFrame, posted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confirmed links (a, b) between classes, and node, root of the classes they connect, as structs (rep, node).

    A node is confirmed against the hubs it collides with. Two nodes of different components meet once, at the hub of the first
    value that their prefixes share. Their collisions are counted; either is compared with that hub then, so that their full sets
    are compared too: what both have of it, and what both have besides. A node of whose shingles too few are found in any other node still in question is passed over; `reach` is the
    largest set that a node could be similar to, and the smaller of two nodes goes to the blocks within its reach.
    """
    texts = written(candidate_texts(docs, posted).dropDuplicates(["node"]), "candidates")
    posted = posted.withColumn("prefix", prefix())
    values = posted.select("node", "rep", "common", F.explode("prefix").alias("value"))
    hubs = values.groupBy("value").agg(F.max("common").alias("common")).join(values, ["value", "common"]).groupBy("value").agg(F.min("node").alias("hub"))
    hubs = written(hubs.join(posted.select(F.col("node").alias("hub"), F.col("rep").alias("hub_rep")), "hub"), "hubs")
    tried = written(values.join(hubs, "value").select("hub", "node", "hub_rep", "rep").distinct(), "tried")
    ends = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    found = written(linked_to_hubs(tried, posted, texts), "links-to-hubs").select(*ends(F.struct(F.col("hub_rep").alias("rep"), F.col("hub").alias("node")), F.struct("rep", "node")))
    stars = components(found)
    roots = stars.select("node.node", F.col("root.node").alias("root"))

    placed_ = posted.select("node", F.explode("prefix").alias("value")).join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "value")
    split = placed_.groupBy("value").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low <> _high").select("value")
    met = placed_.join(split, "value").join(hubs, "value").groupBy("node", "root", "hub").agg(F.collect_list("value").alias("values"))
    met = written(met, "members")
    tested = written(against_hubs(tried.join(met.select("hub", "node"), ["hub", "node"], "left_semi"), texts), "compared")
    nodes = posted.select("node", "rep", "n", "shared").join(own_shingles(met.select("node").distinct(), texts), "node", "left")
    nodes = nodes.withColumn("rest", F.col("n") - F.coalesce("own", F.lit(0))).withColumn("reach", F.expr(f"rest * {sum(THRESHOLD)} div {THRESHOLD[0]} - n")).drop("own")
    nodes = nodes.filter(F.col("rest") * THRESHOLD[1] >= F.col("n") * THRESHOLD[0])
    members = met.join(nodes, "node").join(tested.select("hub", "node", "common", "bits", "out"), ["hub", "node"])
    blocks = F.sequence(block(F.col("n")), block(F.least(F.col("reach"), F.col("n") * THRESHOLD[1] / THRESHOLD[0])))
    columns = ("hub", "node", "rep", "n", "root", "shared", "values", "rest", "reach", "common", "bits", "out", "block")
    a, b = (
        side.select(*[F.col(c).alias(f"{c}_{x}") for c in columns])
        for x, side in (("a", members.filter("reach >= n").withColumn("block", F.explode(blocks))), ("b", members.withColumn("block", block(F.col("n")))))
    )
    enough = lambda common: common * sum(THRESHOLD) >= (F.col("n_a") + F.col("n_b")) * THRESHOLD[0]
    most = F.least("common_a", "common_b") + F.least(F.col("rest_a") - F.col("common_a"), F.col("rest_b") - F.col("common_b"))
    first = F.get(F.array_intersect(prefix("shared_a"), prefix("shared_b")), F.lit(0))
    once = F.array_contains("values_a", first)
    counted = F.size(F.array_intersect("shared_a", "shared_b")) >= MATCHES
    of_hub = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda total, x: total + x)
    exactly = of_hub + F.size(F.array_intersect("out_a", "out_b"))
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b")))
    meet = (F.col("hub_a") == F.col("hub_b")) & (F.col("block_a") == F.col("block_b")) & smaller & (F.col("root_a") != F.col("root_b"))
    meet = meet & alike_in_size(F.col("n_a"), F.col("n_b")) & (F.col("n_b") <= F.col("reach_a")) & (F.col("n_a") <= F.col("reach_b"))
    end = lambda x: F.struct(F.col(f"rep_{x}").alias("rep"), F.col(f"node_{x}").alias("node"))
    across = a.join(b, meet & enough(most) & once & counted & enough(exactly)).select(*ends(end("a"), end("b")))
    across = written(across, "links-across")
    return found.union(across), stars if across.isEmpty() else components(stars.select(F.col("root").alias("a"), F.col("node").alias("b")).union(across))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per row of docs (doc_id, text).

    component_id is the least doc_id that links reach, and the row with it is kept. Texts without words (null, empty) link
    with nothing, not even with each other; texts of fewer than five words with their equals in words only. Rows with a
    null doc_id are judged alone: component_id null, kept. Rows that repeat id and text get the same result. A true link is
    missed only where its signatures agree in fewer than MATCHES of COORDINATES (under 10^-4 at the threshold itself, and
    far less above). Texts are read whole, however long; other columns of docs are ignored, whatever their names; an empty table
    gives an empty one.
    """
    return placed(docs).drop("text_hash", "root")


def placed(docs: DataFrame) -> DataFrame:
    """near_duplicates() with text_hash and root, the group of the row: where an id repeats with other texts, its rows can be
    the least of several groups. root is null for rows that are judged alone."""
    sets = written(signatures(docs), "signatures")
    able = sets.filter("n_shingles > 0 and doc_id is not null")
    classes = written(classes_of(able), "classes")
    posted = written(postings(able, classes), "postings")
    _, roots = links(docs, posted)
    roots = roots.select("node.node", "root")
    grouped = classes.join(roots, "node", "left").select("key", "key2", F.coalesce("root.node", "node").alias("root"), F.coalesce("root.rep", "rep").alias("component_id"))
    rows = sets.select("doc_id", "text_hash", "n_shingles", "key", "key2").join(grouped, ["key", "key2"], "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return rows.select("doc_id", "text_hash", "n_shingles", F.when(~alone, F.col("root")).alias("root"), component.alias("component_id"), kept.alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The columns of docs, one document of each group: one row of the least doc_id, and of its texts the one of least hash.

    Rows are told apart by id and text, so a text stays where another text of its id is a duplicate. Of rows that repeat id
    and text one stays, without words too; rows with a null doc_id all stay.
    """
    rows = written(placed(docs).filter("doc_id is not null"), "placed")
    texts = rows.filter("kept").groupBy("doc_id", "text_hash").agg(F.max("root").alias("root"), F.count("*").alias("times"))
    several = texts.filter("root is not null").groupBy("root").agg(F.min("text_hash").alias("_low"), F.max("text_hash").alias("_high")).filter("_low <> _high")
    further = texts.join(several, "root").filter("text_hash <> _low").select("doc_id", "text_hash")
    gone = rows.filter("not kept").select("doc_id", "text_hash").union(further).distinct().withColumn("gone", F.lit(True))
    repeated = texts.filter("times > 1").select("doc_id", "text_hash").join(further, ["doc_id", "text_hash"], "left_anti").withColumn("gone", F.lit(False))
    marked = written(gone.union(repeated), "marked")
    bits = written(bits_of(marked.select("doc_id", "text_hash")), "bits")
    perhaps = perhaps_in(bits, docs["doc_id"].cast("long"), F.xxhash64(docs["text"]))
    doubtful = docs.filter(perhaps)  # only these are shuffled; the others are none of the marked rows
    own = (doubtful["doc_id"].cast("long") == marked["doc_id"]) & (F.xxhash64(doubtful["text"]) == marked["text_hash"])
    rest = docs.filter(~perhaps).union(doubtful.join(marked, own, "left_anti"))
    again = marked.filter("not gone")
    return rest if again.isEmpty() else rest.union(doubtful.join(again, own, "left_semi").dropDuplicates(["doc_id", "text"]))
