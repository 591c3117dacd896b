"""Near-duplicates by SimHash: exact comparison of fingerprints in tiles, by exclusive or and bit counts.

A fingerprint bit is set if it is set in over half the hashes of a text's shingles. Equal fingerprints form a class; one of each
class goes on. Fingerprints that differ in RADIUS bits or fewer agree in at least PARTS - RADIUS of their PARTS parts, so only
those that share such a choice of parts can link. They are laid in tiles of about TILE, each of one choice, its bits and one
population count; a tile meets those of the same choice and bits whose population count is within RADIUS, others are skipped.
A tile pair gives the links of a spanning forest of its fingerprints: no path is lost, and a group of copies doesn't give all its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import map_batches, written
from lanewright.llm.components import components

BITS, RADIUS, PARTS, TILE = 64, 2, 4, 1024
WORDS, SEED = 3, 42
CHUNK = 4096
#: The choices of parts that two linked fingerprints may agree in, as masks of their bits (signed).
MASKS = [
    int(np.array(sum(((1 << BITS // PARTS) - 1) << BITS // PARTS * p for p in parts), np.uint64).view(np.int64)) for parts in combinations(range(PARTS), PARTS - RADIUS)
]


def shingle_hashes(text: str | None) -> np.ndarray:
    """XXH64 of each run of WORDS words (A-Z lower-cased, joined by a blank), repeats included; of all words where they are fewer."""
    words = (text or "").encode("utf-8").lower().split()  # bytes are lower-cased in A-Z and split at 0x09 to 0x0D and 0x20 only
    if len(words) < WORDS:
        words = [b" ".join(words)] if words else []
    else:
        words = [b"%b %b %b" % x for x in zip(words, words[1:], words[2:])]
    return np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as an unsigned number; zero without hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (64 bits as a signed long) of every row of docs (doc_id, text)."""

    def start():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([fingerprint(shingle_hashes(t)) for t in batch.column(1).to_pylist()], np.uint64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"])

        return apply

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), start, "doc_id long, fingerprint long")


def tiles(classes: DataFrame) -> DataFrame:
    """choice, part, ones, tile, of: the fingerprints laid in tiles, those only whose bits in a choice of parts another has too."""
    placed = classes.select("fingerprint", F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(MASKS)])).alias("at"))
    placed = placed.select("at.*", F.bit_count("fingerprint").alias("ones"), "fingerprint")
    key = ["choice", "part"]
    counted = placed.groupBy(*key, "ones").agg(F.count("*").alias("times"))
    met = counted.groupBy(*key).agg(F.sum("times").alias("_all"), F.collect_list(F.struct("ones", F.ceil(F.col("times") / TILE).alias("tiles"))).alias("_of")).filter("_all > 1")
    met = written(met.select(*key, F.explode("_of").alias("_of")).select(*key, "_of.*"), "tiles-of")
    dealt = placed.join(met, [*key, "ones"]).withColumn("tile", F.pmod(F.xxhash64("fingerprint"), F.col("tiles")).cast("int"))
    return dealt.groupBy(*key, "ones", "tile").agg(F.first("tiles").cast("int").alias("tiles"), F.collect_list("fingerprint").alias("of"))


def forest(a: np.ndarray, b: np.ndarray | None) -> list[tuple[int, int]]:
    """Links (places in a followed by b) that span the graph of links between a and b, or within a. Each fingerprint is
    compared once with all that no link has reached yet."""
    values = (a if b is None else np.concatenate((a, b))).view(np.uint64)  # of signed numbers the bits of the absolute value are counted
    within, n, found = b is None, len(a), []
    rest = [np.arange(len(values))] * 2 if within else [np.arange(n), np.arange(n, len(values))]
    while len(rest[0]):
        todo = [int(rest[0][0])]
        rest[0] = rest[0][1:]
        if within:
            rest[1] = rest[0]
        while todo:
            x = todo.pop()
            side = 1 if within or x < n else 0
            near = np.bitwise_count(values[rest[side]] ^ values[x]) <= RADIUS
            if near.any():
                reached = rest[side][near]
                rest[side] = rest[side][~near]
                if within:
                    rest[0] = rest[1]
                todo += reached.tolist()
                found += [(x, y) for y in reached.tolist()]
    return found


def tile_links(laid: DataFrame) -> DataFrame:
    """Links (a, b) between fingerprints, from all pairs of tiles of the same bits whose population counts are near enough."""
    key = ["choice", "part"]
    near = F.explode(F.sequence(F.col("ones"), F.col("ones") + RADIUS)).alias("ones")
    a = laid.select(*key, F.col("ones").alias("ones_a"), F.col("tile").alias("tile_a"), F.col("of").alias("a"), near)
    b = laid.select(*key, "ones", "tile", F.col("of").alias("b"))
    once = (F.col("ones") > F.col("ones_a")) | (F.col("tile") >= F.col("tile_a"))
    same = (F.col("ones") == F.col("ones_a")) & (F.col("tile") == F.col("tile_a"))
    met = a.join(b, [*key, "ones"]).filter(once & ~(same & (F.size("a") == 1))).select("a", F.when(~same, F.col("b")).alias("b"))

    def start():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            ends = ([], [])
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                a, b = (None if not x.is_valid else x.values.to_numpy() for x in (a, b))
                values = a if b is None else np.concatenate((a, b))
                for x, y in forest(a, b):
                    ends[0].append(values[x])
                    ends[1].append(values[y])
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], names=["a", "b"])

        return apply

    return map_batches(met, start, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: a row per row of docs (doc_id, text).

    component_id is the least doc_id that links reach. Texts without words (null, empty, blank) have the fingerprint zero, which links
    like any other. A row with a null doc_id links too, but no component is named after it: component_id is null only where no row
    of the component has an id. Texts are read whole, however long; repeated rows stay and get the same result; other columns of docs
    are ignored, whatever their names; an empty table gives an empty one.
    """
    rows = written(fingerprints(docs), "fingerprints")
    classes = written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "classes")
    found = written(tile_links(written(tiles(classes), "tiles")).distinct(), "tile-links")
    # nodes in order of their ids, those without one last
    end = lambda x: classes.select(F.col("fingerprint").alias(x), node(F.col("fingerprint"), F.col("rep")).alias(f"node_{x}"))
    named = found.join(end("a"), "a").join(end("b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    roots = components(named).select("node.fingerprint", F.col("root.rep").alias("root"))
    grouped = written(classes.join(roots, "fingerprint", "left").select("fingerprint", F.coalesce("root", "rep").alias("component_id")), "grouped")
    return rows.join(grouped, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def node(fingerprint: Column, rep: Column) -> Column:
    return F.struct(rep.isNull().alias("late"), rep.alias("rep"), fingerprint.alias("fingerprint"))
