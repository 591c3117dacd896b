"""Periodic runs of words by a suffix tree: branching tandem repeats, rotated to the left and merged into maximal runs.

The tree of a text stands in arrays: its leaves are the suffixes in order, a node is an interval of leaves with the number of
words they share (after Stoye and Gusfield, 2002). At each node the leaves of all children but the largest are listed; such
a leaf i and the leaf one node depth q further or before are a branching tandem repeat if both are below the node, in
different children. A text is listed n log n times at most. Texts of a batch share the arrays, never a node.

A run of LEAST words and REPEATS periods holds a passage of SHARED words twice, so texts without one get no tree.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import let, map_batches

LEAST, REPEATS = 24, 3
SHARED = min(max(LEAST - q, (REPEATS - 1) * q) for q in range(1, LEAST))
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def named(words: list[bytes]) -> np.ndarray:
    """The words as numbers, equal ones alike, in order of first use."""
    numbers = dict(zip(dict.fromkeys(words), count()))
    return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))


def repeats_a_passage(ids: np.ndarray) -> bool:
    """Whether some SHARED consecutive words may stand twice. Never False if they do."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    width = 1
    while 2 * width <= SHARED:
        h = (h[:-width] ^ (h[:-width] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[width:]
        width *= 2
    h = np.sort(h)
    return bool((h[1:] == h[:-1]).any())


def suffixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes in order, the place of each, and how many words each shares with the one before.

    Suffixes are sorted by their first 1, 2, 4, ... words, those already told apart staying where they are. The ranks of
    every step are kept to count shared words from the largest power down.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    slots, key, rank, steps, width = np.arange(n), ids[order], np.zeros(n, np.int64), [], 0
    while True:
        fresh = np.ones(len(slots), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[order[slots]] = np.maximum.accumulate(np.where(fresh, slots, 0))
        steps.append(rank.astype(np.int32))
        alone = fresh.copy()
        alone[:-1] &= fresh[1:]
        slots = slots[~alone]
        if not len(slots):
            break
        width = 2 * width or 1
        at = order[slots]
        key = rank[at] * n + rank[at + width]
        by = np.argsort(key, kind="stable")
        order[slots], key = at[by], key[by]
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(steps[0][a] == steps[0][b])
    a, b, shared = a[near], b[near], np.zeros(len(near), np.int64)
    for j in range(len(steps) - 1, -1, -1):
        shared += (steps[j][np.minimum(a + shared, n - 1)] == steps[j][np.minimum(b + shared, n - 1)]).astype(np.int64) << j
    common = np.zeros(n, np.int64)
    common[near + 1] = shared
    return order, rank, common


def nodes(common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each place where two children of a node meet: the place, and the first and last leaf of the node."""
    low, high, places, stack = [0] * len(common), [0] * len(common), np.flatnonzero(common), []
    values, zero = common.tolist(), 0
    for j, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            high[stack.pop()] = j - 1
        if not v:
            for x in stack:
                high[x] = j - 1
            stack.clear()
            zero = j
        else:
            low[j] = low[stack[-1]] if stack and values[stack[-1]] == v else stack[-1] if stack else zero
            stack.append(j)
    for x in stack:
        high[x] = len(values) - 1
    return places, np.array(low, np.int64)[places], np.array(high, np.int64)[places]


def small_leaves(common: np.ndarray) -> tuple[np.ndarray, ...]:
    """Leaves of all children of nodes but the largest: the leaf, node depth, first and last leaf of the node and of the child."""
    places, low, high = nodes(common)
    by = np.lexsort((places, high, low))
    places, low, high = places[by], low[by], high[by]
    first = np.ones(len(by), bool)
    first[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    node = np.cumsum(first) - 1
    ends = np.append(places[1:] - 1, 0)
    last = np.append(first[1:], True)
    ends[last] = high[last]
    # a child begins at each place, and one more at the first leaf of the node
    heads = np.flatnonzero(first)
    begin, end = np.concatenate((low[heads], places)), np.concatenate((places[heads] - 1, ends))
    of, depth = np.concatenate((node[heads], node)), np.concatenate((common[places[heads]], common[places]))
    low, high = np.concatenate((low[heads], low)), np.concatenate((high[heads], high))
    by = np.lexsort((begin - end, of))  # the largest child of a node comes first
    small = by[np.append(False, of[by][1:] == of[by][:-1])] if len(by) else by
    begin, end, depth, low, high = (x[small] for x in (begin, end, depth, low, high))
    sizes = end - begin + 1
    child = np.repeat(np.arange(len(small)), sizes)
    leaf = np.arange(len(child)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begin[child]
    return leaf, depth[child], low[child], high[child], begin[child], end[child]


def tandem_repeats(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of all branching tandem repeats: 2 q words of period q that the next word breaks."""
    order, place, common = suffixes(ids)
    leaf, q, low, high, begin, end = small_leaves(common)
    start = order[leaf]
    found = []
    for sign in (1, -1):
        other = start + sign * q
        at = place[np.clip(other, 0, len(ids) - 1)]
        hit = (other >= 0) & (other < len(ids)) & (at >= low) & (at <= high) & ((at < begin) | (at > end))
        found.append(np.stack((np.minimum(start, other)[hit], q[hit])))
    starts, periods = np.unique(np.concatenate(found, axis=1), axis=1)
    return starts, periods


def rotated(ids: np.ndarray, start: int, period: int) -> int:
    """How often a tandem repeat can be rotated to the left: words before it that equal those a period on."""
    n, width = 0, 32
    while n < start:
        m = min(width, start - n)
        other = np.flatnonzero(ids[start - n - m : start - n] != ids[start - n - m + period : start - n + period])
        if len(other):
            return n + m - 1 - int(other[-1])
        n, width = n + m, 2 * width
    return n


def maximal_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Of each text, given as numbers of its words, all runs (start, length, period) by start, then period."""
    found: list[dict] = [{} for _ in texts]
    having = [k for k, ids in enumerate(texts) if len(ids) >= LEAST and repeats_a_passage(ids)]
    if having:
        # every text ends in a number of its own, so no two suffixes are equal and no node holds two texts
        tops = np.cumsum([0, *(int(texts[k].max()) + 2 for k in having)])
        joined = np.concatenate([np.append(texts[k] + tops[i], tops[i + 1] - 1) for i, k in enumerate(having)])
        edges = np.cumsum([0, *(len(texts[k]) + 1 for k in having)])
        starts, periods = tandem_repeats(joined)
        need = np.maximum(LEAST, REPEATS * periods) - 2 * periods
        # a run needs so many rotations; the farthest is looked at first
        far = starts - need
        able = (far >= 0) & (joined[far] == joined[far + periods])
        for start, q in zip(starts[able].tolist(), periods[able].tolist(), strict=True):
            turns = rotated(joined, start, q)
            length = 2 * q + turns
            if length >= max(LEAST, REPEATS * q):
                i = int(np.searchsorted(edges, start, "right")) - 1
                stretch = (start - turns - int(edges[i]), length)
                runs = found[having[i]]
                runs[stretch] = min(q, runs.get(stretch, q))  # multiples of the smallest period repeat over the same words
    return [sorted((s, n, q) for (s, n), q in runs.items()) for runs in found]


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: all but those that a run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge)[:n] == 0


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), collapsed (the kept words, joined by blanks) of each row of docs (doc_id, text).

    A run is a stretch of words with smallest period q, of LEAST words and REPEATS periods or more, that can't be extended.
    Null, empty and blank texts have no words, no runs and an empty collapsed text; texts are read whole, however long, and one of
    them is held by one task with about 200 bytes a word. Equal texts give equal values, repeated rows stay, a null doc_id stays
    null, other columns of docs are ignored, and an empty table gives an empty one.
    """

    def start():
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), ("collapsed", pa.string())])

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = [(t or "").encode("utf-8").split() for t in batch.column(1).to_pylist()]  # bytes are split at 0x09 to 0x0D and 0x20
            runs = maximal_runs([named(w) for w in words])
            texts = [b" ".join(w if not r else [w[i] for i in np.flatnonzero(kept(len(w), r))]) for w, r in zip(words, runs, strict=True)]
            listed = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
            columns = [batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(listed, schema.field("runs").type), pa.array([t.decode("utf-8") for t in texts], pa.string())]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        return apply

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), start, SCHEMA)


def standard_rewrite(doc_id: Column, text: Column) -> Column:
    """The text, but of a tenth of the ids (h = crc32 of the id, h mod 10 = 0) its words, those from a place on repeated by a period
    that h gives. A null id changes nothing."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def rewritten(words: Column) -> Column:
        n = F.size(words).cast("long")
        return let(g % n, lambda a: let(1 + F.floor((n - a) / (3 + g % 8)), lambda p: from_place(words, n, a, p)))

    def from_place(words: Column, n: Column, a: Column, p: Column) -> Column:
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i))), " ")

    split = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    return F.when(h % 10 == 0, let(split, lambda words: F.when(F.size(words) > 0, rewritten(words)).otherwise(F.lit("")))).otherwise(text)


def digest(scanned: DataFrame) -> DataFrame:
    """The scanned rows without runs and text: number of runs, the one of most periods (then least start, then period), digests."""
    a_less = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    tie = lambda a, b: (a["length"] * b["period"] == b["length"] * a["period"]) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"])))
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda top, r: F.when(a_less(r, top) | tie(r, top), r).otherwise(top))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    rows = scanned.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
