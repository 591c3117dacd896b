import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from lanewright.llm import queries
from lanewright.llm import runs as R
from lanewright.llm import simhash as S
from lanewright.llm import trie as T
from tests.llm.conftest import SMALL, words

SPLIT = "[^\x20\x09-\x0d]+"
LOWER = {c: c + 32 for c in range(65, 91)}


def cells(rows):
    return sorted(tuple("" if x is None else str(x) for x in r) for r in rows)


def equal_to_sql(spark, name, *tables):
    df = queries.QUERIES[name](spark, SMALL)
    with duckdb.connect() as c:
        for t in tables:
            c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
        want = c.sql(queries.ORACLE_SQL[name]).project(", ".join(df.columns)).fetchall()
    assert cells(df.collect()) == cells(want)


# --- periodic runs


def plain_runs(w):
    """All maximal runs by comparing every word with the one each period on."""
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(24, 3 * q):
                found.setdefault((s, i - s + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def periodic(rng):
    out, goal = [], rng.choice([0, 5, 24, 60, 250])
    while len(out) < goal:
        unit = [rng.choice("abcd") for _ in range(rng.randint(1, 14))]
        out += (unit * rng.randint(1, 30))[: rng.randint(1, 100)]
    return out


def test_runs_of_all_kinds():
    rng = random.Random(1)
    for _ in range(150):
        texts = [periodic(rng) for _ in range(4)]
        assert R.maximal_runs([R.named(w) for w in texts]) == [plain_runs(w) for w in texts]


def test_runs_of_long_texts():
    rng = random.Random(2)
    assert R.maximal_runs([R.named(["x"] * 30_000)]) == [[(0, 30_000, 1)]]
    unit = [str(rng.randint(0, 3000)) for _ in range(4000)]
    assert R.maximal_runs([R.named(["a", "b"]), R.named(unit), R.named((unit * 4)[:14_000])]) == [[], [], [(0, 14_000, 4000)]]
    fibonacci, last = "ab", "a"
    while len(fibonacci) < 2000:
        fibonacci, last = fibonacci + last, fibonacci
    assert R.maximal_runs([R.named(list(fibonacci))]) == [plain_runs(fibonacci)]


def test_a_passage_shared_is_never_missed():
    rng = random.Random(3)
    for _ in range(100):
        w = [rng.choice("abcdefghij") for _ in range(80)]
        at = rng.randint(16, 64)
        assert R.repeats_a_passage(R.named(w[:at] + w[:16] + w[at:]))


def test_scan_of_edges(spark, edge, edge_rows, empty):
    got = {(r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in R.scan(edge).collect()}
    want = set()
    for row in edge_rows:
        w = re.findall(SPLIT, row[1] or "")
        found = plain_runs(w) if len(w) < 1000 else []
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        want.add((row[0], len(w), tuple(found), " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert got == want and R.scan(edge).count() == len(edge_rows) and R.scan(empty).count() == 0


def test_rewrite_and_digest(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.choice([0, 1, 2, 40, 200]))) for i in range(300)] + [(None, "a b c"), (301, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in R.digest(R.scan(docs.select("doc_id", R.standard_rewrite(docs.doc_id, docs.text).alias("text")))).collect()}
    edited = 0
    for i, text in rows:
        w = re.findall(SPLIT, text or "")
        h, n = zlib.crc32(str(i).encode()) if i is not None else 1, len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]
            edited += 1
        found = plain_runs(w)
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        gone = {x for s, m, q in found for x in range(s + q, s + m)}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want = (i, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
        assert tuple(got[i]) == want
    assert edited > 10


def test_op11_equals_sql(spark):
    equal_to_sql(spark, "op11_periodic_runs", "documents")


# --- conversation trie


def plain_trie(rows, every=5, heads=9):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = tuple(own.get(c - int(math.fmod(c, every)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in sorted(built.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children[path]
        leaves[path] = sum(leaves[x] for x in below) or 1
        saved[path] = sum(saved[x] for x in below) + ((len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0)
    out = []
    for path, of in members.items():
        ends = ",".join(str(c) for c in of if len(built[c]) == len(path))
        out.append((of[0], len(path), members[path[:-1]][0] if path else None, len(of), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, depth long, rep string, n long"


def trie_of(spark, rows):
    return cells(T.nodes(spark.createDataFrame([(*r, 5, "x", 7) for r in rows], CONVERSATIONS).repartition(3)).collect())


def test_trie_of_edges(spark, monkeypatch):
    monkeypatch.setattr(T, "TURNS", 4)
    monkeypatch.setattr(T, "IDS", 3)
    rng = random.Random(5)
    say = lambda: rng.choice(["yes", "no", "é", ""])
    rows = [(c, t, rng.choice(["user", "bot"]), say()) for c in range(0, 30) if c != 10 for t in range(rng.randint(1, 4))]  # 10 isn't there
    long = [(t, "user", f"turn {t % 3}") for t in range(25)]
    rows += [(c, *x) for c in (40, 41, 42, 60, 61) for x in long]  # copies through many rounds
    rows += [(c, 0, "user", "hot") for c in range(100, 140)]
    rows += [(50, None, None, None), (50, None, "a", "z"), (50, 3, "user", "tie"), (50, 3, "bot", "tie"), (50, 3, "bot", "tie"), (50, 3, "bot", "also"), (None, 1, "user", "nobody's")]
    rows += [(-3, 0, "user", "below"), (45, 1, "user", "w " * 40_000)]
    assert trie_of(spark, rows) == cells(plain_trie(rows))


def test_trie_of_one_and_none(spark):
    assert trie_of(spark, [(7, 1, "user", "alone"), (7, 2, "user", "still")]) == cells(plain_trie([(7, 1, "user", "alone"), (7, 2, "user", "still")]))
    assert trie_of(spark, [(None, 1, "user", "x")]) == []
    assert T.nodes(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_a_conversation_over_many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(3, t, "user", str(t)) for t in range(500)] + [(c, 0, "user", "x") for c in range(4, 20)]
        got = T.numbered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).groupBy("conv_id").agg({"pos": "max", "key": "count"}).collect()
        pos = sorted(r.pos for r in T.numbered(spark.createDataFrame(rows[:500], "conv_id long, turn long, role string, text string")).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {tuple(r) for r in got} == {(3, 500, 500), *((c, 1, 1) for c in range(4, 20))} and pos == list(range(1, 501))


def test_op12_equals_sql(spark):
    equal_to_sql(spark, "op12_conversation_trie", "conversations")


# --- SimHash


def plain_print(text):
    w = re.findall(SPLIT, (text or "").translate(LOWER))
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(values):
    """Of each fingerprint the first one that links reach, by comparing all pairs."""
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {v: find(v) for v in values}


def plain_components(rows):
    prints = [plain_print(t) for _, t in rows]
    found, least = components_of(list(dict.fromkeys(prints))), {}
    for (i, _), f in zip(rows, prints, strict=True):
        if i is not None:
            least[found[f]] = min(i, least.get(found[f], i))
    return [(i, f"{f:016x}", least.get(found[f])) for (i, _), f in zip(rows, prints, strict=True)]


def near_texts(rng):
    base = words(rng, 400).split()
    out = [base]
    for _ in range(25):
        copy = rng.choice(out).copy()
        copy[rng.randrange(len(copy))] = "changed"
        out.append(copy)
    return [" ".join(w) for w in out]


def test_simhash_of_edges(spark, edge, edge_rows, empty):
    rng = random.Random(6)
    rows = [(1000 + i, t) for i, t in enumerate(near_texts(rng) + near_texts(rng) + [words(rng, rng.randint(1, 5)) for _ in range(100)])] + [r[:2] for r in edge_rows]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, fingerprint string, rep int").repartition(3)
    got = S.near_duplicates(docs).collect()
    assert cells(got) == cells(plain_components(rows)) and len({r.component_id for r in got}) < len(rows) - 40
    assert cells(S.near_duplicates(edge).collect()) == cells(plain_components([r[:2] for r in edge_rows]))
    assert S.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("tile", [4, 1024])
def test_tiles_lose_no_link(spark, monkeypatch, tile):
    monkeypatch.setattr(S, "TILE", tile)
    rng = random.Random(7)
    values = {rng.getrandbits(64) for _ in range(200)}
    for centre in rng.sample(sorted(values), 4):
        values |= {centre ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(120)}
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    links = S.tile_links(S.tiles(spark.createDataFrame([(v,) for v in signed], "fingerprint long"))).collect()
    pairs = [(r.a % 2**64, r.b % 2**64) for r in links]
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    want, got = components_of(values), {}
    for v in values:
        if v not in got:
            todo = [v]
            while todo:
                x = todo.pop()
                if x not in got:
                    got[x] = v
                    todo += near[x]
    groups = lambda of: {frozenset(v for v in values if of[v] == r) for r in set(of.values())}
    assert groups(got) == groups(want)


def test_op13_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert cells(queries.op13_simhash_neardup(spark, SMALL).collect()) == cells(plain_components(rows))
