"""Sharding and mixing."""

import collections
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from lanewright.llm import mixing as M
from lanewright.llm import queries
from lanewright.llm import sharding as S
from tests.llm.conftest import SCHEMA, SMALL, row, words


def check_shards(rows, n, shards=40):
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == n and all(sorted(v) == list(range(len(v))) for v in slots.values())
    counts = [len(slots.get(s, ())) for s in range(shards)]
    assert max(counts) - min(counts) <= 1


def test_shards_of_edges(spark, edge, edge_rows, empty):
    rows = S.digest(S.with_shards(edge)).collect()
    check_shards(rows, len(edge_rows))
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == collections.Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in edge_rows)
    assert S.with_shards(empty).count() == 0
    clashing = edge.withColumns({c: F.lit(5) for c in ("_size", "_bucket", "_draw", "_number", "_offset", "_order", "_place", "_shard", "_slot", "_rows")})
    sharded = S.with_shards(clashing)
    assert sharded.columns[:-3] == clashing.columns and sharded.filter("_place = 5 and _slot = 5").count() == len(edge_rows)
    check_shards(S.digest(sharded).collect(), len(edge_rows))


def brute_shards(spark, docs, shards, seed, bucket_bytes):
    """Buckets, draws and permutations from plain hashes, one after the other."""
    hashed = docs.select("doc_id", "text", *[F.xxhash64(F.lit(seed + i), "doc_id", "text").alias(f"h{i}") for i in (0, 1)]).collect()
    size = sum(len((r["text"] or "").encode()) + S.ROW_BYTES for r in hashed)
    buckets = max(1, -(-size // bucket_bytes))
    of = collections.defaultdict(list)
    for r in hashed:
        of[r["h0"] % buckets].append(r)
    place, out = 0, {}
    orders = spark.createDataFrame([(b, len(of[b])) for b in sorted(of)], "b long, n int").coalesce(1).sortWithinPartitions("b").select("b", F.shuffle(F.sequence(F.lit(0), F.col("n") - 1), F.lit(seed)).alias("o")).collect()
    for b, order in ((r["b"], r["o"]) for r in orders):
        assert sorted(order) == list(range(len(of[b])))
        for k, r in zip(order, sorted(of[b], key=lambda r: (r["h1"], r["doc_id"])), strict=True):
            out[r["doc_id"]] = place + k
        place += len(of[b])
    first = [-(-s * place // shards) for s in range(shards + 1)]
    shard_of = lambda p: max(s for s in range(shards) if first[s] <= p)
    return {i: (shard_of(p), p - first[shard_of(p)]) for i, p in out.items()}


def test_shards_by_brute_force(spark):
    rng = random.Random(15)
    docs = spark.createDataFrame([row(i * 3, words(rng, rng.randint(0, 12))) for i in range(400)], SCHEMA)
    got = {r["doc_id"]: (r["_shard"], r["_slot"]) for r in S.with_shards(docs, 7, 20, 1024).collect()}
    assert got == brute_shards(spark, docs, 7, 20, 1024)


def test_shards_over_buckets_are_shuffled_and_repeatable(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([row(i, words(rng, 8)) for i in range(3000)], SCHEMA)
    once, again = ([(r["_shard"], r["_slot"], r["doc_id"]) for r in S.with_shards(docs, 7, bucket_bytes=4096).collect()] for _ in range(2))
    check_shards([{"shard": a, "slot": b} for a, b, _ in once], 3000, 7)
    assert sorted(once) == sorted(again)
    ids = [i for _, _, i in sorted(once)]
    assert abs(np.corrcoef(ids, range(3000))[0, 1]) < 0.1


def test_shard_files(spark, tmp_path):
    docs = spark.createDataFrame([row(i, "t") for i in range(100)], SCHEMA)
    S.write_shards(S.with_shards(docs, 4), f"{tmp_path}/out", 3)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 100 and back.select("_shard").distinct().count() == 4


def test_query_sharding(spark):
    rows = queries.op4_shuffled_shards(spark, SMALL).collect()
    check_shards(rows, 200)


def test_targets_by_hand():
    assert M.targets([100, 100, 100], [5, 2, 1]) == [200.0, 500 / 3, 250 / 3]
    assert M.targets([0, 10], [5, 2]) == [0.0, 15.0] and M.targets([], []) == [] and M.targets([0], [5]) == [0.0]
    rng = random.Random(6)
    for _ in range(50):
        sizes = [rng.randint(0, 1000) for _ in range(rng.randint(1, 30))]
        weights = [M.WEIGHTS[i % 3] for i in range(len(sizes))]
        t = M.targets(sizes, weights)
        assert abs(sum(t) - 1.5 * sum(sizes)) < 1e-6 and all(x <= 2 * s + 1e-9 for x, s in zip(t, sizes))


def test_splitting_tree_is_exact_and_disjoint():
    quotas = np.array([100, 3, 0, 57])
    leaves = list(M.split(160, 9, quotas, 1, 0, 9))
    assert [s for s, _, _ in leaves] == list(range(9)) and sum(n for _, _, n in leaves).tolist() == quotas.tolist()
    assert {int(n.sum()) for _, _, n in leaves} <= {17, 18}
    at = np.zeros(4, int)
    for _, start, n in leaves:
        assert (start == at).all()
        at += n
    assert [(s, a.tolist(), n.tolist()) for s, a, n in M.split(160, 9, quotas, 1, 3, 5)] == [(s, a.tolist(), n.tolist()) for s, a, n in leaves[3:5]]
    means = np.mean([next(M.split(160, 2, quotas, seed, 0, 1))[2] for seed in range(400)], axis=0)
    assert np.allclose(means, quotas / 2, atol=0.6)  # hypergeometric means


def size(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def check_mix(docs, rows):
    assert collections.Counter((r["doc_id"], r["size"]) for r in rows) == collections.Counter((d[0], size(d[1])) for d in docs)
    sources = sorted({d[3] for d in docs}, key=lambda s: (s is None, s or ""))
    of = {s: sum(size(d[1]) for d in docs if d[3] == s) for s in sources}
    want = dict(zip(sources, M.targets([of[s] for s in sources], [M.WEIGHTS[i % 3] for i in range(len(sources))])))
    source_of = {(d[0], size(d[1])): d[3] for d in docs}
    taken = collections.Counter()
    for r in rows:
        assert r["taken"] <= 2 * r["size"]
        s = source_of[r["doc_id"], r["size"]]
        assert r["source_size"] == of[s] and abs(r["target"] - want[s]) < 1e-6
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sources)


def test_mix_edges(spark, edge, edge_rows, empty, tmp_path):
    plan = M.mix(edge, block_words=64, shard_blocks=8)
    rows = [r for r in plan.collect() if r["doc_id"] != 6]  # 6 and 5 differ in source only
    assert plan.count() == len(edge_rows)
    assert sorted(map(str, plan.collect())) == sorted(map(str, M.mix(edge, block_words=64, shard_blocks=8).collect()))
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert M.mix(empty).count() == 0
    copies = M.mixed(edge, plan)
    assert copies.columns == edge.columns and copies.filter("doc_id in (1, 2, 3)").count() == 0
    assert sum(size(r["text"]) for r in copies.collect()) == sum(r["taken"] for r in plan.collect())
    clashing = edge.withColumns({c: F.lit(5) for c in ("_shard", "_words", "_order", "_text", "_nth", "_copies", "size", "draw", "doc", "id", "hash")})
    M.write_mix(clashing, M.mix(clashing, block_words=64, shard_blocks=8), f"{tmp_path}/clash", 2)
    back = spark.read.parquet(f"{tmp_path}/clash")
    assert back.filter("_shard = 5 and _words = 5").count() == back.count() == copies.count()


def test_repeated_rows_are_drawn_one_by_one(spark, tmp_path):
    rng = random.Random(12)
    docs = [row(i, words(rng, 20), source="ab"[i % 2]) for i in range(40)]
    docs += [docs[3]] * 5 + [row(None, None)] * 4 + [row(7, "x y z", source=None)] * 2
    frame = spark.createDataFrame(docs, SCHEMA)
    plan = M.mix(frame, block_words=16, shard_blocks=4)
    rows = plan.collect()
    check_mix(docs, rows)
    M.write_mix(frame, plan, f"{tmp_path}/mix", 2)
    back = spark.read.parquet(f"{tmp_path}/mix").collect()
    assert sum(r["_words"] for r in back) == sum(r["taken"] for r in rows) and all(size(r["text"]) == r["_words"] for r in back)
    want = collections.Counter(r["doc_id"] for r in rows for _ in r["draws"])
    assert want == collections.Counter(r["doc_id"] for r in back) == collections.Counter(r["doc_id"] for r in M.mixed(frame, plan).collect())


def test_cut_keeps_whole_words(spark):
    texts = ["  one two\n three  ", "one", "a\tb"]
    got = spark.createDataFrame([(t, n) for t in texts for n in (1, 2)], "t string, n int").select(M.cut(F.col("t"), F.col("n")).alias("c")).collect()
    assert [r["c"] for r in got] == ["  one", "  one two", "one", "one", "a", "a\tb"]


def test_mix_many_blocks(spark, tmp_path):
    rng = random.Random(8)
    docs = [row(i, words(rng, rng.randint(0, 30)), source=rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(600)]
    frame = spark.createDataFrame(docs, SCHEMA)
    plan = M.mix(frame, block_words=40, shard_blocks=5)
    check_mix(docs, plan.collect())
    M.write_mix(frame, plan, f"{tmp_path}/mix", 2)
    back = spark.read.parquet(f"{tmp_path}/mix")
    assert back.selectExpr("sum(_words)").first()[0] == sum(r["taken"] for r in plan.collect())
    assert back.select("_shard").distinct().count() > 3


def test_query_mix(spark):
    docs = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = queries.op2_source_mix(spark, SMALL).collect()
    check_mix(docs, rows)
    per_shard = collections.Counter(s for r in rows for s in r["shards"].split(",") if s)
    assert len(per_shard) >= 24  # the tree has draws to make at every size


def test_mixed_rows_stand_by_shard_in_random_order(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = M.mix(docs)
    shard_of = {}
    for r in plan.collect():
        shard_of.setdefault(r["doc_id"], set()).update(d["shard"] for d in r["draws"])
    parts = [list(p) for p in M.mixed(docs, plan).select("doc_id").rdd.map(lambda r: r[0]).glom().collect()]
    once = [[next(iter(shard_of[i])) for i in p if len(shard_of[i]) == 1] for p in parts]
    assert all(p == sorted(p) for p in once) and len({s for p in once for s in p}) > 20
    assert sum(p != sorted(p) for p in parts if len(p) > 5) > 0
