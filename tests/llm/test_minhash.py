import random

from pyspark.sql import functions as F

from lanewright.llm import minhash as H
from lanewright.llm import queries
from lanewright.llm.common import FILTER_BITS, bits_of, perhaps_in
from lanewright.llm import components as parts
from lanewright.llm.components import components
from lanewright.llm.shingles import Powers, shingle_sets
from tests.llm.conftest import SCHEMA, SMALL, row, words

LOWER = {c: c + 32 for c in range(65, 91)}


def plain_set(text):
    import re

    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """component of each (id, text) by comparing all pairs."""
    sets = [(i, plain_set(t)) for i, t in rows if i is not None]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (_, x) in enumerate(sets):
        for b in range(a):
            y = sets[b][1]
            both = len(x & y)
            if x and y and 100 * both >= 75 * (len(x) + len(y) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


def test_shingle_sets():
    rng = random.Random(1)
    texts = [None, "", "one", "One TWO", "a b c d e", "A b C d e f", words(rng, 50), "É é x y z w", " \t x "]
    sets = shingle_sets(texts, Powers())
    assert [len(s) for s in sets] == [len(plain_set(t)) for t in texts]
    assert len(set(sets[4].tolist()) & set(sets[5].tolist())) == 1


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, i) for i in range(101, 140)]
    loose = [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(25)]
    edges = chain + star + loose + [(7, 7), (500, 499)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_nodes_with_few_and_with_many_links(spark, monkeypatch):
    rng = random.Random(12)
    edges = spark.createDataFrame([(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(400, 401 + i) for i in range(30)] + [(500 - i, 430) for i in range(30)], "a long, b long")
    few = sorted(map(tuple, components(edges).collect()))
    monkeypatch.setattr(parts, "MOST_LINKS", 3)
    assert sorted(map(tuple, components(edges).collect())) == few
    assert parts.shape(edges.filter("a = 400"))[0] and parts.shape(edges.filter("a = 400"))[1] == 30 and not parts.shape(edges.filter("a >= 400"))[0]


def test_a_round_of_components_shuffles_three_times(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    plan = parts.small_star(parts.large_star(edges, parts.with_least_of_few), parts.with_least_of_few)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 3 and "Join" not in plan


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else w + "x" for w in text.split())


def test_groups_against_brute_force(spark):
    rng = random.Random(3)
    passage = words(rng, 60)
    texts = [words(rng, rng.randint(1, 90)) for _ in range(60)]
    texts += [passage + " " + words(rng, rng.randint(10, 60)) for _ in range(60)]  # a passage that many share
    base = words(rng, 120)
    texts += [edited(rng, base, rng.choice([0.01, 0.03, 0.05, 0.08])) for _ in range(120)] + [base] * 5
    small = words(rng, 30)
    texts += [edited(rng, small, 0.03) for _ in range(40)] + ["", None, "same few words", "same FEW words", "same few"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = H.near_duplicates(spark.createDataFrame([row(i, t) for i, t in rows], SCHEMA)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_edges(spark, edge, edge_rows, empty):
    got = H.near_duplicates(edge).collect()
    assert len(got) == len(edge_rows) and H.near_duplicates(empty).count() == 0
    by_id = {r["doc_id"]: r for r in got}
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    assert by_id[5]["component_id"] == by_id[6]["component_id"] == 5 and by_id[13]["component_id"] == 12
    assert by_id[1]["component_id"] == 1 and by_id[2]["component_id"] == 2 and by_id[1]["n_shingles"] == 0
    kept = H.kept_documents(edge)
    assert kept.columns == edge.columns and {1, 2, 3, 5, 12} <= {r["doc_id"] for r in kept.collect()}
    assert not {6, 13} & {r["doc_id"] for r in kept.collect()}


def test_repeated_ids_lose_no_text_and_keep_no_copy(spark, edge, edge_rows):
    kept = [(r["doc_id"], r["text"]) for r in H.kept_documents(edge).collect()]
    texts = {i: [e[1] for e in edge_rows if e[0] == i] for i in (5, 20, 21)}
    assert [t for i, t in kept if i == 21] == texts[21][:1] and sorted(t for i, t in kept if i == 20) == sorted(texts[20]) and (5, texts[5][0]) in kept
    rng = random.Random(8)
    one, two, three = (words(rng, 40) for _ in range(3))
    rows = [(1, one), (1, one), (1, one + " end"), (1, two), (2, one), (2, three), (2, three), (3, three), (4, ""), (4, ""), (4, None), (None, one), (None, one)]
    rows += [(9, two.upper()), (12, "one"), (12, "one"), (12, "ONE")]
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in H.kept_documents(spark.createDataFrame([row(*x) for x in rows], SCHEMA).repartition(3)).collect()))
    of_one = [t for i, t in got if i == 1 and t != two]
    assert len(of_one) == 1 and of_one[0] in (one, one + " end") and len([t for i, t in got if i == 12]) == 1
    assert [x for x in got if x[0] not in (1, 12)] == [(0, one), (0, one), (2, three), (4, ""), (4, "")] and (1, two) in got


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = queries.op6_minhash_neardup(spark, SMALL).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows)


def test_filter_misses_no_key(spark):
    keys = spark.range(-2000, 2000).select(F.col("id"), F.xxhash64(F.col("id").cast("string")).alias("h"))
    rows = spark.range(-6000, 6000).select("id", F.xxhash64(F.col("id").cast("string")).alias("h")).union(spark.sql("select cast(null as bigint), 1L"))
    bits = bits_of(keys)
    assert bits.select(F.size("bits")).collect() == [(FILTER_BITS // 64,)]
    passed = {r.id for r in rows.filter(perhaps_in(bits, F.col("id"), F.col("h"))).collect()}
    assert set(range(-2000, 2000)) <= passed and len(passed) < 4010
    none = bits_of(keys.filter("false"))
    assert rows.filter(perhaps_in(none, F.col("id"), F.col("h"))).isEmpty()
