import collections
import re

import corpus_pipeline as C
from lanewright.llm import langid, mixing, pieces, quality
from tests.llm.conftest import SMALL
from tests.llm.test_minhash import brute


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in C.STAGES:
        out = stage(spark, docs, SMALL)
        out.write.parquet(f"{tmp_path}/{name}")
        seen[name] = (docs, spark.read.parquet(f"{tmp_path}/{name}"))
        docs = seen[name][1]
        assert name == C.STAGES[-1][0] or docs.columns == columns

    before, after = seen["language"]
    rejected = {r["doc_id"] for r in langid.predict(before, langid.fit(before)).collect() if r["rejected"]}
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - rejected

    before, after = seen["quality"]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = {r["doc_id"] for r in quality.score(before, quality.fit(before, labels)).collect() if r["score"] >= 0.5}
    assert {r["doc_id"] for r in after.collect()} == good and 0 < len(good) < before.count()
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert sum(marks.get(i, 1) for i in good) / len(good) > 0.95

    before, after = seen["near_duplicates"]
    want = {i for i, _, c in brute([(r["doc_id"], r["text"]) for r in before.collect()]) if i == c}
    assert {r["doc_id"] for r in after.collect()} == want

    before, after = seen["source_mix"]
    taken = {r["doc_id"]: len(r["draws"]) for r in mixing.mix(before).collect()}
    got = {}
    for r in after.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {i: n for i, n in taken.items() if n}
    words = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t))
    assert sum(words(r["text"]) for r in after.collect()) == sum(r["taken"] for r in mixing.mix(before).collect())
    whole = {r["doc_id"]: r["text"] for r in before.collect()}
    cut = [r for r in after.collect() if r["text"] != whole[r["doc_id"]]]
    assert len(cut) <= before.select("source").distinct().count() and all(whole[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"]) for r in cut)

    before, after = seen["sentencepiece"]
    decoder = pieces.Decoder(pieces.load())
    texts = sorted((r["doc_id"], r["text"]) for r in before.collect())
    assert sorted((r["doc_id"], decoder.decode(r["ids"])) for r in after.collect()) == texts and all(r["n_ids"] == len(r["ids"]) for r in after.collect())


def counted(rows):
    return collections.Counter((r["doc_id"], r["text"]) for r in rows)


def test_stages_of_edges(spark, edge, edge_rows):
    """What the docstring promises of nulls, empty and long texts, repeated rows and clashing names, stage by stage."""
    given = counted([{"doc_id": r[0], "text": r[1]} for r in edge_rows])
    copy = edge_rows[5][1]
    for name, stage in C.STAGES:
        rows = stage(spark, edge, SMALL).collect()
        if name == "sentencepiece":
            decoder = pieces.Decoder(pieces.load())
            assert counted([{"doc_id": r["doc_id"], "text": decoder.decode(r["ids"])} for r in rows]) == collections.Counter({(i, t or ""): n for (i, t), n in given.items()} | {(None, ""): 1})
            continue
        got = counted(rows)
        assert rows and set(rows[0].asDict()) == set(edge.columns) and all(r["node"] == 7 and r["_id"] == 99 and r["value"] == "v" for r in rows)
        if name == "source_mix":  # whole but for one document a source; wordless ones never
            words = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
            assert sum(n * words(t) for (_, t), n in got.items()) == sum(r["taken"] for r in mixing.mix(edge).collect())
            assert sum(x not in given for x in got) <= 4 and not any(i in (1, 2, 3) for i, _ in got) and all(n <= 2 * given.get(x, 1) for x, n in got.items())
        else:
            assert got <= given
        if name == "language":
            assert not {i for i, _ in got} & {1, 2, 3, 4} and all(n == given[x] for x, n in got.items())
        if name == "quality":  # equal texts are judged alike
            for t in {t or "" for _, t in given}:
                assert len({x in got for x in given if (x[1] or "") == t}) == 1
        if name == "near_duplicates":
            want = {x: 1 for x in given if x[0] is not None} | {x: n for x, n in given.items() if x[0] is None}
            for gone in ((6, copy), (7, copy.replace("a", "b", 1)), (21, copy), (13, "one")):
                del want[gone]
            assert got == want


def test_stages_of_an_empty_table(spark, empty):
    for name, stage in C.STAGES:
        out = stage(spark, empty, SMALL)
        assert out.count() == 0 and (name == "sentencepiece" or out.columns == empty.columns)


def test_run(spark):
    out = C.run(spark, SMALL)
    assert out.columns == ["doc_id", "ids", "n_ids"] and out.count() > 50 and C.ORACLE_SQL is None
