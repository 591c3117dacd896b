"""Quality classifier and language identification."""

import random
import zlib

from lanewright.llm import langid as L
from lanewright.llm import quality as Q
from lanewright.llm import queries
from tests.llm.conftest import SCHEMA, SMALL, row, words

FACTS = "/root/testdata/sf0.01"


def out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_quality_held_out(spark):
    rows = {r["doc_id"]: r for r in queries.op3_quality_classifier(spark, FACTS).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FACTS}/labels.parquet").collect()}
    n = spark.read.parquet(f"{FACTS}/documents.parquet").count()
    assert len(rows) == n and all(r["held_out"] == out(i) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for i, r in rows.items())
    tested = [(rows[i]["predicted"], q) for i, q in labels.items() if out(i)]
    assert sum(p == q for p, q in tested) / len(tested) > 0.93
    good = [p for p, q in tested if q == 1]
    assert sum(good) / len(good) > 0.97


def test_quality_edges(spark, edge, edge_rows, empty):
    rng = random.Random(9)
    docs = spark.createDataFrame([row(i, words(rng, 30) if i % 2 else "### " + words(rng, 30).replace(" ", " ### ")) for i in range(60)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 0, None) for i in range(60)] + [(None, 1, None, None), (3, None, 0, None)], "doc_id long, quality int, toxic int, text string")
    model = Q.fit(docs, labels, dictionary=2000)
    rows = Q.score(edge, model).collect()
    assert len(rows) == len(edge_rows) and len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert Q.score(empty, model).count() == 0 and Q.kept(edge, model).columns == edge.columns
    held = {r["doc_id"]: r for r in Q.score(docs, model).collect()}
    assert sum(held[i]["predicted"] == i % 2 for i in range(60)) > 50
    blank = Q.fit(empty, labels)
    assert {r["score"] for r in Q.score(edge, blank).collect()} == {0.5} and Q.kept(edge, blank).count() == len(edge_rows)
    assert Q.fit(docs, labels.filter("quality = 1")) == Q.QualityModel()


def test_quality_learns_from_training_rows_only(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    from pyspark.sql import functions as F

    from lanewright.llm.common import held_out

    spoilt = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert Q.fit(docs, labels) == Q.fit(docs, spoilt)


def test_language_held_out(spark):
    rows = {r["doc_id"]: r for r in queries.op8_language_id(spark, FACTS).collect()}
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{FACTS}/documents.parquet").collect()}
    assert rows.keys() == langs.keys() and all(r["held_out"] == out(i) and 0 <= r["score"] <= 1 for i, r in rows.items())
    tested = [i for i in langs if out(i)]
    assert sum(rows[i]["lang_pred"] == langs[i] for i in tested) / len(tested) > 0.98
    assert sum(r["rejected"] for r in rows.values()) == 0


def test_language_edges(spark, edge, edge_rows, empty):
    model = L.fit(spark.read.parquet(f"{SMALL}/documents.parquet"), per_language=50)
    rows = L.predict(edge, model).collect()
    assert len(rows) == len(edge_rows)
    for r in rows:
        text = next(e[1] for e in edge_rows if e[0] == r["doc_id"]) if r["doc_id"] is not None else "a"
        if not any(map(str.isalpha, text or "")):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        elif r["doc_id"] is not None:
            assert r["lang_pred"] in model.languages
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[10]["rejected"] and by_id[11]["rejected"]
    kept = L.kept(edge, model)
    assert kept.columns == edge.columns and kept.filter("doc_id in (1, 2, 3, 4, 10, 11)").count() == 0
    none = L.fit(empty)
    assert {r["lang_pred"] for r in L.predict(edge, none).collect()} == {"und"} and L.predict(empty, model).count() == 0
    assert L.fit(edge.filter("lang is null")).languages == ()


def test_several_centroids(spark):
    model = L.fit(spark.read.parquet(f"{SMALL}/documents.parquet"), per_language=50, clusters=3)
    assert max((model.language_of == i).sum() for i in range(len(model.languages))) == 3
    assert abs((model.centroids**2).sum(axis=1) - 1).max() < 1e-4


def test_language_rejects_latin_script_and_noise(spark):
    model = L.fit(spark.read.parquet(f"{FACTS}/documents.parquet"))
    rng = random.Random(5)
    foreign = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı.",
    ]
    noise = [words(rng, n, a) for n in (30, 100, 2000) for a in ("bcdfghjklmnpqrstvwxz", "abcdefghijklmnopqrstuvwxyz")]
    noise += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(n)) for n in (200, 8000)]
    clean = ["That it.", "Erinst resh.", "The", "Von.", "der und", "que los", "Des. Des. Des. Des. Des. Des. Des. Des.", "from the and that"]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(foreign + noise + clean)], SCHEMA)
    rejected = {r["doc_id"] for r in L.predict(docs, model).collect() if r["rejected"]}
    assert rejected == set(range(len(foreign + noise)))
    assert {r["doc_id"] for r in L.kept(docs, model).collect()} == set(range(len(foreign + noise), len(foreign + noise + clean)))


def test_language_keeps_pieces_of_held_out_texts(spark):
    rows = spark.read.parquet(f"{FACTS}/documents.parquet").collect()
    model, letters = L.fit(spark.read.parquet(f"{FACTS}/documents.parquet")), L._letters()
    texts = [r["text"].split() for r in rows if out(r["doc_id"])]
    for n in (1, 2, 4, 8, 16, 32, 64):
        judged = L.judge(model, letters, [" ".join(w[len(w) // 2 :][:n]) for w in texts if len(w) >= 2 * n])
        assert sum(r for language, _, r in judged if language != L.UNKNOWN) <= 0.01 * len(judged)


def repeated(spark, docs, row_, times):
    """docs and one more row that stands there many times."""
    from pyspark.sql import functions as F

    one = spark.createDataFrame([row_], docs.schema)
    return docs.union(one.select(*one.columns, F.explode(F.sequence(F.lit(1), F.lit(times))).alias("_again")).drop("_again"))


def test_a_repeated_row_pushes_out_no_language(spark):
    docs = spark.read.parquet(f"{FACTS}/documents.parquet")
    one = docs.filter("lang = 'de' and length(text) between 200 and 3000 and crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1").first()
    assert not out(one["doc_id"])
    model = L.fit(repeated(spark, docs, one, 6000))
    assert model.languages == L.fit(docs).languages and len(model.languages) == 4
    held = {r["doc_id"]: (r["lang"], r["lang_pred"]) for r in L.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect() if out(r["doc_id"])}
    assert sum(a == b for a, b in held.values()) / len(held) > 0.97


def test_copies_of_a_training_id_leave_both_labels(spark):
    docs, labels = spark.read.parquet(f"{FACTS}/documents.parquet"), spark.read.parquet(f"{FACTS}/labels.parquet")
    of = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    for label in (0, 1):
        one = next(r for r in docs.collect() if of.get(r["doc_id"]) == label and not out(r["doc_id"]) and r["text"] and len(r["text"]) < 2000)
        chosen = Q.sample(repeated(spark, docs, one, 12_000), labels, 100, 20_000, 7)
        assert sum(k == label for _, k in chosen) == sum(k != label for _, k in chosen) == 100 == len({t for t, k in chosen if k == label})
