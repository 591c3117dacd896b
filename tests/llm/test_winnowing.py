import hashlib
import random

from pyspark.sql import functions as F

from lanewright.llm import queries, winnowing as W
from tests.llm.conftest import SCHEMA, SMALL, row, words


def brute(text):
    """The chosen (hash, position) pairs by the definition: a rolling hash, then the least of each window, the rightmost of equal ones."""
    c = [ord(x.lower()[0]) for x in text]
    k = min(W.K, len(c))
    if not k:
        return []
    up, h, hashes = pow(W.BASE, k - 1, W.PRIME), 0, []
    for i, x in enumerate(c):
        h = ((h - c[i - k] * up if i >= k else h) * W.BASE + x) % W.PRIME
        if i >= k - 1:
            hashes.append(h)
    out = []
    for at in range(max(1, len(hashes) - W.WINDOW + 1)):
        window = hashes[at : at + W.WINDOW]
        place = max(i for i, x in enumerate(window) if x == min(window))
        if (window[place], at + place) not in out[-1:]:
            out.append((window[place], at + place))
    return out


def shown(fingerprint):
    return [(int(x) >> 31, W.POSITION - (int(x) & W.POSITION)) for x in fingerprint.split()]


def similar(a, b):
    x, y = {h for h, _ in a}, {h for h, _ in b}
    return len(x & y) / len(x | y) if x | y else 1.0


def test_match_guarantee_and_rightmost_minimum(spark):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdefgh0123 ") for _ in range(n))
    shared = text(W.K + W.WINDOW - 1)
    texts = [text(200 + i) + shared + text(i) for i in range(14)] + [("ab" * 500)[i:] + shared for i in range(3)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(W.hashes_of(W.chosen(F.col("t"))).alias("h")).collect()
    first = set(rows[0]["h"])
    assert all(first & set(r["h"]) for r in rows)
    same = spark.createDataFrame([("a" * 40,)], "t string").select(W.chosen(F.col("t")).alias("c")).first()["c"]
    assert [W.POSITION - (x & W.POSITION) for x in same] == list(range(W.WINDOW - 1, 40 - W.K + 1))  # of equal hashes the last of each window


def test_fingerprints_by_definition(spark):
    rng = random.Random(2)
    texts = [words(rng, n, "abc\u00c9\u0130\u6f22\U0001d518") for n in (0, 1, 2, 3, 4, 5, 6, 7, 8, 30, 300)] + ["x" * n for n in (15, 16, 30, 31, 32, 100)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    whole = {r["doc_id"]: r["f"] for r in W.fingerprints(docs).select("doc_id", W.printed(F.col("chosen")).alias("f")).collect()}
    piece, W.PIECE = W.PIECE, 64
    try:
        pieces = {r["doc_id"]: r["f"] for r in W.fingerprints(docs).select("doc_id", W.printed(F.col("chosen")).alias("f")).collect()}
    finally:
        W.PIECE = piece
    assert pieces == whole and all(shown(whole[i]) == brute(t) for i, t in enumerate(texts))


def test_letters_that_lower_case_by_their_neighbours(spark):
    texts = ["\u0391\u03a3 \u0391\u03a3\u0391 \u03bf\u03a3" * 9, "\u0130stanbul I\u015eIK " * 7, "\u0391\u03a3", "\u01c4 \u01c5 \u2126 \u212a \u212b \u1e9e " * 8, "\U00010400\U00010401ab" * 20]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["f"] for r in W.fingerprints(docs).select("doc_id", W.printed(F.col("chosen")).alias("f")).collect()}
    assert all(shown(got[i]) == brute(t) for i, t in enumerate(texts))


def test_a_text_is_passed_over_nine_times(spark):
    """Once for its codes, four times for the hashes and their places, four times for the minima; no pass copies the whole array."""
    made = str(spark.createDataFrame([], "t string").select(W.minima(F.col("t"), F.lit(0), W.K, W.WINDOW).alias("m"))._jdf.queryExecution().analyzed())
    assert made.count("slice(") == made.count("zip_with(") == 0
    assert made.count("least(") == 4 and made.count("% ") == 4


def check_edits(rows, result):
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    by_id = {r["doc_id"]: r for r in result}
    for here, after in zip(order, order[1:] + order[:1], strict=True):
        text, cut = here[1] or "", len(here[1] or "") // 4
        edited = text[: len(text) - cut] + (after[1] or "")[:cut]
        got = by_id[here[0]]
        own, other = brute(text), brute(edited)
        assert shown(got["fingerprint"]) == own and shown(got["edited_fingerprint"]) == other
        assert got["near_edited"] == similar(own, other) and got["near_next"] == similar(own, brute(after[1] or ""))
        assert got["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got["n_chars"] == len(text)


def test_edges(spark, edge, edge_rows, empty):
    rows = W.digest(W.edited_and_next(edge)).collect()
    assert len(rows) == len(edge_rows)
    by_text = {}
    for r in rows:
        if r["doc_id"] in (5, 6, 12, 13, 1, 2):
            by_text.setdefault({5: "c", 6: "c", 12: "o", 13: "o"}.get(r["doc_id"], ""), set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in by_text.values())
    assert next(r for r in rows if r["doc_id"] == 5)["near_next"] == 1.0
    assert W.edited_and_next(empty).count() == 0


def test_next_over_many_buckets(spark):
    rng = random.Random(3)
    rows = [row(i * i - 50, words(rng, rng.randint(0, 25))) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    plain = W.in_order
    try:
        for per_bucket, cuts in ((7, 1000), (7, 5), (1000, 1)):
            W.in_order = lambda d, p=per_bucket, c=cuts: plain(d, p, c)
            result = W.digest(W.edited_and_next(docs)).collect()
            assert len(result) == len(rows)
            check_edits(rows, result)
    finally:
        W.in_order = plain


def test_one_id_and_no_id_are_spread(spark):
    rng = random.Random(7)
    rows = [row(None if i % 3 == 0 else 77 if i % 3 == 1 else i, words(rng, 3)) for i in range(1800)]
    placed = W.in_order(spark.createDataFrame(rows, SCHEMA).select("doc_id", "text"), 20)
    sizes = [r["n"] for r in placed.filter("not _guest").groupBy("_seg", "_sub").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 100
    result = W.edited_and_next(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(result) == len(rows)


def test_query(spark):
    rows = queries.op1_winnowing(spark, SMALL).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check_edits(docs, rows)
    near = sorted(r["near_edited"] for r in rows)
    assert near[len(near) // 2] > 0.5 > 0.1 > sorted(r["near_next"] for r in rows)[len(rows) // 2]


def test_of_an_edited_text_only_the_seam_is_made_anew(spark, monkeypatch):
    """The windows of the kept part and of the next text's start are taken from their fingerprints."""
    rng, made = random.Random(12), []
    own, other = words(rng, 90), words(rng, 60)
    keep, cut = len(own) - len(own) // 4, len(own) // 4
    edited = own[:keep] + other[:cut]
    plain = W.windows
    monkeypatch.setattr(W, "windows", lambda text, *rest: made.append(text) or plain(text, *rest))
    docs = spark.createDataFrame([(own, edited, other, keep)], "own string, edited string, other string, keep int")
    docs = docs.withColumns({"a": W.chosen(F.col("own")), "b": W.chosen(F.col("other"))})
    del made[:]
    across = W.chosen_across(F.col("a"), F.col("keep"), F.col("edited"), F.col("b"))
    got, seam = docs.select(W.printed(across), F.length(made[0])).first()
    assert shown(got) == brute(edited) and seam == 2 * (W.K + W.WINDOW - 2) < cut


def test_edits_of_all_lengths(spark):
    rng = random.Random(13)
    texts = ["".join(rng.choice("ab ÉİΣ漢\U0001d518") for _ in range(n)) for n in [*range(0, 140, 3), 500, 12, 600, 131, 700, 129, 800]]
    texts += ["a" * n for n in (0, 200, 31, 300, 60, 90, 124, 1)]
    rng.shuffle(texts)
    rows = [row(i, t) for i, t in enumerate(texts)]
    check_edits(rows, W.digest(W.edited_and_next(spark.createDataFrame(rows, SCHEMA))).collect())
