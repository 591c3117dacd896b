"""Licence scans, media columns, SentencePiece ids and token counts."""

import hashlib
import io
import random
import re
import wave
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lanewright.llm import common
from lanewright.llm import licences as C
from lanewright.llm import media as D
from lanewright.llm import pieces as P
from lanewright.llm import queries
from lanewright.llm import tokencount as T
from tests.llm.conftest import SMALL, words

# licences


def brute(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
    found = [(i, label) for phrase, label in C.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["MIT", "license", "Apache", "general", "public", "License", "GNU", "é", "x1", "\n", "-", "SPDX-License-Identifier: MIT OR GPL-2.0\n"]), max_size=30), st.sampled_from([" ", "\n", "-", "."]))
def test_base_places(parts, gap):
    text = gap.join(parts)
    assert C.scan_text(text, C.automaton(C.BASE | C.NOTICES))[:5] == brute(text)


def test_expressions():
    assert C.shunting_yard("MIT OR Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0") == ["mit", "apache-2.0", "gpl-2.0-only", "classpath-exception-2.0", "with", "and", "or"]
    assert C.shunting_yard("(MIT OR X) AND Y") == ["mit", "x", "or", "y", "and"]
    assert [C.shunting_yard(x) for x in ("", "MIT OR", "AND", "(MIT", "MIT)", "MIT MIT", "()")] == [None] * 7
    assert C.evaluate(C.shunting_yard("MIT AND GPL-3.0")) == ({"mit", "gpl"}, 0.3) and C.evaluate(C.shunting_yard("MIT OR GPL-3.0"))[1] == 1.0
    scan = lambda t: C.scan_text(t, C.automaton(C.BASE | C.NOTICES))
    assert scan("# SPDX-License-Identifier: (BSD-3-Clause OR Foo-1)\ncode")[5:] == ("bsd,foo-1", 1.0)
    assert scan("Licensed under CC BY-NC 4.0.")[4:] == ("", "cc-by-nc", 0.1)
    lesser, plain = scan("GNU Lesser General Public License"), scan("the GNU Lesser General Public License or the GNU General Public License")
    assert lesser[4:7] == ("gpl", "gpl,lgpl", 0.5) and plain[4:7] == ("gpl", "gpl,lgpl", 0.3)
    assert scan("spdx-license-identifier: (((")[5:] == ("", 0.0)


def test_tags_before_prose():
    scan = lambda t: C.scan_text(t, C.automaton(C.BASE | C.NOTICES))[5:]
    tag = "SPDX-License-Identifier: "
    cases = {
        "Apache-2.0 This file is part of X": ("apache", 1.0), "MIT -- see LICENSE": ("mit", 1.0), "GPL-2.0 */ int main(void)": ("gpl", 0.3), "MIT.": ("mit", 1.0), "MIT. And this": ("mit", 1.0),
        "MIT OR GPL-2.0 and more words": ("gpl,mit", 1.0), "(MIT AND GPL-2.0) OR Foo-1, if (x)": ("foo-1,gpl,mit", 0.5), "MIT and this is prose": ("mit", 1.0), "MIT or apache-2.0 at will": ("apache,mit", 1.0),
        "(MIT is open": ("", 0.0), "GPL-2.0 WITH Classpath-exception-2.0 as told": ("gpl", 0.3), '"MIT" OR "ISC" */': ("isc,mit", 1.0), "MIT " + tag + "GPL-2.0 then": ("gpl,mit", 0.3), "\nMIT": ("", 0.0),
    }
    assert {x: scan(tag + x) for x in cases} == cases
    for spelt in ("SPDX License Identifier: MIT", "spdx license identifier MIT here", "SPDX_License_Identifier: MIT", "License  Identifier : MIT\nx"):
        assert scan(spelt) == ("mit", 1.0), spelt
    assert scan("The license identifier is in the file") == ("", 0.0)
    assert scan((tag + "MIT AND ( x ") * 20_000)[0] == "mit"  # linear in the text


def test_licence_edges(spark, edge, edge_rows, empty):
    rows = {(r["doc_id"], r["n_words"]): r for r in C.scan(edge).collect()}
    assert C.scan(edge).count() == len(edge_rows) and C.scan(empty).count() == 0
    for e in edge_rows:
        r = rows[e[0], brute(e[1])[0]]
        assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(e[1])[1:] and 0 <= r["score"] <= 1


def test_licence_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.op5_license_scan(spark, SMALL).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


# media


def test_media_edges(spark, edge, edge_rows, empty):
    rows = D.media_columns(edge).collect()
    assert len(rows) == len(edge_rows) and D.media_columns(empty).count() == 0
    texts = {(e[0], len((e[1] or "").encode())): e[1] or "" for e in edge_rows}
    for r in rows:
        payload = texts[r["doc_id"], r["n_bytes"]].encode()
        payload += bytes(max(64, (len(payload) + 63) // 64 * 64) - len(payload))
        with wave.open(io.BytesIO(bytes(r["media"]))) as w:
            assert w.readframes(w.getnframes()) == payload and w.getsampwidth() == 1
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["payload_bytes"] == len(payload) and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest() and r["media_bytes"] == len(r["media"])
        assert len(r["times"]) == len(r["codes"]) and list(r["times"]) == sorted(r["times"])
    features = {r["doc_id"]: r["feature"] for r in D.digest(D.media_columns(edge)).collect()}
    assert features[5] == features[6] and features[12] == features[13] and features[1] == features[2] and features[5] != features[8]


def test_blocks_of_frames_and_tones():
    rng = np.random.default_rng(1)
    samples = rng.integers(0, 256, 64 * 3000, dtype=np.uint8)
    whole = D.band_peaks(samples)
    block, D.BLOCK = D.BLOCK, 100
    try:
        assert all((a == b).all() for a, b in zip(whole, D.band_peaks(samples)))
    finally:
        D.BLOCK = block
    tone = (128 + 100 * np.sin(2 * np.pi * 5 * np.arange(64 * 20) / D.FRAME)).astype(np.uint8)
    assert set(D.band_peaks(tone)[0][:-2, 0]) == {5}


def test_media_query(spark):
    rows = queries.op10_media_columns(spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    same = {}
    for r in rows:
        assert r["n_bytes"] == len(texts[r["doc_id"]].encode())
        same.setdefault(texts[r["doc_id"]], set()).add((r["feature"], r["media_sha256"]))
    assert len(rows) == len(texts) and all(len(v) == 1 for v in same.values())


# SentencePiece


def whole_viterbi(encoder, text):
    """Score of the best segmentation, with all states kept."""
    pieces, n = encoder.model.pieces, len(text)
    best = [0.0] + [-float("inf")] * n
    for i in range(n):
        for j in range(i + 1, min(n, i + encoder.longest) + 1):
            if text[i:j] in pieces:
                best[j] = max(best[j], best[i] + pieces[text[i:j]][1])
        if text[i] not in pieces:
            best[i + 1] = max(best[i + 1], best[i] + encoder.floor)
    return best[n]


def score_of(encoder, text, ids):
    """Score of the segmentation that ids say."""
    of = {i: (p, s) for p, (i, s) in encoder.model.pieces.items()}
    at, total, k = 0, 0.0, 0
    while k < len(ids):
        if ids[k] in of:
            piece, s = of[ids[k]]
            assert text.startswith(piece, at)
            at, total, k = at + len(piece), total + s, k + 1
        else:
            at, total, k = at + 1, total + encoder.floor, k + len(text[at].encode())
    assert at == len(text)
    return total


TOY = P.PieceModel({"a": (0, -3.0), "b": (1, -3.0), "ab": (2, -4.0), "ba": (3, -4.5), "abab": (4, -9.0), "bb": (5, -4.0), "▁": (6, -2.0), "▁a": (7, -3.5), "aab": (8, -6.0)}, tuple(range(100, 356)), 99)
TOY_ENCODER, ENCODER = P.Encoder(TOY), P.Encoder(P.load())


def whole_ids(encoder, text):
    """The ids of the best segmentation, made with all states kept; the first one found of equally good ones."""
    pieces, n = encoder.model.pieces, len(text)
    best, back = [0.0] + [-float("inf")] * n, [0] * (n + 1)
    for i in range(n):
        for j in range(i + 1, min(n, i + encoder.longest) + 1):
            if text[i:j] in pieces and best[i] + pieces[text[i:j]][1] > best[j]:
                best[j], back[j] = best[i] + pieces[text[i:j]][1], i
        if best[i] + encoder.floor > best[i + 1]:
            best[i + 1], back[i + 1] = best[i] + encoder.floor, i
    cuts = [n]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    parts = [text[a:b] for b, a in zip(cuts, cuts[1:], strict=False)][::-1]
    return [i for p in parts for i in ([pieces[p][0]] if p in pieces else encoder.unknown(p))]


def streamed(encoder, text):
    return [i for part in encoder.stream(text) for i in np.frombuffer(part, "<i4").tolist()]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab▁c", min_size=1, max_size=90))
def test_streaming_equals_whole_toy(text):
    assert streamed(TOY_ENCODER, text) == whole_ids(TOY_ENCODER, text)
    assert abs(score_of(TOY_ENCODER, text, streamed(TOY_ENCODER, text)) - whole_viterbi(TOY_ENCODER, text)) < 1e-9


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_round_trip(text):
    assert P.Decoder(ENCODER.model).decode(ENCODER.encode(text).tolist()) == text


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="theingrstaoéß .,\n#", min_size=1, max_size=300))
def test_streaming_equals_whole(text):
    put = "▁" + text.replace(" ", "▁")
    assert ENCODER.encode(text).tolist() == streamed(ENCODER, put) == whole_ids(ENCODER, put)


def test_commits_before_the_end():
    parts = [np.frombuffer(p, "<i4") for p in ENCODER.stream("abcdefghijklmnopqrstuvwxyz" * 40)]
    assert len(parts) > 20 and max(map(len, parts)) < 60


def test_paths_that_meet_late():
    """Both ways through a run of one letter stay open until its end, so the window must grow."""
    model = P.PieceModel({"a": (0, -9.0), "aa": (1, -2.0), "b": (2, -1.0), "ab": (3, -1.0)}, tuple(range(100, 356)), 99)
    for n in (50, 51, 400, 401):
        text = "a" * n + "b"
        assert streamed(P.Encoder(model), text) == whole_ids(P.Encoder(model), text)


def test_query_ids_equal_a_whole_viterbi(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in P.encode(docs, ENCODER.model).collect()}
    for r in docs.collect():
        if "\u2581" not in r["text"]:
            assert got[r["doc_id"]] == whole_ids(ENCODER, "\u2581" + r["text"].replace(" ", "\u2581"))


def test_piece_edges(spark, edge, edge_rows, empty):
    back = P.decode(P.encode(edge, ENCODER.model), ENCODER.model).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(e[0]), e[1] or "") for e in edge_rows)
    assert P.encode(empty, ENCODER.model).count() == 0
    assert P.Decoder(ENCODER.model).decode([1, 2, 999_999]) == ""


def test_piece_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.op7_sentencepiece(spark, SMALL).collect()
    assert len(rows) == len(texts) and all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in rows)


# token counts

COUNTS = T.Counts(T.read_ranks())
SIGNS = st.lists(st.sampled_from([*"ab  \n\t'srevt1.,é漢", "'re", "word "]), max_size=300).map("".join)


@settings(max_examples=300, deadline=None)
@given(SIGNS, st.lists(st.tuples(st.integers(0, 450), st.integers(0, 80), st.text(alphabet="a '\n1s", max_size=30)), max_size=6), st.integers(1, 5))
def test_edits_equal_a_full_count(text, edits, slot):
    old, T.SLOT = T.SLOT, slot
    try:
        tree = T.Tree.of(text, COUNTS)
        for start, length, insert in edits:
            start, length, insert = T.clamped({"start": start, "length": length, "insert": insert}, len(text))
            text, _ = tree.edit(text, start, length, insert, COUNTS)
            assert int(tree.tokens[1]) == len(COUNTS.encoding.encode_ordinary(text)) and int(tree.chars[1]) == len(text)
            for node in range(1, tree.leaves):
                assert tree.tokens[node] == tree.tokens[2 * node] + tree.tokens[2 * node + 1]
    finally:
        T.SLOT = old


def test_only_the_touched_region_is_counted():
    text = "some words here and there " * 5000
    tree = T.Tree.of(text, COUNTS)
    _, n = tree.edit(text, len(text) // 2, 3, "edited", COUNTS)
    assert n <= 3 * T.SLOT


def test_no_leaf_grows_beyond_its_slot():
    rng = random.Random(3)
    text = words(rng, 60_000)
    tree = T.Tree.of(text, COUNTS)
    n = len(text)
    for start, length, insert in ((n // 2, n // 10, text[n // 2 : n // 2 + n // 10].upper()), (n // 4, 0, " (see note 12)"), (n - 5, 5, ""), (7, 20_000, ""), (100, 0, words(rng, 3000))):
        text, _ = tree.edit(text, start, length, insert, COUNTS)
    for _ in range(300):
        text, again = tree.edit(text, len(text), 0, " five more words are here", COUNTS)
        assert again <= 3 * T.SLOT
    at = 0
    for size in tree.chars[tree.leaves :].tolist():
        assert len(COUNTS.pattern.findall(text[at : at + size])) <= T.SLOT
        at += size
    assert at == len(text) == tree.chars[1] and tree.tokens[1] == T.Tree.of(text, COUNTS).tokens[1] and tree.leaves <= 4 * len(COUNTS.pattern.findall(text)) // T.SLOT
    for _ in range(200):
        start = rng.randrange(len(text))
        text, again = tree.edit(text, start, rng.randint(0, 1), rng.choice(["", "x", " ", "é"]), COUNTS)
        assert again <= 3 * T.SLOT
    assert tree.tokens[1] == T.Tree.of(text, COUNTS).tokens[1]


def test_count_edges(spark, edge, edge_rows, empty):
    from pyspark.sql import functions as F

    ranks = T.read_ranks()
    edits = F.when(F.col("doc_id") != 5, T.standard_edits(F.coalesce("text", F.lit("")))).alias("edits")
    rows = T.follow(T.trees(edge.select("doc_id", "text", edits), ranks, ["edits"]), ranks).collect()
    assert len(rows) == len(edge_rows) and all(r["n_edited_tokens"] == len(COUNTS.encoding.encode_ordinary(r["edited"])) for r in rows)
    assert next(r for r in rows if r["doc_id"] == 5)["n_recounted"] == 0
    clashing = edge.select("*", edits).withColumns({c: F.lit(1) for c in ("n_tokens", "chars", "tokens", "edited")})
    assert T.follow(T.trees(clashing, ranks, clashing.columns), ranks).count() == len(edge_rows)
    assert T.trees(empty, ranks).count() == 0


def test_count_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.op9_token_counts(spark, SMALL).collect()
    assert all(r["n_tokens"] == len(COUNTS.encoding.encode_ordinary(texts[r["doc_id"]])) for r in rows) and len(rows) == len(texts)


def test_parts_bound_rows_and_bytes():
    sizes = [0, 5, common.BATCH_BYTES, 7, 3 * common.BATCH_BYTES, 1, common.BATCH_BYTES // 2, common.BATCH_BYTES // 2, 1, 1, 1, 1]
    texts = pa.array(["x" * n if n else None for n in sizes], pa.string())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), texts], names=["doc_id", "text"])
    made = list(common.parts(batch, 3))
    assert pa.Table.from_batches(made).combine_chunks() == pa.Table.from_batches([batch])
    for part in made:
        assert 1 <= part.num_rows <= 3
        assert part.num_rows == 1 or sum(len(t or "") for t in part.column(1).to_pylist()) <= common.BATCH_BYTES
    assert list(common.parts(batch.slice(0, 0), 3)) == []
