from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, value string, node long, block int, _id long, shard int"


def words(rng: random.Random, n: int, alphabet: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


def row(doc_id, text, lang="en", source="s1"):
    """A document with extra columns whose names operators use themselves."""
    return (doc_id, text, lang, source, len(text or ""), 0.25, "v", 7, 3, 99, 1)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty, blank, sign-only, very long and repeated texts, texts without spaces, of other scripts, and a null id."""
    rng = random.Random(4)
    copy = words(rng, 40)
    return [
        row(0, words(rng, 60)), row(1, None), row(2, ""), row(3, " \t\n"), row(4, "!!! ??? ..."), row(5, copy), row(6, copy, source=None), row(7, copy.replace("a", "b", 1)),
        row(8, words(rng, 30_000)), row(9, "x" * 5000), row(10, "漢字かな交じり文の長い文章です。" * 9, lang=None), row(11, "Ελληνικά κείμενο 𝔘𝔫𝔦"), row(12, "one"), row(13, "one"),
        row(14, "a▁b ▁ c d\r\nline"), row(20, words(rng, 12), source="s2"), row(20, words(rng, 12), source="s2"), row(21, words(rng, 9), source=None), row(21, copy), row(21, copy),
        row(None, "a row without an id " * 3), row(None, None, None, None),
    ]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


SMALL = "/root/testdata/sf0.001"
