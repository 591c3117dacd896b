"""Language identification: nearest of several centroids per language over TF-IDF vectors of character n-grams.

A text becomes hashed counts of its letter 1- to 3-grams (lower case, every run of other characters one space), damped,
weighted by the inverse document frequency over all training rows and brought to length 1. Each language's sampled
vectors are clustered on the sphere; a text gets the language of the centroid with the largest cosine. Short texts are far
from any centroid, so each language learns how near its texts come at every size (distinct n-gram buckets), from whole
training texts and from windows of them. A text is rejected where its cosine is below `slack` times the low quantile of its
language's texts of its size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewright.llm.common import held_out, keep_where, map_batches, small_arrow

UNKNOWN = "und"
WIDTH = 8192  # hashed n-gram buckets
SPACE = 32
SIZES = 2 ** np.arange(13)  # distinct buckets for which bounds are learned; between them the bound is interpolated
WINDOWS = 2 ** np.arange(2, 13)  # characters


@dataclass(frozen=True)
class LanguageModel:
    """Learned languages, IDF weights, unit centroids (row per centroid), the language of each; row per language: least cosines by SIZES."""

    languages: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray
    language_of: np.ndarray
    least: np.ndarray


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _grams(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document number and bucket of every 1-, 2- and 3-gram of the texts."""
    codes = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "replace"), np.uint32) for t in texts]
    of = np.repeat(np.arange(len(texts), dtype=np.int32), [len(c) for c in codes])
    c = np.concatenate(codes)
    is_letter = letters[c]
    c = np.where(is_letter, c, SPACE)
    keep = np.ones(len(c), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1] | (of[1:] != of[:-1])
    c, of = c[keep].astype(np.uint64), of[keep]
    two = c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:]
    three = two[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[2:]
    parts = ((c[c != SPACE], of[c != SPACE], 1), (two, of[1:], 2), (three, of[2:], 3))
    same = (None, of[1:] == of[:-1], of[2:] == of[:-2])
    buckets, owners = [], []
    for (h, d, n), ok in zip(parts, same, strict=True):
        if ok is not None:
            h, d = h[ok], d[ok]
        h = (h + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
        buckets.append((h >> np.uint64(51)).astype(np.int64))
        owners.append(d)
    return np.concatenate(owners), np.concatenate(buckets)


def _counts(texts: list[str], letters: np.ndarray) -> np.ndarray:
    of, bucket = _grams(texts, letters)
    return np.bincount(of.astype(np.int64) * WIDTH + bucket, minlength=len(texts) * WIDTH).reshape(len(texts), WIDTH)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def _sized(texts: list[str], letters: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and sizes."""
    counts = _counts(texts, letters)
    return _unit(np.log1p(counts).astype(np.float32) * idf), np.count_nonzero(counts, axis=1)


def _groups(texts: list[str | None], chars: int = 400_000, most: int = 64):
    """Runs of positions with about `chars` characters: bounds the memory of a dense count matrix."""
    run, size = [], 0
    for i, t in enumerate(texts):
        run.append(i)
        size += len(t or "")
        if size >= chars or len(run) >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """In how many rows each bucket occurs: each task adds up its rows, Spark adds up the tasks; WIDTH sums reach the driver."""

    def run(batches):
        letters, total, n = _letters(), np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for group in _groups(texts):
                total += (_counts([texts[i] for i in group], letters) > 0).sum(axis=0)
                n += len(group)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDTH + 1), pa.int32()), pa.array(np.append(total, n), pa.int64())], names=["bucket", "n"])

    small_arrow(docs.sparkSession)
    out = np.zeros(WIDTH + 1, np.int64)
    for r in docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def _clusters(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced rows; empty clusters are dropped."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = np.stack([_unit(x[near == j].sum(axis=0, keepdims=True))[0] for j in range(len(c)) if (near == j).any()])
    return c


def _windows(texts: list[str]) -> list[str]:
    """The texts, and of each a window of every width that is shorter, from places spread over the texts; where a word starts
    inside the window, from there."""
    out = list(texts)
    for i, t in enumerate(texts):
        for j, width in enumerate(w for w in WINDOWS if w < len(t)):
            at = (i * 7919 + j * 104729) % (len(t) - width + 1)
            blank = t.find(" ", at, at + width)
            at = blank + 1 if at and blank >= 0 else at
            out.append(t[at : at + width])
    return out


def _bounds(sizes: np.ndarray, cosines: np.ndarray, quantile: float) -> np.ndarray:
    """The quantile of cosines near each of SIZES, never falling with the size; where none is near, that of the size before."""
    out, near = np.zeros(len(SIZES)), np.rint(np.log2(np.maximum(sizes, 1)))
    for j in range(len(SIZES)):
        if (near == j).any():
            out[j] = np.quantile(cosines[near == j], quantile)
    return np.maximum.accumulate(out)


def fit(docs: DataFrame, per_language: int = 500, longest: int = 20_000, clusters: int = 4, slack: float = 0.6, quantile: float = 0.01, most_languages: int = 1000, seed: int = 11) -> LanguageModel:
    """Learns from rows with a text and a lang that aren't held out.

    IDF counts all of them. Centroids come from about per_language whole texts a language (of at most `longest` characters,
    drawn by a hash of id and text; twice as many at most, the bound of what reaches the driver); more than most_languages raises
    ValueError. A row that repeats id and text counts once, so it can't push out its own or another language. Rows with null
    lang, null text or no letter teach nothing.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    sized = F.length("text") <= longest
    found = rows.groupBy("lang").agg(F.approx_count_distinct(F.when(sized, F.xxhash64("doc_id", "text")), 0.02).alias("n")).limit(most_languages + 1).collect()
    if len(found) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    frequency = document_frequencies(rows)
    idf = (np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1).astype(np.float32)
    share = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], min(1.0, per_language / max(1, r["n"])))]) if found else F.lit(None)
    texts: dict[str, list[str]] = {}
    if found:
        draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        drawn = rows.filter(sized & (draw < share[F.col("lang")])).dropDuplicates(["lang", "doc_id", "text"])
        nth = F.row_number().over(Window.partitionBy("lang").orderBy(draw, "doc_id", "text"))
        for r in drawn.withColumn("_nth", nth).filter(F.col("_nth") <= 2 * per_language).orderBy("lang", "doc_id", "text").collect():
            texts.setdefault(r["lang"], []).append(r["text"])
    letters, languages, centroids, language_of, least = _letters(), [], [], [], []
    for lang in sorted(texts):
        x = np.concatenate([_sized([texts[lang][i] for i in g], letters, idf)[0] for g in _groups(texts[lang])])
        x = x[(x * x).sum(axis=1) > 0.5]
        if not len(x):
            continue
        own = _clusters(x, clusters)
        centroids.append(own)
        language_of += [len(languages)] * len(own)
        pieces = _windows(texts[lang])
        seen = [((v @ own.T).max(axis=1), n) for v, n in (_sized([pieces[i] for i in g], letters, idf) for g in _groups(pieces))]
        cosines, sizes = (np.concatenate(c) for c in zip(*seen, strict=True))
        least.append(slack * _bounds(sizes[sizes > 0], cosines[sizes > 0], quantile))
        languages.append(lang)
    stacked = np.concatenate(centroids).astype(np.float32) if centroids else np.zeros((0, WIDTH), np.float32)
    return LanguageModel(tuple(languages), idf, stacked, np.array(language_of, np.int64), np.array(least, np.float32).reshape(-1, len(SIZES)))


def judge(m: LanguageModel, letters: np.ndarray, texts: list[str | None]) -> list[tuple[str, float, bool]]:
    """Language, cosine and rejection of each text."""
    out = [(UNKNOWN, 0.0, True)] * len(texts)
    spoken = [i for i, t in enumerate(texts) if t and m.languages and any(map(str.isalpha, t))]
    for group in _groups([texts[i] for i in spoken]):
        at = [spoken[i] for i in group]
        vectors, sizes = _sized([texts[i] for i in at], letters, m.idf)
        cosine = vectors @ m.centroids.T
        best = cosine.argmax(axis=1)
        for i, b, s, n in zip(at, best, cosine[np.arange(len(at)), best], np.log2(sizes), strict=True):
            language = m.language_of[b]
            out[i] = m.languages[language], min(1.0, max(0.0, float(s))), bool(s < np.interp(n, np.arange(len(SIZES)), m.least[language]))
    return out


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine to the nearest centroid), rejected, for every row.

    A text that is null or has no letter is 'und' with score 0 and rejected, as is every text where no language was
    learned. lang_pred stays the nearest language where the distance rejects; of equally near ones the first in code point
    order. Long texts are read whole; repeated rows get the same result; other columns of docs are ignored; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m, letters = sent.value, _letters()

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = list(zip(*judge(m, letters, batch.column(2).to_pylist()), strict=True)) or [(), (), ()]
            made = [pa.array(x, t) for x, t in zip(found, (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

        return apply

    return map_batches(docs.select("doc_id", held_out().alias("held_out"), "text"), start, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean", 256)


def kept(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of docs that aren't rejected, all columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m, letters = sent.value, _letters()
        return lambda texts: [not rejected for _, _, rejected in judge(m, letters, texts)]

    return keep_where(docs, start, 256)
