"""Quality by compression: zstandard dictionaries of good and bad text, and a calibrated score of the size difference.

Each text is compressed whole with either dictionary. The difference of the sizes, divided by the larger, says which
dictionary knows the text better; with the compressed size per byte (which tells repetition) and the length it goes
through a logistic curve fitted on labelled texts that neither dictionary was built from.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import held_out, keep_where, map_batches


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries and the logistic curve; without both labels in the training rows, every score is 0.5."""

    good: bytes = b""
    bad: bytes = b""
    level: int = 3
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = field(default=())

    def scorer(self):
        """A function of bytes; one compressor per dictionary is kept."""
        if not self.weights:
            return lambda raw: 0.5
        sizes = _sizer(self.good, self.bad, self.level)
        mean, scale, weights = (np.array(x) for x in (self.mean, self.scale, self.weights))
        return lambda raw: float(1 / (1 + math.exp(-float(np.clip(((_features(sizes, raw) - mean) / scale) @ weights, -30, 30)))))


def _sizer(good: bytes, bad: bytes, level: int):
    made = []
    for raw in (good, bad):
        known = zstandard.ZstdCompressionDict(raw)
        known.precompute_compress(level=level)
        made.append(zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False))
    return lambda raw: (len(made[0].compress(raw)), len(made[1].compress(raw)))


def _features(sizes, raw: bytes) -> np.ndarray:
    by_good, by_bad = sizes(raw)
    length = len(raw) + 1
    difference = (by_bad - by_good) / max(by_good, by_bad, 1)
    return np.array([1.0, difference, math.log(max(by_good, 1) / length), difference * math.log(length), math.log(length) / 10])


def _dictionary(texts: list[bytes], size: int, level: int) -> bytes:
    """A trained dictionary, or the texts themselves where there are too few to train one."""
    try:
        return zstandard.train_dictionary(size, texts, level=level).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-size:].ljust(8, b" ")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    mean[0], scale[0] = 0.0, 1.0
    z, w = (x - mean) / scale, np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) / len(y) + ridge * w
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w)), slope)
    return mean, scale, w


def sample(docs: DataFrame, labels: DataFrame, per_label: int, longest: int, seed: int) -> list[tuple[bytes, int]]:
    """At most per_label whole training texts of each label, of at most `longest` characters, in an order drawn by seed.

    Only ids and lengths are shuffled; the texts come from one more scan against the chosen ids (2 x per_label at most). An id gives
    one text, drawn by a hash, however many rows it has.
    """
    marks = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_label")).filter("_id is not null and _label in (0, 1)").distinct()
    sized = docs.filter(F.col("text").isNotNull() & (F.length("text") <= longest) & ~held_out()).select("doc_id")
    known = marks.join(sized, F.col("_id") == F.col("doc_id"), "left_semi").withColumn("_draw", F.xxhash64("_id", F.lit(seed)))
    chosen = [r for label in (0, 1) for r in known.filter(F.col("_label") == label).orderBy("_draw", "_id").limit(per_label).collect()]
    if not chosen:
        return []
    ids = F.broadcast(docs.sparkSession.createDataFrame([(r["_id"], r["_label"], r["_draw"]) for r in chosen], "_id long, _label int, _draw long"))
    rows = docs.filter(F.col("text").isNotNull() & (F.length("text") <= longest)).select("doc_id", "text").join(ids, F.col("_id") == F.col("doc_id"))
    one = F.min_by("text", F.struct(F.xxhash64("text", F.lit(seed)), "text")).alias("text")
    rows = rows.groupBy("_draw", "_id", "_label").agg(one).orderBy("_draw", "_id", "text").collect()
    return [(r["text"].encode("utf-8"), r["_label"]) for r in rows]


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 3000, longest: int = 20_000, dictionary: int = 300_000, level: int = 3, seed: int = 7) -> QualityModel:
    """Learns from labels.quality of rows that aren't held out: a bounded sample, per_label texts of either label.

    Every other text of the sample builds a dictionary, the rest fit the curve. Null labels, ids and texts are left out;
    without texts of both labels the model scores 0.5.
    """
    rows = sample(docs, labels, per_label, longest, seed)
    of = {k: [t for t, label in rows if label == k] for k in (0, 1)}
    if not of[0] or not of[1]:
        return QualityModel()
    good, bad = (_dictionary(of[k][::2], dictionary, level) for k in (1, 0))
    rest = {k: of[k][1::2] or of[k] for k in (0, 1)}
    sizes = _sizer(good, bad, level)
    x = np.array([_features(sizes, t) for k in (1, 0) for t in rest[k]])
    y = np.array([float(k) for k in (1, 0) for _ in rest[k]])
    share = _share(docs, labels)
    mean, scale, w = _logistic(x, y)
    drawn = len(rest[1]) / len(y)
    w[0] += math.log(share / (1 - share)) - math.log(drawn / (1 - drawn))
    return QualityModel(good, bad, level, tuple(mean), tuple(scale), tuple(w))


def _share(docs: DataFrame, labels: DataFrame) -> float:
    """The share of label 1 among all training labels: the sample has as many of either, the curve is moved back to it."""
    marks = labels.filter(~held_out() & F.col("quality").isin(0, 1)).agg(F.avg(F.col("quality").cast("double")).alias("share")).collect()
    return min(0.999, max(0.001, marks[0]["share"] or 0.5))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null texts score as empty ones, repeated rows alike. Texts are read whole,
    however long; other columns of docs are ignored, whatever their names; an empty table gives an empty one."""

    def start():
        score_of = model.scorer()

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = [score_of((t or "").encode("utf-8")) for t in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

        return apply

    return map_batches(docs.select("doc_id", held_out().alias("held_out"), "text"), start, "doc_id long, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of docs with a score of 0.5 or more, all columns as they are."""

    def start():
        score_of = model.scorer()
        return lambda texts: [score_of((t or "").encode("utf-8")) >= 0.5 for t in texts]

    return keep_where(docs, start)
