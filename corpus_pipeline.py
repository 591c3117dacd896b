"""A corpus pipeline: language, quality, near-duplicates, source mix, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs, extra ones
included, whatever their names. An empty table stays empty. Null and empty texts have no language, so the first stage rejects
them; given to a later one, they are judged as empty texts, have no duplicates, are in no mix and get no ids. Rows that repeat id
and text stay until the near-duplicates, where one stays. Texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.llm import langid, minhash, mixing, pieces, quality
from lanewright.llm.common import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised (operator 8)."""
    return langid.kept(docs, langid.fit(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores 0.5 or more (operator 3)."""
    return quality.kept(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (operator 6)."""
    return minhash.kept_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix of sources takes a document (operator 2); some documents not at all, some twice. The one
    document a source that its quota cuts is kept up to there."""
    return mixing.mixed(docs, mixing.mix(docs))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_ids of every row (operator 7)."""
    return pieces.encode(docs, pieces.load()).withColumn("n_ids", F.size("ids").cast("long"))


STAGES = [("language", language), ("quality", good_quality), ("near_duplicates", near_duplicates), ("source_mix", source_mix), ("sentencepiece", sentencepiece)]

#: The stages' models, signatures and draws can't be said in SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
