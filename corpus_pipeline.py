"""A corpus pipeline: language ID, quality, near-duplicate removal, substring dedup, packing.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and returns a DataFrame; all
but the last return the columns of ``documents``.  Languages are learnt from the rows a stage is
given, quality from those rows and the ``labels`` table of ``sf_dir``.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom import importable
from motifloom.llm._shared import shared_dir
from motifloom.llm.jaccard_join import jaccard_components
from motifloom.llm.langid import identify_language, learn_languages
from motifloom.llm.packing import pack_documents
from motifloom.llm.quality import learn_ranker, score_quality
from motifloom.llm.substring_dedup import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _stage(f):
    """A stage that also runs where the session was started elsewhere."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        importable(spark)
        return f(spark, docs, sf_dir)

    return run


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected: texts without a letter, and those whose language margin is too narrow."""
    languages = learn_languages(docs, F.lit(True))
    return identify_language(docs, languages).filter(~F.col("lang_rejected")).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected: scores under the threshold learnt from the labels of the documents given."""
    ranker = learn_ranker(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return score_quality(docs, ranker).filter("quality_pred = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest id stays.

    Rows are told apart by their id alone: rows that repeat a kept id stay with it, and rows
    without an id stay if any of them is linked to no id.
    """
    groups = jaccard_components(docs, size=5, percent=80)
    kept = groups.filter("component_id is null or doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 20 that also start earlier go; texts are their kept words joined by one
    space.  A document that keeps no word stays, with an empty text."""
    cut = substring_dedup(docs.select(*COLUMNS), window=20)
    return cut.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, packed into sequences of 2048 tokens."""
    out = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", _stage(language_id)),
    ("quality_classifier", _stage(quality_classifier)),
    ("near_duplicates", _stage(near_duplicates)),
    ("repeated_passages", _stage(repeated_passages)),
    ("packing", _stage(packing)),
]

#: Compression, learnt scores and tokenisation have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
