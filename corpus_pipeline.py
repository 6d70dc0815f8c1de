"""The corpus pipeline: quality classifier, line dedup, near-duplicate documents, decontamination, BPE.

``STAGES`` names the stages in order. Each takes (spark, docs, sf_dir) and works on all rows that the
stage before it kept; all but the last return the columns of ``documents``. ``run`` writes each stage's
rows as Parquet below ``spark.checkpoint.dir`` and reads them again as the next one's documents.

Defined cases: an empty table gives an empty result. A null text has no features for the classifier, no lines, no
shingles, no passages and no tokens, and comes through as far as the classifier lets it. Rows with a null id
stay as they are in the line stage and all stay in the near-duplicate stage. Rows that repeat an id are
decided as one document by those two, and one of them stays. Of like lines or documents the one in the document of the least id
stays; copies of a text within one document tie, and its first line stays. Texts of any length are taken whole.
Columns beyond those of ``documents`` come through up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from weekcast.llm import bpe, decontamination, line_dedup, near_documents, quality
from weekcast.llm.common import dropped, table, written

_COUNTS = ("_lines_before", "_lines_dropped")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps; it is fitted on the documents at hand and ``labels``."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with one line kept of like lines, ``n_chars`` with them. A document whose every line is kept
    elsewhere goes; one that had no lines stays."""
    done = line_dedup.dedup(docs, counts=_COUNTS)
    before, gone = (F.col(c) for c in _COUNTS)
    done = done.where((before == 0) | (gone < before))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(gone > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near duplicates."""
    return near_documents.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of ``benchmark``."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and digests of every text, encoded and decoded again."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("byte_bpe", encode),
]

#: The classifier's fit, the sketches and the encoder have no SQL form; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
