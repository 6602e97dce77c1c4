"""Corpus pipeline: five stages from raw documents to encoded, clean ones.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
its result is written as Parquet and read again as the next one's ``docs``.  All but
the last return the columns of ``documents``, and columns of the user's own, whatever
their names, unchanged.

Defined results for every stage: a null text counts as empty and stays null; null
doc_ids, langs and sources pass; whole texts are read, however long; repeated rows and
ties get equal decisions (one of near_dedup's equal rows stays as that stage says); an
empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tileweave.llm import bpe, decontaminate, linededup, neardup, quality
from tileweave.llm.common import dealt, drop_newer, dropped, staged, staged_now, table, unused

RANKS = "byte_bpe_50k.tiktoken"
#: Documents that score lower are rejected.
QUALITY_THRESHOLD = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; labels teach it, and are no input of a score.

    Null and empty texts have the score of the bias alone; without labelled rows every score is 0.5 and all stay.
    """
    weights = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "score")
    return quality.with_quality(docs, weights, to=score).where(F.col(score) >= QUALITY_THRESHOLD).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, freed of runs of lines that stand earlier; n_chars follows the text.

    Null texts stay null, and a text that loses all its lines becomes empty.  Rows with the same
    doc_id and text are one document; a null doc_id comes first.
    """
    lines, removed = unused(docs, "n_lines"), unused(docs, "n_removed")
    kept = linededup.without_repeated_chunks(docs, lines_to=lines, removed_to=removed)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one of least doc_id.

    Texts without words (null ones are empty) are like equal texts only, so one of them stays; rows that
    repeat the kept document (doc_id and text) stay with it.
    """
    return neardup.without_near_copies(docs).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, told by their texts alone; null and empty texts leak nothing."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of every kept text, and the digest of what they decode to; null counts as empty."""
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return bpe.with_token_digest(docs.select("doc_id", "lang", "source", "text"), path, pattern).drop("text")


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("encode", encode),
]

#: A trained model, similarity classes and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        before, last = staged_now(spark), docs
        docs = staged(stage(spark, docs, sf_dir), name)
        drop_newer(spark, before, docs)  # what the stage staged for itself
        dropped(last)
    return STAGES[-1][1](spark, docs, sf_dir)
