"""From raw documents to packed sequences, in stages that each read what the stage before it wrote.

Every stage but the last returns the columns of ``documents`` and works on all rows that it is given; clean documents
pass each of them unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logframe.llm.best_fit import best_fit_packing
from logframe.llm.common import table, unused, written
from logframe.llm.decontaminate import decontaminated
from logframe.llm.language_id import UNKNOWN, held_out, learn_profiles, predict_languages
from logframe.llm.near_dedup import deduplicated
from logframe.llm.secret_scan import redact

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those with no text or no letters go."""
    profiles = learn_profiles(docs.filter(~held_out(F.col("doc_id"))))
    told = (unused("lang_pred", docs), unused("score", docs))
    found = predict_languages(docs, profiles, keep=tuple(docs.columns), told=told)
    return found.filter(F.col(told[0]) != UNKNOWN).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 80 percent) the document with the smallest doc_id."""
    return deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, packed into sequences of 4096 tokens."""
    return best_fit_packing(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("pack", pack),
]

#: Language profiles and packing have no SQL; tests hold every stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
