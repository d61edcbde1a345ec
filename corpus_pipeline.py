"""Corpus pipeline: language ID, line dedup, near duplicates, decontamination, packing.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next stage's documents. Columns beside those of
documents pass through all stages but the last, under any name. Rows that repeat are judged alike, each for itself,
but for near duplicates, of which rows that share the least id all stay.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shuttleplan.functions.scratch import temporary
from shuttleplan.llm import decontaminate, language, neardup, packing, templates


#: the columns that stages work on
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(stage: Callable) -> Callable:
    """The stage on the columns of documents; others, whatever their names, travel in one struct and come back unchanged."""

    @wraps(stage)
    def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rest = [c for c in docs.columns if c not in COLUMNS]
        if not rest:
            return stage(spark, docs, sf_dir)
        packed = docs.select(*[c for c in docs.columns if c in COLUMNS], F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)]).alias("carried_columns"))
        return stage(spark, packed, sf_dir).select(*[F.col(f"carried_columns.c{rest.index(c)}").alias(c) if c in rest else F.col(c) for c in docs.columns])

    return apart


@_apart
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence; lang becomes the predicted one. Null text and text without a letter go."""
    named = language.predict_languages(docs, language.fit_languages(docs), keep=[*docs.columns])
    return named.where("not rejected").withColumn("lang", F.col("lang_pred")).select(*docs.columns)


@_apart
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; those of which no word is left go, n_chars follows the text."""
    cut = templates.drop_templates(docs)
    left = cut.where(F.col("text").isNotNull() & ((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


@_apart
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of every group of near duplicates (five words, 0.8 or more); those without an id stay."""
    found = neardup.near_duplicates(docs, 5, 4, 5).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


@_apart
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items do not contaminate; null text and ids stay, rows that repeat are judged alike."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_contamination(docs, items, keep=[*docs.columns]).withColumn("n_hit", decontaminate.n_hit())
    return found.where(~decontaminate.contaminated()).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place; null text is an empty document, repeated rows and ids are packed as often."""
    return packing.pack_documents(docs, packing.vocabulary_path())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("decontamination", decontamination), ("best_fit_packing", best_fit_packing)]

#: SQL expresses neither the trained model nor the packing
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; what a stage writes for itself goes once its documents are stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with temporary(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
