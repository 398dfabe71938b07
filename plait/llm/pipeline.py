"""A training-data pipeline over the table documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of docs. run() writes each stage's result to the shared
folder as Parquet and reads it back for the next, so a lost executor costs the
current stage's lost tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plait.llm import decontaminate, jaccard_join, language_id, line_dedup, piece_sampler
from plait.llm.common import fold, fresh, materialize, table

#: A document goes if less than this share of its letters is in its best language.
LEAST_LANGUAGE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4. Documents without a language (null text, no letter) or of no
    clear one go; a null lang is filled with the one found."""
    model = language_id.train(docs.filter(fold(F.col("doc_id"), 3) != 1))
    name = fresh(docs, "__l")
    got = docs.withColumn(name, language_id.language_of(model, spark)("text"))
    kept = got.filter((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= LEAST_LANGUAGE))
    return kept.withColumn("lang", F.coalesce("lang", f"{name}.lang_pred")).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8. Later copies of repeated runs of lines go from the texts;
    n_chars follows; a document that loses all its lines goes."""
    got = line_dedup.dedup_lines(docs)
    kept = got.filter((F.col("__n_removed") == 0) | (F.col("__n_removed") < F.col("__n_lines")))
    return kept.withColumn("n_chars", F.when(F.col("__n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2. Of each group of linked documents the row of the least doc_id
    stays (of the least text hash among those). Documents without a word link
    with nothing and stay; rows of one doc_id and text are one document, of
    which one row stays; rows without a doc_id are kept as they are and not
    compared."""
    named = docs.filter("doc_id is not null")
    groups = jaccard_join.jaccard_join(named)
    best = groups.groupBy("root", F.when(F.col("root").isNull(), F.struct("doc_id", "text_hash")).alias("alone"))
    best = best.agg(F.min(F.struct("doc_id", "text_hash")).alias("b")).select(F.col("b.doc_id").alias("doc_id"), F.col("b.text_hash").alias("text_hash"))
    kept = materialize(best, "kept").withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    text_hash = F.xxhash64(F.col("text").cast("string"))
    first = named.join(kept, (F.col("doc_id") == F.col("__id")) & (text_hash == F.col("__hash")), "left_semi")
    once = Window.partitionBy("doc_id", text_hash).orderBy(F.xxhash64(*docs.columns))
    row = fresh(docs, "__r")
    first = first.withColumn(row, F.row_number().over(once)).filter(F.col(row) == 1)
    return first.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6. Documents that hold a test item, or a half of one, go. A null
    or empty text holds none and stays, and so do all if there are no items;
    repeated rows each stay or go alike."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1. Two sampled segmentations of each document, with their ids: a
    null text has no rows, an empty one a row without pieces, one that can be
    cut in one way alone one row; repeated rows each have theirs."""
    return piece_sampler.encode(docs, k=2)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", duplicate_stage),
    ("decontaminate", leak_stage),
    ("piece_sampler", encode_stage),
]

#: No stage but the second is within SQL's reach; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
