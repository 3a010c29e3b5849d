"""A corpus pipeline of five stages over documents; part of the corpus subpackage.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but
the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, jaccard_join, language, pieces, suffix_dedup
from ledgerloom.llm.common import fold, materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents whose language can't be determined; a missing lang becomes the predicted one.

    Without any labelled row to learn from all rows stay as they are.
    """
    model = language.train(docs.filter(fold(F.col("doc_id"), 4) != 2).select("text", "lang"))
    if not model.languages:
        return docs.select(*COLUMNS)
    found = docs.select(*COLUMNS).withColumn("_found", language.identify(docs, model))
    kept = found.filter(F.col("_found.lang") != language.UNDETERMINED)
    return kept.withColumn("lang", F.coalesce("lang", "_found.lang")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of each group of near copies: the one with the smallest id (none: the largest), then text hash.

    Rows alike in id and text are one document; different texts that share an id, or have none, are told apart.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("_id")
    found = jaccard_join.link_components(docs, rows=True).select(key, F.col("text_key").alias("_text"), "component")
    linked = found.filter("component is not null").groupBy("component").agg(F.min(F.struct("_id", "_text")).alias("first")).select("first.*")
    keep = linked.unionByName(found.filter("component is null").select("_id", "_text").distinct())
    rows = docs.select(*COLUMNS, key, F.xxhash64("text").alias("_text"))
    return rows.join(keep, ["_id", "_text"], "left_semi").dropDuplicates(["_id", "_text"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 100 bytes or more that start earlier; documents of which nothing is left go.  A null text becomes empty."""
    cut = suffix_dedup.remove_repeats(docs, whole_characters=True, carry=("lang", "source", "n_chars"))
    left = cut.withColumn("text", F.decode("kept", "UTF-8")).filter((F.col("n_removed") == 0) | (F.trim("text") != ""))
    size = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.select("doc_id", "text", "lang", "source", size.alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=tuple(COLUMNS))
    return found.filter("not contaminated").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the texts that are left, and decode them: doc_id, lang, source, n_tokens, ids, decoded."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.encode(docs, path, keep=("doc_id", "lang", "source"), decoded=True)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]

#: DuckDB can express none of language inference, byte-level dedup and piece encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a table in the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
