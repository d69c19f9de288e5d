"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; run() writes
what a stage returns as Parquet in the shared folder and reads it again.  All but the last return the
columns of documents.  When a stage begins, the one before has been written, so the tables that this
one stored for itself go, but for those that docs reads.

Defined results, for every stage: an empty table gives an empty table; a null text counts as empty, has
no words and so is rejected by the rules; a null id comes after all others and its rows are judged one
by one; equal rows are judged alike until the similarity join, after which one of those with an id is
left; other columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.line_dedup import remove_boilerplate
from llm.ngram_join import keep_one
from llm.packing import pack_documents
from llm.phrase_automata import remove_repeated_phrases
from llm.quality import fit_quality, judge
from llm.storage import discard, stage_tables, stored

TOKENIZER = "word_bpe_49k.json"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def staged(stage: Stage) -> Stage:
    """stage, with the tables that it stores for itself kept only until the next one begins."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with stage_tables(docs):
            return stage(spark, docs, sf_dir)

    return run_stage


def _recounted(cleaned: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with n_chars of the new text."""
    return cleaned.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns))


@staged
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the trees keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = judge(docs, fit_quality(docs, labels))
    return judged.where("kept").select(*docs.columns)


@staged
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines; a document of which only such lines were left is gone."""
    cleaned = remove_boilerplate(docs).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return _recounted(cleaned, docs.columns)


@staged
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of similar ones."""
    return keep_one(docs).select(*docs.columns)


@staged
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that documents of smaller ids hold; one of which nothing is left is gone."""
    cleaned = remove_repeated_phrases(docs).where((F.col("n_removed") == 0) | (F.col("text") != ""))
    return _recounted(cleaned, docs.columns)


@staged
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: The trees, the similarity join, the passages and the tokenizer are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        written.append(stored(stage(spark, docs, sf_dir), f"stage-{name}"))
        docs = written[-1]
        discard(*written[-2:-1])
    return STAGES[-1][1](spark, docs, sf_dir)
