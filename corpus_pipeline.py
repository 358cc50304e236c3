"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (session, documents, folder of the tables); its
result is written as Parquet and is the next one's input. All but the last
return the columns of ``documents``, with ``n_chars`` brought up to date.

A stage begins by dropping the intermediate tables of the other stages, which
nothing reads once their results are written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drayage.llm.line_dedup import dedup_lines
from drayage.llm.ngram_join import similar_documents
from drayage.llm.packing import pack
from drayage.llm.passages import all_spans, identified, without_spans
from drayage.llm.quality_rules import keep_good, learn_rules
from drayage.llm.texts import small_batches
from drayage.operators.keys import surrogate_key
from drayage.plans.registry import Tables
from drayage.session import drop_scratch, materialise, scratch_scope, tune

TOKENIZER = "word_bpe_49k.json"
SEQUENCE = 2048

# The rules are learned, and so no SQL gives these rows.
ORACLE_SQL = None


def ready(spark: SparkSession) -> SparkSession:
    return small_batches(tune(spark))


def recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base checks and the rules learned from ``labels``."""
    return keep_good(docs, learn_rules(docs, Tables(ready(spark), sf_dir).labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them hold."""
    ready(spark)
    return recounted(dedup_lines(docs, min_docs=10, min_length=1).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the one with the smallest id.

    Rows that repeat id and text are one document, rows with one id and different
    texts are several: of those the one whose text has the smaller hash comes
    first. Documents without an id come after all others.
    """
    ready(spark)
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        found = similar_documents(docs, width=5, percent=75)
        gone = found.where("doc_id <> component_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # Ids that tell rows apart are made only where the given ones do not: that shuffles texts.
    a, b, row = "__doc_a", "__doc_b", "__doc_row"
    known = identified(docs, "doc_id", "text", a, b)
    order = [F.col("doc_id").asc_nulls_last(), a, b]
    rows = materialise(surrogate_key(known.select("doc_id", a, b).distinct(), order, row), "rows").select(a, b, row)
    named = materialise(known.join(rows, [a, b]).dropDuplicates([row]).drop(a, b), "named")
    found = similar_documents(named.select(row, "text"), key=row, width=5, percent=75)
    gone = found.where(F.col(row) != F.col("component_id")).select(row)
    return named.join(gone, row, "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that stand in an earlier one."""
    ready(spark)
    return recounted(without_spans(docs, all_spans(docs)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its sequence and place."""
    ready(spark)
    return pack(docs, public_tokenizers.path(TOKENIZER), capacity=SEQUENCE, end_id=0)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
SCOPE = "pipeline"


def tidy(name: str, stage: Stage, last: bool) -> Stage:
    """The stage, with its intermediate tables in a folder that the next stage drops; those of the last one stay."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_scratch(spark, SCOPE)
        with scratch_scope("" if last else f"{SCOPE}/{name.replace(' ', '_')}"):
            return stage(spark, docs, sf_dir)

    return run


STAGES = [
    (name, tidy(name, stage, stage is best_fit_packing))
    for name, stage in [
        ("quality rules", quality_rules),
        ("line dedup", line_dedup),
        ("n-gram Jaccard join", near_duplicates),
        ("substring dedup", substring_dedup),
        ("best-fit packing", best_fit_packing),
    ]
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = Tables(ready(spark), sf_dir).documents, None
    for _, stage in STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        with scratch_scope(output := f"{SCOPE}-output-{uuid.uuid4().hex}"):
            docs = materialise(found, "documents")
        if before:  # nothing reads it any more
            drop_scratch(spark, before)
        before = output
    return STAGES[-1][1](spark, docs, sf_dir)
