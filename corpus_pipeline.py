"""Corpus pipeline: toxicity, quality rules, near-duplicate join, passage dedup, packing.

Every stage works on all documents that its predecessor kept.  All but the last return
the columns of ``documents``; the last returns the packed pieces.

Defined cases: a null text counts as empty; toxicity and the cut keep an empty text, the
quality rules drop it; of repeated rows one stays, of rows without an id all; documents
of the same id are judged each by its own text; extra columns keep their names and values,
also where an operator has a column of that name; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raremetrics.llm import common, jaccard, packing, quality_rules, suffixes, toxicity

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of the shortest passage that may occur once only.
PASSAGE_WORDS = 51


def carries_columns(stage: Callable) -> Callable:
    """``stage`` on the columns it reads, whatever other columns are called: those keep name and value."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        safe = [c if c in DOCUMENT else f"carried_column_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*safe), sf_dir).toDF(*docs.columns)

    return run


@carries_columns
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted label is toxic go; labels of one fold stay unused, as in the query."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, common.id_remainder("doc_id", 4) != 2)
    return toxicity.toxicity(docs, model, text=True).filter("predicted = 0").select(*docs.columns)


@carries_columns
def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the thresholds of their language and source go."""
    return quality_rules.filtered(docs)


@carries_columns
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links connect, the one with the smallest id stays.

    Repeated rows become one; a row without an id cannot be chosen by it and stays.
    """
    classes = jaccard.jaccard_classes(docs.select("doc_id", "text"))
    (name,) = common.fresh(docs.columns, "chosen_id")
    first = classes.filter("doc_id = class_id").select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(first, docs.doc_id == F.col(name), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.filter("doc_id IS NULL")).select(*docs.columns)


@carries_columns
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of more than 50 words that occur twice are cut from all texts; n_chars follows."""
    cut = suffixes.remove_repeated_words(docs, PASSAGE_WORDS)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast("long"))
    return cut.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining texts with their sequence and place."""
    return packing.packed(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack),
]

#: Trained scores, hashes and token ids are not SQL.  The tests compare single operators with
#: brute force; of the chained stages they check columns, counts, ids, labelled good texts and packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
