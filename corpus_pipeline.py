"""The corpus pipeline: documents that read well, without repeated lines and near copies, packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kymo.llm import line_dedup, packing, quality_classifier, quality_rules, simhash
from kymo.llm.common import table, workers_import, written
from kymo.llm.queries import word_tokenizer


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the labels of the documents it gets.

    Null and empty texts are scored by their statistics; repeated rows and null ids are judged each for itself; without
    labels all documents score alike and stay. An empty table gives an empty result."""
    workers_import(spark)
    return quality_classifier.keep_good(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Null and empty texts have no words and go; every row is judged for itself,
    whatever its id. An empty table gives an empty result."""
    return quality_rules.keep_good(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar lines one line stays; ``n_chars`` follows the text. A document goes only when all its
    lines stand elsewhere."""
    workers_import(spark)
    return line_dedup.drop_lines(docs, count_col="n_chars", keep_emptied=False)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays. Rows with a null id stay; rows that share an
    id are told apart by their text; null and empty texts are near copies of each other. An empty table gives an empty
    result."""
    workers_import(spark)
    return simhash.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens, one row per piece. A null or empty text is one piece of
    its end alone; repeated rows and null ids stay; an empty table gives an empty result.

    The workers hold what earlier stages left as well, so they remember fewer words here than ``pack`` does by itself."""
    workers_import(spark)
    return packing.pack(docs, word_tokenizer(), with_ids=False, memory=200_000)


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("best_fit_packing", pack),
]

#: Signatures, merges and packing aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
