"""The corpus pipeline: quality rules, quality classifier, near-duplicates, repeated passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vellum.llm import packing, quality_classifier, quality_rules, simhash, substring_dedup
from vellum.llm.common import narrow, ready, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    return quality_rules.keep_good(narrow(docs, *COLUMNS))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, learned from the labels of the whole corpus, takes for bad."""
    model = quality_classifier.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_classifier.keep_good(narrow(docs, *COLUMNS), model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of similar ones."""
    return simhash.keep_one(ready(narrow(docs, *COLUMNS)))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out of each text what repeats anywhere."""
    return substring_dedup.dedup_text(ready(narrow(docs, *COLUMNS)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences."""
    return packing.pack(ready(narrow(docs, *COLUMNS)), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("simhash_near_dedup", near_duplicates), ("suffix_array_dedup", repeated_passages), ("best_fit_packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Classifier, fingerprints and tokens can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None
