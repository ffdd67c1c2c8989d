"""Stages that turn the documents table into tokens for training.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``:

1. ``toxicity`` drops the documents that the classifier, trained on the labels of those given, rejects;
2. ``line_dedup`` takes repeated lines out of the texts (a text of repeats alone becomes empty);
3. ``near_dedup`` keeps one row of each class of near-duplicates;
4. ``decontaminate`` drops documents that hold a benchmark passage;
5. ``sentencepiece`` encodes what is left, with its round trip checked.

SQL can't express the classifier or the encoding; the pipeline is tested against brute-force twins of its
stages, on rows with null and repeated ids, on empty tables and with further columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobscope.llm import decontaminate as benchmark_overlaps
from jobscope.llm import line_dedup as repeated_lines
from jobscope.llm import order_minhash, pieces
from jobscope.llm import toxicity as classifier
from jobscope.llm.common import table
from jobscope.llm.queries import tokenizer_path
from jobscope.store import new_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classifier.keep_clean(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeated_lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return benchmark_overlaps.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.tokenized(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("sentencepiece", sentencepiece),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
