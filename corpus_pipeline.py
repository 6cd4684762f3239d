"""Corpus pipeline: five stages, each a table that the next one reads.

Language identification drops documents in no language. Of each group of near copies (five
words, Jaccard 0.8) the document of smallest id stays. Passages of 35 words that repeat are
cut. Documents that cover a benchmark item go. What is left is encoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callglass.llm import jaccard_trie, languages, pieces, repeats, tiling
from callglass.llm.components import stored
from callglass.session import configure

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Bytes of a row group of the texts between stages: a writer holds one of them.
ROW_GROUP = 16 << 20


def small_groups(docs: DataFrame) -> DataFrame:
    """What the session writes from here on has small row groups, so that writers of whole texts need little memory."""
    docs.sparkSession.conf.set("parquet.block.size", str(ROW_GROUP))
    return docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return languages.recognised(small_groups(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_trie.first_of_each(small_groups(docs), size=5, similarity=(4, 5))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; one that changes gets its new length."""
    return repeats.cut(small_groups(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tiling.clean(small_groups(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded_documents(small_groups(docs))


STAGES: list[tuple[str, Stage]] = [
    ("language identification", language),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark),
    ("SentencePiece encoding and decoding", encoding),
]

#: No stage but the language test's rejection can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
