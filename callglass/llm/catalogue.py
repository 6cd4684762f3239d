"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from callglass.llm import (
    alignment, chat_format, hilbert, jaccard_trie, languages, near_vectors, page_text, pieces, repeats, tiling, token_trees, toxicity, whitening,
)
from callglass.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.documents_in_shards(table(spark, sf_dir, "documents"))


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded_documents(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_trie.joined(table(spark, sf_dir, "documents"), size=3, similarity=(9, 10))


def op4_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_language_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identified(table(spark, sf_dir, "documents"))


def op7_token_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_trees.scrubbed_counts(table(spark, sf_dir, "documents"))


def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.main_texts(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_aligned_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), signs="|;")


def op13_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.formatted_digests(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hilbert_shards": op1_hilbert_shards,
    "op2_sentence_pieces": op2_sentence_pieces,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_repeated_windows": op4_repeated_windows,
    "op5_near_vectors": op5_near_vectors,
    "op6_language_mixtures": op6_language_mixtures,
    "op7_token_trees": op7_token_trees,
    "op8_page_text": op8_page_text,
    "op9_toxicity": op9_toxicity,
    "op10_string_tiling": op10_string_tiling,
    "op11_whitened": op11_whitened,
    "op12_aligned_tokens": op12_aligned_tokens,
    "op13_chat_parts": op13_chat_parts,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {"op5_near_vectors": near_vectors.SQL, "op13_chat_parts": chat_format.SQL}
