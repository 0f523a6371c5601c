"""The registered queries of the operators on training corpora, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from estimora.llm import bpe, decontaminate, exact_dedup, html_main, jaccard, langid, near_vectors, pii, spelling, sql, token_files, trie_counts, turn_trie, warc

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@_query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


@_query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


@_query
def op7_jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_table(spark, sf_dir, "documents"))


@_query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents"))


@_query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_counts.token_counts(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@_query
def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_classes(_table(spark, sf_dir, "embeddings"))


@_query
def op5_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages"))


@_query
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extracted(_table(spark, sf_dir, "pages"))


@_query
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_table(spark, sf_dir, "documents"))


@_query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


@_query
def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.trie(_table(spark, sf_dir, "conversations"))


ORACLES |= {"op11_exact_dedup": sql.EXACT_GROUPS, "op12_spelling_variants": sql.VARIANTS, "op13_turn_trie": sql.TURN_TRIE}
