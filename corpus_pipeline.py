"""Corpus pipeline: language identification, near-duplicate removal, benchmark decontamination,
masking of personal data, and token ids, each stage on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes to the shared
folder and reads again as the next one's docs; what a stage has written on its way is deleted when
its result is. All but the last return the columns of documents.

Defined results, for every stage: an empty table gives no rows; further columns stay as they are,
whatever they are called; rows with a null doc_id are judged by their texts as all others are. Rows
that repeat an id and a text are one document to near_duplicates, which keeps one of them; to the
other stages each is a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estimora.llm import bpe, decontaminate, jaccard, langid, pii
from estimora.llm.queries import vocabulary
from estimora.llm.shared import joined_by_id, saved, scope, unused


def keyed_by(docs: DataFrame, key: str, *columns: str) -> DataFrame:
    """docs with a 64-bit key that rows share only if they agree in a second hash of these columns, too:
    keys under which rows differ are hashed anew, together with the second hash, until there are none."""
    other, clash = unused(docs, "key_other"), unused(docs, "key_clash")
    out = docs.withColumns({key: F.xxhash64(*columns), other: F.xxhash64(F.lit("other"), *columns)})
    for attempt in range(64):
        found = out.groupBy(key).agg(F.min(other).alias("a"), F.max(other).alias("b")).filter("a <> b")
        shared = saved(found.select(F.col(key), F.lit(True).alias(clash)), "clashes")
        if not shared.limit(1).count():
            break
        again = F.xxhash64(F.lit(attempt), key, other)
        out = out.join(shared, key, "left").withColumn(key, F.when(F.col(clash), again).otherwise(F.col(key))).drop(clash)
    return out.drop(other)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null texts and those without a letter."""
    lang = unused(docs, "lang_pred")
    found = langid.predicted(docs, langid.fit(docs), lang, unused(docs, "score"))
    return found.filter(F.col(lang) != "und").select(*docs.columns)


def ordered(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return ordered(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(ordered(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates: the one with the smallest id, of those the
    one whose hash of id and text is smallest; null ids come last. Of rows that repeat an id and a text
    the one that is smallest in all columns is kept. Texts without words are no duplicates."""
    key, n = unused(docs, "row_key"), unused(docs, "row_count")
    keyed = keyed_by(docs, key, "doc_id", "text")
    found = saved(jaccard.classes(keyed.select(F.col(key).alias("doc_id"), "text")), "classes")
    ids = keyed.select(F.col(key).alias("k"), F.col("doc_id").alias("i")).groupBy("k").agg(F.first("i").alias("i"), F.count("*").alias("n"))
    each = saved(found.select(F.col("doc_id").alias("k"), "component_id").distinct().join(ids, "k"), "keys")
    # the least of a class is a partial aggregate: a class of very many copies doesn't meet in one task
    first = each.groupBy("component_id").agg(F.min(F.struct(F.col("i").isNull(), "i", "k")).alias("best")).select(F.col("best.k").alias("k"))
    copies = saved(each.join(first, "k", "left_anti").select(F.col("k").alias(key)), "copies")
    kept = joined_by_id(keyed, copies, key, "left_anti")
    again = saved(each.filter("n > 1").select(F.col("k").alias(key)), "again")
    single = joined_by_id(kept, again, key, "left_anti").select(*docs.columns)
    if not again.limit(1).count():
        return single
    row = F.struct(*docs.columns)
    least = F.min_by(row, F.struct(*(f.name for f in docs.schema if ordered(f.dataType)))).alias(n)
    return single.unionAll(joined_by_id(kept, again, key, "left_semi").groupBy(key).agg(least).select(f"{n}.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, be it with a few edits: rows of equal texts alike."""
    key = unused(docs, "text_key")
    keyed = keyed_by(docs, key, "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = decontaminate.contaminated(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark)
    found = saved(hits.select(F.col("doc_id").alias(key)).distinct(), "hits")
    return joined_by_id(keyed, found, key, "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data in the texts, and count their characters anew."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded text of each document."""
    return bpe.round_trip(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("token_ids", token_ids),
]

#: Trained models, approximate search and byte-pair merges aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        # the table that the stage read goes when its result is written
        with scope() as made:
            out = saved(stage(spark, docs, sf_dir), name)
            made.remove(out)
            made += [docs] if hasattr(docs, "_saved_path") else []
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
