"""Questions answered from the corpus: retrieval, prompt and reply in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estimora.operators import embedding, generation, prompts, retrieval


def answered(questions: DataFrame, vectors: DataFrame, chunks: DataFrame, providers=None, k: int = 5) -> DataFrame:
    """query_id, reply, error and sources of questions(query_id, question, query): each is asked with
    the context that its vector finds among vectors(vec_id, embedding), whose texts are
    chunks(vec_id, text, category, filename). A question that finds nothing is asked without context
    and has no sources; a null question is an empty one."""
    hits = retrieval.top_k(questions.select("query_id", "query"), vectors, k).select("query_id", "vec_id", "rank")
    found = retrieval.context(hits.join(chunks.select("vec_id", "text", "category", "filename"), "vec_id"))
    known = questions.select("query_id", "question").join(found, "query_id", "left")
    asked = known.withColumn("prompt", prompts.question_prompt(F.coalesce("context", F.lit("")), F.coalesce("question", F.lit(""))))
    told = generation.generated(asked, "prompt", providers)
    return told.select("query_id", "reply", F.col("reply_error").alias("error"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))


def sanity_check(vectors: DataFrame, text: Column | str = "test strategy", k: int = 3) -> DataFrame:
    """What a text finds among vectors(id, embedding, category, filename) that were just written: id,
    category, filename, score and rank; no rows if nothing is found. Ids are sent as hashes."""
    asked = embedding.hashed(vectors.sparkSession.range(1).select(F.lit(0).cast("long").alias("query_id"), (F.lit(text) if isinstance(text, str) else text).alias("text")))
    numbered = vectors.withColumn("vec_id", F.xxhash64("id"))
    hits = retrieval.top_k(asked.select("query_id", F.col("embedding").alias("query")), numbered.select("vec_id", "embedding"), k)
    return hits.join(numbered.select("vec_id", "id", "category", "filename"), "vec_id").select("id", "category", "filename", "score", "rank")
