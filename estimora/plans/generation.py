"""The generation pipeline: retrieval for three queries of each project in one pass, then the four documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estimora.functions.text import blank
from estimora.operators import embedding, estimate, generation, lexical, prompts, report, retrieval
from estimora.sources.shared import new_path

KINDS = ("risk", "strategy", "plan")
#: (queries(query_id, text), chunks, k) to query_id, vec_id and rank.
Retrieve = Callable[[DataFrame, DataFrame, int], DataFrame]


def by_vectors(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """By cosine of hashed words, or of the chunks' own embeddings' model where they have one."""
    asked = embedding.hashed(queries).select("query_id", F.col("embedding").alias("query"))
    vectors = chunks if "embedding" in chunks.columns else embedding.hashed(chunks)
    return retrieval.top_k(asked, vectors.select("vec_id", "embedding"), k).select("query_id", "vec_id", "rank")


def by_terms(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """By BM25 of the chunks' terms."""
    return lexical.top_k(chunks.select(F.col("vec_id").alias("doc_id"), "text"), queries, k).select("query_id", F.col("doc_id").alias("vec_id"), "rank")


def _asked() -> dict[str, Column]:
    """The query of each kind of document; wants the columns of projects."""
    return dict(zip(KINDS, (prompts.risk_query(), prompts.strategy_query(), prompts.plan_query()), strict=True))


def _found(projects: DataFrame, chunks: DataFrame, k: int, retrieve: Retrieve) -> DataFrame:
    """query_id, context and sources of each distinct query of the projects, as a table in the shared
    folder: projects repeat their answers, so each is searched once, and its context is kept once."""
    spark = projects.sparkSession
    asked, hits, found = (new_path(spark, x) for x in ("asked", "hits", "contexts"))
    projects.select(F.explode(F.array(*_asked().values())).alias("text")).distinct().withColumn("query_id", F.xxhash64("text")).write.parquet(asked)
    retrieve(spark.read.parquet(asked), chunks, k).write.parquet(hits)
    retrieval.context(spark.read.parquet(hits).join(chunks.select("vec_id", "text", "category", "filename"), "vec_id")).write.parquet(found)
    return spark.read.parquet(found)


def _with_context(rows: DataFrame, found: DataFrame, kind: str) -> DataFrame:
    """rows with the context and sources of a kind of document, null where nothing was found."""
    mine = found.select(F.col("query_id").alias("_q"), F.col("context").alias(f"{kind}_context"), F.col("sources").alias(f"{kind}_sources"))
    return rows.withColumn("_asked", F.xxhash64(_asked()[kind])).join(mine, F.col("_asked") == F.col("_q"), "left").drop("_asked", "_q")


def contexts(projects: DataFrame, chunks: DataFrame, k: int = 5, retrieve: Retrieve = by_vectors) -> DataFrame:
    """project_id, and the context and sources of each kind of document from chunks(vec_id, text,
    category, filename). A context is k chunks at most, whatever the length of the documents."""
    found, rows = _found(projects, chunks, k, retrieve), projects.dropDuplicates(["project_id"])
    for kind in KINDS:
        rows = _with_context(rows, found, kind)
    return rows.select("project_id", *(f"{kind}_{x}" for kind in KINDS for x in ("context", "sources")))


def _tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def documents_of(projects: DataFrame, chunks: DataFrame | None = None, providers=None, fetched: DataFrame | None = None, at: Column | None = None, k: int = 5, retrieve: Retrieve = by_vectors, limits=generation.Limits(), policy=generation.Policy()) -> DataFrame:
    """project_id, document_type, file_name, body, sources and error of the four documents; a step that
    fails leaves an empty body, and later ones go on without it. A blank strategy is an error, as a
    strategy is what the rest is made for. `fetched` takes the place of retrieval: what contexts() gives.
    Names are made of type, project and `at`, null where nothing was generated; an estimate has no
    sources."""
    text = lambda c: F.coalesce(c, F.lit(""))
    ask = lambda rows, prompt, out: generation.generated(rows, prompt, providers, out, limits, policy)
    # a context is joined where its prompt is made, and no further: contexts are much longer than projects
    found = _found(projects, chunks, k, retrieve) if fetched is None else None
    known = lambda rows, kind: rows if found is None else _with_context(rows, found, kind)
    rows = projects if fetched is None else projects.join(fetched, "project_id", "left")
    # projects are few bytes, so that a file of them is one task, but each takes four prompts and replies
    rows = rows.repartition(_tasks(projects.sparkSession), "project_id")
    rows = ask(known(rows, "risk").withColumn("risk_prompt", prompts.risk_prompt(text(F.col("risk_context")))), "risk_prompt", "register").withColumn("register", text(F.col("register")))
    rows = ask(estimate.estimated(rows, "register").withColumn("told_prompt", prompts.narrative_prompt()), "told_prompt", "told")
    rows = ask(known(rows, "strategy").withColumn("strategy_prompt", prompts.strategy_prompt(text(F.col("strategy_context")))), "strategy_prompt", "strategy")
    rows = ask(known(rows, "plan").withColumn("plan_prompt", prompts.plan_prompt(text(F.col("plan_context")), F.col("register"))), "plan_prompt", "plan")
    empty = F.when(blank(F.col("strategy")), F.concat(F.lit("empty test strategy for "), "project_name"))
    none = F.array().cast("array<string>")
    made = (
        ("risk_register", F.col("register"), F.col("register_error"), F.col("risk_sources")), ("test_strategy", F.when(~blank(F.col("strategy")), F.col("strategy")), F.coalesce("strategy_error", empty), F.col("strategy_sources")),
        ("effort_estimation", report.report(F.col("told")), F.col("told_error"), none), ("test_plan", F.col("plan"), F.col("plan_error"), F.col("plan_sources")),
    )
    when = F.current_timestamp() if at is None else at
    name = lambda kind, body: F.when(text(body) != "", report.file_name(kind, F.col("project_name"), when))
    bodies = F.array(*(F.struct(F.lit(kind).alias("document_type"), name(kind, body).alias("file_name"), text(body).alias("body"), F.coalesce(sources, none).alias("sources"), error.alias("error")) for kind, body, error, sources in made))
    return rows.select("project_id", F.inline(bodies))
