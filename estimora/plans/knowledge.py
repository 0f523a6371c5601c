"""Queries on the corpus: sources, chunks, vectors, context, feedback and reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from estimora.functions.text import html_escaped, otherwise, safe_name, section, shortened, without_front_matter
from estimora.operators import ask, chunking, embedding, estimate, feedback, generation, prompts, report, retrieval
from estimora.plans.dialogue import SUMMARY_SQL
from estimora.plans.registry import query
from estimora.plans.report_sql import activity_lists, report_sql
from estimora.plans.sql import ESTIMATES, with_tenths
from estimora.sources.corpus import CATEGORIES, category_of, read_vectors, write_vectors
from estimora.sources.projects import projects
from estimora.sources.shared import new_path
from estimora.sources.tables import table

_CATEGORY = "CASE " + " ".join(f"WHEN seg = '{k}' THEN '{v}'" for k, v in CATEGORIES) + " END"
#: Pages and documents stand in folders for want of a tree of files.
FOLDERS = ("standards", "methodologies", "articles", "expert_knowledge", "generated_strategies")


@query("doc_category", f"""WITH p AS (SELECT doc_id, concat('kb/', (['standards', 'methodologies', 'articles', 'expert_knowledge', 'generated_strategies'])[CAST(doc_id % 5 + 1 AS INTEGER)], '/', source, '/doc_', CAST(doc_id AS VARCHAR), '.md') AS path FROM documents)
  SELECT doc_id, path, split_part(path, '/', 4) AS filename, coalesce(list_filter(list_transform(string_split(path, '/'), lambda seg: {_CATEGORY}), lambda x: x IS NOT NULL)[1], 'General') AS category FROM p""")
def doc_category(spark, sf_dir):
    folder = F.element_at(F.array(*map(F.lit, FOLDERS)), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat(F.lit("kb/"), folder, F.lit("/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md"))
    out = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    return out.select("doc_id", "path", F.element_at(F.split("path", "/"), -1).alias("filename"), category_of(F.col("path")).alias("category"))


@query("page_suffixes", "SELECT lower(regexp_extract(url, '[.]([^./]+)$', 1)) AS suffix, count(*) AS n FROM pages GROUP BY 1")
def page_suffixes(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(F.lower(F.regexp_extract("url", r"[.]([^./]+)$", 1)).alias("suffix")).agg(F.count("*").alias("n"))


@query("fixed_window_chunks", """SELECT doc_id, CAST(k AS INTEGER) AS chunk_no, substring(text, CAST(k * 800 + 1 AS BIGINT), 1000) AS chunk FROM (
  SELECT doc_id, text, unnest(range(0, greatest(0, CAST(ceil((length(text) - 200) / 800e0) AS BIGINT) - 1) + 1)) AS k FROM documents WHERE length(text) > 0)""")
def fixed_window_chunks(spark, sf_dir):
    return chunking.fixed_windows(table(spark, sf_dir, "documents"))


@query("recursive_chunks")
def recursive_chunks(spark, sf_dir):
    return chunking.chunked(table(spark, sf_dir, "documents"))


_COSINE = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))"


@query("vector_topk", f"SELECT e.vec_id AS vec_id, round({_COSINE}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_COSINE} DESC, e.vec_id LIMIT 5")
def vector_topk(spark, sf_dir):
    """The five vectors nearest to the first one."""
    e = table(spark, sf_dir, "embeddings")
    hits = retrieval.top_k(e.filter("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), e, 5)
    return hits.select("vec_id", F.round("score", 6).alias("score"))


TOPK_BATCH = f"""SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE} DESC, e.vec_id) AS rank
  FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q) WHERE rank <= 5"""


@query("vector_topk_batch", TOPK_BATCH)
def vector_topk_batch(spark, sf_dir):
    """Every hundredth vector as a query against all."""
    e = table(spark, sf_dir, "embeddings")
    return retrieval.top_k(e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), e, 5).select("query_id", "vec_id", "rank")


_CONTEXT = f"""WITH hits AS (SELECT * FROM (SELECT q.vec_id AS query_id, e.vec_id AS vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE} DESC, e.vec_id) AS rank
  FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q) WHERE rank <= 5)
  SELECT query_id, string_agg(concat('[Source ', CAST(r AS VARCHAR), ' — ', d.lang, ': ', d.source, ']', chr(10), d.text), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY rank) AS context,
  array_to_string(list_sort(list_distinct(list(concat('[', d.lang, '] ', d.source)))), ', ') AS sources FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM hits JOIN documents d ON d.doc_id = hits.vec_id) d GROUP BY 1"""


@query("retrieved_sources", _CONTEXT)
def retrieved_sources(spark, sf_dir):
    """The context of each query: the documents whose ids the nearest vectors have."""
    hits = vector_topk_batch(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text", F.col("lang").alias("category"), F.col("source").alias("filename"))
    found = retrieval.context(hits.join(docs, "vec_id"))
    # numbers follow the rank among what was found
    return found.select("query_id", "context", F.array_join("sources", ", ").alias("sources"))


_MARK = "substring(sha256(concat('Answer from this knowledge only.', chr(10), chr(10), 'KNOWLEDGE:', chr(10), context, chr(10), chr(10), 'QUESTION: ', question)), 1, 8)"


@query("ask_with_rag", f"""WITH found AS ({_CONTEXT}), asked AS (SELECT d.doc_id AS query_id, d.text AS question, coalesce(context, '') AS context, coalesce(sources, '') AS sources FROM documents d
  JOIN embeddings e ON e.vec_id = d.doc_id AND e.vec_id % 100 = 0 LEFT JOIN found ON found.query_id = d.doc_id)
  SELECT query_id, concat('Summary ', {_MARK}, '.') AS summary, sources FROM asked""")
def ask_with_rag(spark, sf_dir):
    """Every hundredth document as a question: retrieval, prompt and reply; the reply's summary and the sources."""
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    chunks = d.select(F.col("doc_id").alias("vec_id"), "text", F.col("lang").alias("category"), F.col("source").alias("filename"))
    own = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    questions = own.join(d.select(F.col("doc_id").alias("query_id"), F.col("text").alias("question")), "query_id")
    out = ask.answered(questions, e, chunks)
    return out.select("query_id", section(F.col("reply"), "EXECUTIVE_SUMMARY").alias("summary"), F.array_join("sources", ", ").alias("sources"))


@query("vectors_replaced", "SELECT vec_id, label, 'a' AS namespace FROM embeddings WHERE label % 2 = 0 UNION ALL SELECT vec_id, label, 'b' FROM embeddings")
def vectors_replaced(spark, sf_dir):
    """Two namespaces of a table, of which the first is replaced by fewer rows with fewer labels."""
    path, e = new_path(spark, "vectors"), table(spark, sf_dir, "embeddings").withColumn("category", F.col("label").cast("string"))
    write_vectors(e, path, "a")
    write_vectors(e, path, "b")
    write_vectors(e.filter("label % 2 = 0"), path, "a")
    return read_vectors(spark, path, "a").withColumn("namespace", F.lit("a")).union(read_vectors(spark, path, "b").withColumn("namespace", F.lit("b"))).select("vec_id", "label", "namespace")


@query("lexical_topk")
def lexical_topk(spark, sf_dir):
    """The documents nearest to each benchmark text by hashed words."""
    docs = embedding.hashed(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("vec_id"), "embedding")
    queries = embedding.hashed(table(spark, sf_dir, "benchmark")).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.top_k(queries, docs, 5).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def _count(level):
    return f"(length(low) - length(replace(low, '{level}', ''))) // {len(level)}"


#: A register is derived from each document: its text after a line of levels.
_REGISTER = "concat('| R01 | risk | ', (['High', 'Medium', 'Critical', 'Low'])[CAST(doc_id % 4 + 1 AS INTEGER)], ' | Medium | Risk Level: High |', chr(10), text)"
_LEVELS = f"WITH r AS (SELECT doc_id, lower({_REGISTER}) AS low FROM documents), n AS (SELECT doc_id, {_count('critical')} AS critical, {_count('| high')} + {_count('risk level: high')} AS high, {_count('| medium')} + {_count('risk level: medium')} AS medium FROM r)"


def _registers(spark, sf_dir):
    level = F.element_at(F.array(*map(F.lit, ("High", "Medium", "Critical", "Low"))), (F.col("doc_id") % 4 + 1).cast("int"))
    text = F.concat(F.lit("| R01 | risk | "), level, F.lit(" | Medium | Risk Level: High |\n"), "text")
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("register"))


@query("risk_level_counts", f"{_LEVELS} SELECT doc_id, critical, high, medium FROM n")
def risk_level_counts(spark, sf_dir):
    from estimora.functions.text import occurrences

    low = F.lower("register")
    named = lambda level: occurrences(low, f"| {level}") + occurrences(low, f"risk level: {level}")
    return _registers(spark, sf_dir).select("doc_id", occurrences(low, "critical").alias("critical"), named("high").alias("high"), named("medium").alias("medium"))


@query("risk_buffer", with_tenths(f"{_LEVELS} SELECT doc_id, tenth(least(CAST(critical * 5 + high * 3 + medium AS DOUBLE), CAST(doc_id % 90 AS DOUBLE) * 0.35e0), 1) AS buffer FROM n"))
def risk_buffer(spark, sf_dir):
    expected = (F.col("doc_id") % 90).cast("double")
    return _registers(spark, sf_dir).select("doc_id", estimate.risk_buffer(F.col("register"), expected).alias("buffer"))


@query("feedback_accept", """WITH f AS (SELECT l.doc_id AS doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'yes' WHEN quality = 1 THEN 'partially' ELSE 'no' END AS feedback, d.text AS text FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
  SELECT doc_id, feedback, concat('---', chr(10), 'feedback: ', feedback, chr(10), 'notes: checked', chr(10), '---', chr(10), chr(10), text) AS body FROM f WHERE feedback IN ('yes', 'partially')""")
def feedback_accept(spark, sf_dir):
    """Labels as verdicts on documents, which get a new header in place of their old one."""
    verdict = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "yes").when(F.col("quality") == 1, "partially").otherwise("no")
    given = table(spark, sf_dir, "labels").select("doc_id", verdict.alias("feedback"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("---\ngenerated_by: x\n---\n\n"), "text").alias("body"))
    rows = given.join(docs, "doc_id").withColumns({"strategy_id": F.col("doc_id"), "notes": F.lit("checked")})
    return feedback.accepted(rows).select("doc_id", "feedback", "body")


_HEAD = "---\ngenerated_by: estimora\ndate: 2026-02-23 12:00\nproject: \n---\n\n"


@query("front_matter_roundtrip", f"SELECT doc_id, length(text) + {len(_HEAD)} + length(source) AS n_written, regexp_replace(text, '^' || chr(10) || '+', '') AS body FROM documents")
def front_matter_roundtrip(spark, sf_dir):
    """Documents written with a header and read without it."""
    at = F.to_timestamp(F.lit("2026-02-23 12:00:00"))
    written = table(spark, sf_dir, "documents").select("doc_id", "source", report.with_front_matter(F.col("text"), F.col("source"), at).alias("doc"))
    return written.select("doc_id", F.length("doc").cast("long").alias("n_written"), without_front_matter(F.col("doc")).alias("body"))


@query("report_hash", with_tenths(f"{ESTIMATES}, {activity_lists()} SELECT project_id, length(r) AS n_chars, sha256(r) AS digest FROM (SELECT project_id, {report_sql()} AS r FROM est LEFT JOIN acts USING (project_id))"))
def report_hash(spark, sf_dir):
    """Whole reports, each as a digest."""
    out = estimate.estimated(projects(spark, sf_dir)).select("project_id", report.report().alias("r"))
    return out.select("project_id", F.length("r").cast("long").alias("n_chars"), F.sha2(F.col("r"), 256).alias("digest"))


@query("report_markdown", f"""{ESTIMATES} SELECT project_id, concat('| **Final Effort Range** | ', printf('%.1f', final_min), ' – ', printf('%.1f', final_max), ' person-days |') AS range_line,
  CASE WHEN gap >= 0 THEN concat('✅ Surplus: ', printf('%.1f', gap), ' days') ELSE concat('⚠️ Deficit: ', printf('%.1f', abs(gap)), ' days') END AS gap_line, 8 AS n_sections FROM est""")
def report_markdown(spark, sf_dir):
    """Whole reports; their range, gap and number of sections are compared."""
    out = estimate.estimated(projects(spark, sf_dir)).select("project_id", report.report().alias("r"))
    return out.select(
        "project_id", F.regexp_extract("r", r"(\| \*\*Final Effort Range\*\*[^\n]*)", 1).alias("range_line"), F.regexp_extract("r", r"\*\*Capacity Gap\*\* \| ([^|]*) \|", 1).alias("gap_line"),
        (F.size(F.split("r", r"\n## ")) - 1).alias("n_sections"),
    )


@query("safe_filename", r"SELECT p_partkey, concat('test_plan_', regexp_replace(replace(concat(p_name, ' / ', p_type, ' é?'), ' ', '_'), '[^\p{L}\p{N}_\-.]', '_', 'g'), '_20260223_120000.md') AS name FROM part")
def safe_filename(spark, sf_dir):
    at = F.to_timestamp(F.lit("2026-02-23 12:00:00"))
    return table(spark, sf_dir, "part").select("p_partkey", report.file_name("test_plan", F.concat("p_name", F.lit(" / "), "p_type", F.lit(" é?")), at).alias("name"))


@query("safe_source", r"SELECT doc_id, regexp_replace(replace(text, ' ', '_'), '[^\p{L}\p{N}_\-.]', '_', 'g') AS name FROM documents")
def safe_source(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", safe_name(F.col("text")).alias("name"))


@query("context_truncate", "SELECT doc_id, CASE WHEN length(text) > 2000 THEN concat(substring(text, 1, 2000), '...') ELSE text END AS register, CASE WHEN length(text) > 80 THEN concat(substring(text, 1, 80), '...') ELSE text END AS shown FROM documents")
def context_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", shortened(F.col("text"), prompts.REGISTER_MOST).alias("register"), shortened(F.col("text"), 80).alias("shown"))


@query("html_escape", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html_escaped(F.col("html")).alias("escaped"))


_FIGURES = "concat('Multipliers: ', printf('%.1f', mult_total), '%. Effort: ', printf('%.1f', final_min), ' to ', printf('%.1f', final_max), ' person-days. Confidence: ', label, '. Capacity gap: ', printf('%.1f', gap), ' days.')"
_ASKED = f"concat('Explain this estimate.', chr(10), rtrim({SUMMARY_SQL}), chr(10), {_FIGURES}, chr(10), 'Write EXECUTIVE_SUMMARY:, ASSUMPTIONS: and RECOMMENDATIONS:.')"


@query("section_extract", f"""{ESTIMATES} SELECT project_id, concat('Summary ', substring(sha256({_ASKED}), 1, 8), '.') AS executive_summary, '- Team stays as it is' AS assumptions,
  concat('- Start early', chr(10), '| R01 | Risk ', substring(sha256({_ASKED}), 1, 8), ' | High | Medium | High |') AS recommendations FROM est""")
def section_extract(spark, sf_dir):
    """Sections of generated narratives, with defaults for those that lack them."""
    asked = estimate.estimated(projects(spark, sf_dir)).withColumn("prompt", prompts.narrative_prompt())
    told = generation.generated(asked.select("project_id", "prompt"), "prompt")
    return told.select("project_id", *(otherwise(section(F.col("reply"), name), report.DEFAULTS[name]).alias(name.lower()) for name in report.DEFAULTS))


@query("index_statistics", "SELECT label, count(*) AS n, min(len(embedding)) AS dims FROM embeddings GROUP BY 1")
def index_statistics(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("dims"))


@query("chunk_overlaps", """WITH c AS (SELECT doc_id, k AS chunk_no, substring(text, k * 800 + 1, 1000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(0, CAST(ceil((length(text) - 200) / 800e0) AS BIGINT) - 1) + 1)) AS k FROM documents WHERE length(text) > 0)),
  l AS (SELECT doc_id, chunk, lag(chunk) OVER (PARTITION BY doc_id ORDER BY chunk_no) AS prior FROM c) SELECT doc_id, count(*) AS n, count(CASE WHEN prior IS NOT NULL AND right(prior, 200) = substring(chunk, 1, 200) THEN 1 END) AS n_overlap FROM l GROUP BY 1""")
def chunk_overlaps(spark, sf_dir):
    """Whether each window begins as the one before ends."""
    w = W.Window.partitionBy("doc_id").orderBy("chunk_no")
    out = fixed_window_chunks(spark, sf_dir).withColumn("prior", F.lag("chunk").over(w))
    same = F.col("prior").isNotNull() & (F.right("prior", F.lit(200)) == F.substring("chunk", 1, 200))
    return out.groupBy("doc_id").agg(F.count("*").alias("n"), F.count(F.when(same, 1)).alias("n_overlap"))
