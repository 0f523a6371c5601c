"""The four documents of each project, with chunks of the corpus as context."""

from __future__ import annotations

from pyspark.sql import functions as F

from estimora.operators import chunking, prompts
from estimora.plans.dialogue import QUERIES_SQL, SUMMARY_SQL
from estimora.plans.generation import by_terms, documents_of
from estimora.plans.registry import query
from estimora.plans.report_sql import activity_lists, prompt_sql, reply_sql, report_sql
from estimora.plans.search import bm25_sql
from estimora.plans.sql import estimates, quoted, with_tenths
from estimora.sources.projects import projects
from estimora.sources.tables import table

#: Chunks of a document at most, by which chunks are numbered.
CHUNKS_MOST = 1_000_000
_CHUNKS = f"""chunks AS (SELECT doc_id * {CHUNKS_MOST} + k AS vec_id, substring(text, CAST(k * 800 + 1 AS BIGINT), 1000) AS text, lang AS category, source AS filename
  FROM (SELECT *, unnest(range(0, greatest(0, CAST(ceil((length(text) - 200) / 800e0) AS BIGINT) - 1) + 1)) AS k FROM documents WHERE length(text) > 0))"""
_ASKED = f"asked AS (SELECT project_id, unnest([{{'kind': 'strategy', 'text': strategy_query}}, {{'kind': 'risk', 'text': risk_query}}, {{'kind': 'plan', 'text': plan_query}}], recursive := true) FROM (SELECT project_id, {QUERIES_SQL} FROM projects))"
_CONTEXTS = """found AS (SELECT q, string_agg(concat('[Source ', rank, ' — ', category, ': ', filename, ']', chr(10), c.text), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY rank) AS context,
  array_to_string(list_sort(list_distinct(list(concat('[', category, '] ', filename)))), ', ') AS sources FROM hits JOIN chunks c ON c.vec_id = hits.doc_id GROUP BY q),
  ctx AS (SELECT project_id, """ + ", ".join(f"max(CASE WHEN kind = '{k}' THEN context END) AS {k}_context, max(CASE WHEN kind = '{k}' THEN sources END) AS {k}_sources" for k in ("risk", "strategy", "plan")) + " FROM asked LEFT JOIN found ON found.q = asked.text GROUP BY project_id)"
_RISK = prompt_sql("Risk Register", prompts.RISK_SECTIONS, "coalesce(risk_context, '')", None, quoted(f"All risks by priority in a table: {prompts.MATRIX}"), quoted(f"For each risk a part R01, R02 and so on with: {', '.join(prompts.DETAILS)}."))
_STRATEGY = prompt_sql("Test Strategy", prompts.STRATEGY_SECTIONS, "coalesce(strategy_context, '')", None, quoted("Rate likelihood and impact of each risk as High, Medium or Low, and name the three to five that matter most."))
_PLAN = prompt_sql("Test Plan", prompts.PLAN_SECTIONS, "coalesce(plan_context, '')", "register", quoted("Follow IEEE 829; say when testing is suspended and resumed."), "concat('Plan for these tools: ', tech_stack, '; this time: ', timeline, '; these testers: ', team_qa_size, '; these developers: ', team_dev_size)")
_TOLD = f"concat('Explain this estimate.', chr(10), rtrim({SUMMARY_SQL}), chr(10), 'Multipliers: ', printf('%.1f', mult_total), '%. Effort: ', printf('%.1f', final_min), ' to ', printf('%.1f', final_max), ' person-days. Confidence: ', label, '. Capacity gap: ', printf('%.1f', gap), ' days.', chr(10), 'Write EXECUTIVE_SUMMARY:, ASSUMPTIONS: and RECOMMENDATIONS:.')"
_MARK = "substring(sha256(told_prompt), 1, 8)"
_SECTIONS = {"EXECUTIVE_SUMMARY": f"concat('Summary ', {_MARK}, '.')", "ASSUMPTIONS": "'- Team stays as it is'", "RECOMMENDATIONS": f"concat('- Start early', chr(10), '| R01 | Risk ', {_MARK}, ' | High | Medium | High |')"}
_NAME = r"concat('{}_', regexp_replace(replace(project_name, ' ', '_'), '[^\p{{L}}\p{{N}}_\-.]', '_', 'g'), '_20260223_120000.md')"
#: The register of the deterministic provider names two high levels and a medium one: seven days.
_ALL = with_tenths(f"""{estimates("least(7e0, pert_e * 0.35e0)")}, {activity_lists()}, {_CHUNKS}, {_ASKED}, {bm25_sql("chunks", "vec_id", "(SELECT DISTINCT text AS q, text FROM asked)", "q", "hits")}, {_CONTEXTS},
  prompted AS (SELECT *, {_RISK} AS risk_prompt, {_STRATEGY} AS strategy_prompt, {_TOLD} AS told_prompt FROM est JOIN ctx USING (project_id) LEFT JOIN acts USING (project_id)),
  registered AS (SELECT *, {reply_sql("risk_prompt")} AS register FROM prompted), planned AS (SELECT *, {_PLAN} AS plan_prompt FROM registered)
  SELECT project_id, 'risk_register' AS document_type, {_NAME.format("risk_register")} AS file_name, register AS body, coalesce(risk_sources, '') AS sources FROM planned
  UNION ALL SELECT project_id, 'test_strategy', {_NAME.format("test_strategy")}, {reply_sql("strategy_prompt")}, coalesce(strategy_sources, '') FROM planned
  UNION ALL SELECT project_id, 'effort_estimation', {_NAME.format("effort_estimation")}, {report_sql(_SECTIONS)}, '' FROM planned
  UNION ALL SELECT project_id, 'test_plan', {_NAME.format("test_plan")}, {reply_sql("plan_prompt")}, coalesce(plan_sources, '') FROM planned""")


@query("generate_all", _ALL)
def generate_all(spark, sf_dir):
    """The four documents of each project: retrieval of chunks, risk register, estimate, strategy and plan."""
    docs = table(spark, sf_dir, "documents").withColumnsRenamed({"lang": "category", "source": "filename"})
    cut = chunking.fixed_windows(docs, keep=("category", "filename"))
    chunks = cut.select((F.col("doc_id") * CHUNKS_MOST + F.col("chunk_no")).alias("vec_id"), F.col("chunk").alias("text"), "category", "filename")
    found = documents_of(projects(spark, sf_dir), chunks, at=F.to_timestamp(F.lit("2026-02-23 12:00:00")), retrieve=by_terms)
    return found.select("project_id", "document_type", "file_name", "body", F.array_join("sources", ", ").alias("sources"))
