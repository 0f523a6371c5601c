"""Queries on questionnaires: validation, progress, templates, retrieval queries and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from estimora.operators import prompts, validation
from estimora.plans.registry import query
from estimora.plans.sql import has, quoted
from estimora.functions.words import NO_TESTS, NOBODY_WORDS, NOTHING, NUMBER_WORDS
from estimora.sources import dims
from estimora.sources.projects import PROJECTS_SQL, projects
from estimora.sources.tables import table

_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')".format
_VALID = f"""texts AS (SELECT *, regexp_replace({_STRIP("coalesce(answer, '')")}, '[<>{{}}|\\\\]', '', 'g') AS t, {_STRIP("coalesce(answer, '')")} AS raw FROM answers),
named AS (SELECT *, regexp_replace({_STRIP("regexp_replace(t, '[/" + chr(92) * 2 + ':*?"<>|' + "]', '', 'g')")}, '[\\s\\p{{Z}}]+', '_', 'g') AS nm FROM texts),
errors AS (SELECT *, CASE WHEN raw = '' THEN {quoted(validation.EMPTY)} WHEN t = '' THEN {quoted(validation.NOTHING_LEFT)} WHEN length(t) > 500 THEN {quoted(validation.TOO_LONG)}
  WHEN key = 'project_name' AND nm = '' THEN {quoted(validation.BAD_NAME)} WHEN key = 'project_name' AND length(nm) < 2 THEN {quoted(validation.SHORT_NAME)}
  WHEN key IN ('project_description', 'known_risks') AND length(t) < 10 THEN {quoted(validation.TOO_SHORT)}
  WHEN key IN ('team_qa_size', 'team_dev_size') AND NOT (regexp_matches(t, '[0-9]') OR {has('t', NUMBER_WORDS + NOBODY_WORDS)}) THEN {quoted(validation.NO_NUMBER)}
  WHEN key IN ('project_type', 'tech_stack') AND length(t) < 2 THEN {quoted(validation.DEFAULT_SHORT)} ELSE '' END AS error FROM named),
checked AS (SELECT *, error = '' AS valid, CASE WHEN error <> '' THEN '' WHEN key = 'project_name' THEN substring(nm, 1, 50) ELSE t END AS cleaned FROM errors)"""
_LONG = f"projects AS ({PROJECTS_SQL}), answers AS (" + " UNION ALL ".join(f"SELECT project_id, {k} AS ord, '{f}' AS key, {f} AS answer FROM projects" for k, f in enumerate(dims.FIELDS, 1)) + ")"
_KEYS = "[" + ", ".join(quoted(f) for f in dims.FIELDS) + "]"


@query("validate_answers", f"WITH answers AS (SELECT conv_id, turn, ({_KEYS})[CAST((conv_id + turn) % 11 + 1 AS INTEGER)] AS key, text AS answer FROM conversations), {_VALID} SELECT conv_id, turn, key, valid, error, cleaned FROM checked")
def validate_answers(spark, sf_dir):
    """Turns of conversations as answers to the questionnaire's questions in turn."""
    key = F.element_at(F.array(*map(F.lit, dims.FIELDS)), ((F.col("conv_id") + F.col("turn")) % 11 + 1).cast("int"))
    answers = table(spark, sf_dir, "conversations").select("conv_id", "turn", key.alias("key"), F.col("text").alias("answer"))
    return validation.validated(answers).select("conv_id", "turn", "key", "valid", "error", "cleaned")


@query("validate_projects", f"WITH {_LONG}, {_VALID} SELECT key, error, count(*) AS n FROM checked GROUP BY 1, 2")
def validate_projects(spark, sf_dir):
    return validation.validated(validation.long_answers(projects(spark, sf_dir))).groupBy("key", "error").agg(F.count("*").alias("n"))


@query("dialogue_progress", f"""WITH {_LONG}, {_VALID} SELECT project_id, count(CASE WHEN trim(answer) <> '' THEN 1 END) AS answered, count(CASE WHEN valid THEN 1 END) AS n_valid,
  count(CASE WHEN valid THEN 1 END) = 11 AS complete, coalesce(min(CASE WHEN NOT valid THEN ord END), 12) AS next_ord FROM checked GROUP BY 1""")
def dialogue_progress(spark, sf_dir):
    return validation.progress(validation.validated(validation.long_answers(projects(spark, sf_dir))))


@query("questions_answered", f"""WITH {_LONG}, q(ord, key, question) AS (VALUES {', '.join(f"({k}, {quoted(a)}, {quoted(b)})" for k, (a, b, _) in enumerate(dims.QUESTIONS, 1))})
  SELECT q.ord AS ord, q.question AS question, count(CASE WHEN answer <> '' THEN 1 END) AS n FROM q LEFT JOIN answers a ON q.key = a.key GROUP BY 1, 2""")
def questions_answered(spark, sf_dir):
    answers = validation.long_answers(projects(spark, sf_dir)).drop("ord")
    return F.broadcast(dims.questions(spark)).join(answers, "key", "left").groupBy("ord", "question").agg(F.count(F.when(F.col("answer") != "", 1)).alias("n"))


_T = ", ".join(f"({', '.join(quoted(v) for v in t[:1] + t[2:])})" for t in dims.TEMPLATES)
_TF = ", ".join(f"t_{f}" for f in dims.FIELDS)


@query("template_overlay", f"""WITH projects AS ({PROJECTS_SQL}), t(template, {_TF}) AS (VALUES {_T}),
  p AS (SELECT *, (['web_app', 'mobile_app', 'microservices', 'automotive', NULL])[CAST(project_id % 5 + 1 AS INTEGER)] AS choice FROM projects)
  SELECT project_id, choice, coalesce(t_project_type, project_type) AS project_type, coalesce(t_timeline, timeline) AS timeline, coalesce(t_team_qa_size, team_qa_size) AS team_qa_size FROM p LEFT JOIN t ON choice = template""")
def template_overlay(spark, sf_dir):
    choice = F.element_at(F.array(*(F.lit(t[0]) for t in dims.TEMPLATES), F.lit(None)), (F.col("project_id") % 5 + 1).cast("int"))
    out = validation.overlaid(projects(spark, sf_dir).withColumn("choice", choice), dims.templates(spark), "choice")
    return out.select("project_id", "choice", "project_type", "timeline", "team_qa_size")


_CHOICE = "(['web_app', 'mobile_app', 'microservices', 'automotive', NULL])[CAST(project_id % 5 + 1 AS INTEGER)]"


@query("template_options", f"""WITH projects AS ({PROJECTS_SQL}), c AS (SELECT {_CHOICE} AS template, count(*) AS n FROM projects GROUP BY 1),
  v(ord, label, template) AS (VALUES (0, {quoted(dims.NO_TEMPLATE)}, CAST(NULL AS VARCHAR)), {', '.join(f'({k}, {quoted(t[1])}, {quoted(t[0])})' for k, t in enumerate(dims.TEMPLATES, 1))})
  SELECT v.ord, v.label, v.template, coalesce(n, 0) AS n_projects FROM v LEFT JOIN c ON v.template IS NOT DISTINCT FROM c.template""")
def template_options(spark, sf_dir):
    """The options of the first question, with the number of projects that choose each."""
    choice = F.element_at(F.array(*(F.lit(t[0]) for t in dims.TEMPLATES), F.lit(None)), (F.col("project_id") % 5 + 1).cast("int"))
    chosen = projects(spark, sf_dir).groupBy(choice.alias("chosen")).agg(F.count("*").alias("n"))
    options = F.broadcast(dims.template_options(spark))
    out = options.join(chosen, options["template"].eqNullSafe(chosen["chosen"]), "left")
    return out.select("ord", "label", "template", F.coalesce("n", F.lit(0)).alias("n_projects"))


def _said(c, nothing, prefix):
    return f"CASE WHEN lower({c}) NOT IN ({', '.join(map(quoted, nothing))}) THEN concat({quoted(prefix)}, {c}) END"


def _given(c, prefix):
    return f"CASE WHEN {c} <> '' THEN concat({quoted(prefix)}, {c}) END"


_C = "compliance_requirements"
QUERIES_SQL = (
    f"concat_ws(' | ', concat('Test strategy for ', project_type, ' application'), concat('methodology ', methodology), {_given('known_risks', 'risks: ')}, {_said(_C, NOTHING, 'compliance: ')}, {_said('existing_automation', NO_TESTS, 'automation: ')}) AS strategy_query, "
    f"concat_ws(' | ', concat('risk based testing ', project_type), concat('testing risks ', methodology), {_said(_C, NOTHING, 'compliance risks ')}, {_given('known_risks', 'risk analysis ')}, {_given('tech_stack', 'testing risks ')}) AS risk_query, "
    f"concat_ws(' | ', concat('test plan IEEE 829 ', project_type), concat('test plan structure entry exit criteria ', methodology), 'AI assisted test planning human oversight', {_said(_C, NOTHING, 'test plan compliance ')}, {_given('tech_stack', 'test plan tools ')}) AS plan_query"
)


@query("rag_queries", f"WITH projects AS ({PROJECTS_SQL}) SELECT project_id, {QUERIES_SQL} FROM projects")
def rag_queries(spark, sf_dir):
    return projects(spark, sf_dir).select("project_id", prompts.strategy_query().alias("strategy_query"), prompts.risk_query().alias("risk_query"), prompts.plan_query().alias("plan_query"))


SUMMARY_SQL = "concat(" + ", chr(10), ".join([quoted("PROJECT CONTEXT SUMMARY"), quoted("=" * 24), *(f"{quoted(label.ljust(23))}, {f}" for label, f in prompts.SUMMARY)]) + ")"


@query("context_summary", f"WITH projects AS ({PROJECTS_SQL}) SELECT project_id, rtrim({SUMMARY_SQL}) AS summary FROM projects")
def context_summary(spark, sf_dir):
    return projects(spark, sf_dir).select("project_id", prompts.summary().alias("summary"))


@query("chat_messages", """SELECT conv_id, k AS ord, role, content FROM (
  SELECT conv_id, 1 AS k, 'system' AS role, string_agg(text, chr(10) ORDER BY turn) AS content FROM conversations WHERE role = 'system' GROUP BY 1
  UNION ALL SELECT conv_id, CASE WHEN bool_or(role = 'system' AND text <> '') THEN 2 ELSE 1 END, 'user', coalesce(string_agg(CASE WHEN role = 'user' THEN text END, chr(10) ORDER BY turn), '') FROM conversations GROUP BY 1) WHERE content <> '' OR role = 'user'""")
def chat_messages(spark, sf_dir):
    """A request for each conversation: its system turns, if any, then its user turns."""
    turns = table(spark, sf_dir, "conversations")
    said = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"]), "\n")
    asked = turns.groupBy("conv_id").agg(said("system").alias("system"), said("user").alias("user"))
    out = asked.select("conv_id", F.posexplode(prompts.messages(F.col("user"), F.col("system"))).alias("k", "m"))
    return out.select("conv_id", (F.col("k") + 1).alias("ord"), "m.role", "m.content")
