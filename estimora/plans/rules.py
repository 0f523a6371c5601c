"""Queries on rules as tables, chunks in SQL, and when automation pays off."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from estimora.functions import words as w
from estimora.functions.patterns import first_of, matched
from estimora.operators import chunking
from estimora.plans.registry import query
from estimora.plans.sql import ESTIMATES, has
from estimora.sources.projects import projects
from estimora.sources.tables import table

#: One table of all words, each list a rule.
RULES = (
    *((f"type {k}", found) for k, found in w.TYPE_WORDS), *((f"method {k}", found) for k, found in w.METHOD_WORDS), ("vague", w.VAGUE_WORDS), ("external", w.EXTERNAL), ("safety", w.SAFETY),
    ("legacy", w.LEGACY), ("spice", w.SPICE), *((reason, (word,)) for reason, _, word in w.NORMS),
)


@query("rules_matched", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {has('text', found)} THEN '{name}' END" for name, found in RULES) + "], lambda x: x IS NOT NULL), ', ') AS rules FROM documents")
def rules_matched(spark, sf_dir):
    """The rules of the table that each document matches, in one pass over its text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(matched(F.col("text"), RULES), ", ").alias("rules"))


@query("classify_by_table", f"{ESTIMATES} SELECT project_id, ptype, meth FROM cls")
def classify_by_table(spark, sf_dir):
    """Types and methodologies of projects by the table of rules."""
    found = projects(spark, sf_dir).select("project_id", matched(F.col("project_type"), w.TYPE_WORDS).alias("t"), matched(F.col("methodology"), w.METHOD_WORDS).alias("m"))
    return found.select("project_id", first_of(F.col("t"), [k for k, _ in w.TYPE_WORDS], "default").alias("ptype"), first_of(F.col("m"), [k for k, _ in w.METHOD_WORDS], "").alias("meth"))


@query("chunks_in_sql")
def chunks_in_sql(spark, sf_dir):
    """recursive_chunks, called from SQL."""
    chunking.register(spark)
    return spark.sql("SELECT d.doc_id, c.chunk_no, c.chunk FROM {docs} d, LATERAL recursive_chunks(d.text) c", docs=table(spark, sf_dir, "documents"))


#: Hours of a manual and of an automated run of a test, what an hour costs, and days of work to automate (of eight hours).
MANUAL_HOURS, AUTOMATED_HOURS, HOUR_COST = 0.5, 0.125, 40.0
_BREAK_EVEN = f"""WITH suites AS (SELECT p_partkey AS suite, p_size AS tests, p_size * {MANUAL_HOURS * HOUR_COST}e0 AS manual, p_size * {AUTOMATED_HOURS * HOUR_COST}e0 AS automated, (p_partkey % 17 + 1) * {8 * HOUR_COST}e0 AS setup FROM part),
  need AS (SELECT *, CAST(ceil(setup / (manual - automated)) AS BIGINT) AS cycles FROM suites WHERE manual > automated),
  months AS (SELECT l_partkey AS suite, date_trunc('month', l_shipdate) AS month, count(*) AS runs FROM lineitem GROUP BY ALL),
  cum AS (SELECT *, sum(runs) OVER (PARTITION BY suite ORDER BY month) AS done FROM months)
  SELECT n.suite AS suite, cycles, strftime(c.month, '%Y-%m') AS month, CAST(done AS BIGINT) AS done, round(done * (manual - automated) - setup, 2) AS gain FROM need n JOIN cum c ON c.suite = n.suite AND n.cycles > c.done - c.runs AND n.cycles <= c.done"""


@query("automation_break_even", _BREAK_EVEN)
def automation_break_even(spark, sf_dir):
    """Parts as test suites and their shipments as runs: after how many runs automation has paid for
    itself, in which month that is reached, and what is gained by its end; no row where it isn't reached."""
    size = F.col("p_size")
    suites = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("suite"), (size * (MANUAL_HOURS * HOUR_COST)).alias("manual"), (size * (AUTOMATED_HOURS * HOUR_COST)).alias("automated"), ((F.col("p_partkey") % 17 + 1) * (8 * HOUR_COST)).alias("setup")
    )
    need = suites.filter("manual > automated").withColumn("cycles", F.ceil(F.col("setup") / (F.col("manual") - F.col("automated"))).cast("long"))
    months = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("suite"), F.trunc("l_shipdate", "month").alias("month")).agg(F.count("*").alias("runs"))
    done = months.withColumn("done", F.sum("runs").over(W.Window.partitionBy("suite").orderBy("month")))
    crossing = (need["suite"] == done["suite"]) & (need["cycles"] > done["done"] - done["runs"]) & (need["cycles"] <= done["done"])
    out = need.join(done, crossing)
    return out.select(need["suite"], "cycles", F.date_format("month", "yyyy-MM").alias("month"), "done", F.round(F.col("done") * (F.col("manual") - F.col("automated")) - F.col("setup"), 2).alias("gain"))
