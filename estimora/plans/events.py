"""Extensions beyond the questionnaire: windows over events, and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from estimora.plans.registry import query
from estimora.sources.tables import table
from estimora.streaming.ingest import event_windows, sessions


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windows(spark, sf_dir):
    out = event_windows(table(spark, sf_dir, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("user_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, sf_dir):
    return sessions(table(spark, sf_dir, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("risk_matrix", """WITH l AS (SELECT doc_id, CAST(doc_id % 5 + 1 AS INTEGER) AS likelihood, CAST((doc_id * 3) % 5 + 1 AS INTEGER) AS impact FROM labels)
  SELECT likelihood, impact, likelihood * impact AS score, count(*) AS n FROM l GROUP BY 1, 2""")
def risk_matrix(spark, sf_dir):
    """Scores of likelihood times impact."""
    out = table(spark, sf_dir, "labels").select((F.col("doc_id") % 5 + 1).cast("int").alias("likelihood"), ((F.col("doc_id") * 3) % 5 + 1).cast("int").alias("impact"))
    return out.groupBy("likelihood", "impact").agg(F.count("*").alias("n")).select("likelihood", "impact", (F.col("likelihood") * F.col("impact")).alias("score"), "n")


@query("revenue_by_nation", """SELECT n_name, year(o_orderdate) AS y, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def revenue_by_nation(spark, sf_dir):
    """A join over the star schema; only the nations are small enough to be sent."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("y"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    out = lines.join(orders, "l_orderkey").join(customers, "c_custkey").join(F.broadcast(nations), "n_nationkey")
    return out.groupBy("n_name", "y").agg(F.round(F.sum("r"), 2).alias("revenue"), F.count("*").alias("n"))


@query("parts_by_brand", "SELECT p_brand, count(*) AS n, count(DISTINCT p_type) AS types, round(min(p_retailprice), 2) AS low, max(p_size) AS size FROM part GROUP BY 1")
def parts_by_brand(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.countDistinct("p_type").alias("types"), F.round(F.min("p_retailprice"), 2).alias("low"), F.max("p_size").alias("size"))
