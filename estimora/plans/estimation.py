"""Queries of the estimation pipeline over the projects of `customer`."""

from __future__ import annotations

from pyspark.sql import functions as F

from estimora.functions.rules import data_quality
from estimora.functions.text import duration_days, team_size
from estimora.operators.estimate import classified, estimated, with_activities, with_baseline, with_effort
from estimora.plans.registry import query
from estimora.plans.sql import ESTIMATES, duration, points, team
from estimora.sources.projects import PROJECTS_SQL, projects

FIGURES = ("base_min", "base_max", "adj_min", "adj_max", "pert_o", "pert_m", "pert_p", "pert_e", "pert_sd", "available", "gap", "buffer", "final_min", "final_max", "mult_total")


@query("estimate_projects", f"{ESTIMATES} SELECT project_id, ptype, meth, days, qa, dev, {', '.join(FIGURES)}, quality, score, label FROM est")
def estimate_projects(spark, sf_dir):
    return estimated(projects(spark, sf_dir)).select("project_id", "ptype", "meth", "days", "qa", "dev", *FIGURES, "quality", "score", "label")


@query("classify_projects", f"{ESTIMATES} SELECT project_id, project_type, methodology, ptype, meth FROM cls")
def classify_projects(spark, sf_dir):
    return classified(projects(spark, sf_dir)).select("project_id", "project_type", "methodology", "ptype", "meth")


@query("baseline_lookup", f"{ESTIMATES} SELECT ptype, meth, pct_min, pct_max, count(*) AS n FROM base GROUP BY ALL")
def baseline_lookup(spark, sf_dir):
    return with_baseline(classified(projects(spark, sf_dir))).groupBy("ptype", "meth", "pct_min", "pct_max").agg(F.count("*").alias("n"))


@query("multipliers_exploded", f"{ESTIMATES} SELECT project_id, m.reason AS reason, m.pct AS pct FROM (SELECT project_id, unnest(mults) AS m FROM mul)")
def multipliers_exploded(spark, sf_dir):
    out = with_effort(with_baseline(classified(projects(spark, sf_dir))))
    return out.select("project_id", F.explode("mults").alias("m")).select("project_id", "m.reason", "m.pct")


@query("multiplier_totals", f"{ESTIMATES} SELECT m.reason AS reason, count(*) AS n, sum(m.pct) AS total_pct FROM (SELECT unnest(mults) AS m FROM mul) GROUP BY 1")
def multiplier_totals(spark, sf_dir):
    return multipliers_exploded(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"), F.sum("pct").alias("total_pct"))


@query("pert_activities", f"{ESTIMATES} SELECT project_id, ord, activity, o AS optimistic, m AS most_likely, p AS pessimistic, e AS expected, sd, pct FROM pert")
def pert_activities(spark, sf_dir):
    out = with_activities(with_effort(with_baseline(classified(projects(spark, sf_dir)))))
    return out.select("project_id", F.explode("activities").alias("a")).select("project_id", "a.*")


@query("pert_totals", f"{ESTIMATES} SELECT project_id, pert_o, pert_m, pert_p, pert_e, pert_sd FROM exp")
def pert_totals(spark, sf_dir):
    return estimated(projects(spark, sf_dir)).select("project_id", "pert_o", "pert_m", "pert_p", "pert_e", "pert_sd")


@query("capacity_gap", f"{ESTIMATES} SELECT project_id, qa, days, available, pert_e, gap FROM buf")
def capacity_gap(spark, sf_dir):
    return estimated(projects(spark, sf_dir)).select("project_id", "qa", "days", "available", "pert_e", "gap")


@query("confidence_by_type", f"{ESTIMATES} SELECT ptype, label, count(*) AS n, min(score) AS low, max(score) AS high, sum(score) AS total FROM est GROUP BY 1, 2")
def confidence_by_type(spark, sf_dir):
    return estimated(projects(spark, sf_dir)).groupBy("ptype", "label").agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"), F.sum("score").alias("total"))


@query("parse_timeline", f"WITH projects AS ({PROJECTS_SQL}) SELECT project_id, timeline, {duration('timeline')} AS days FROM projects")
def parse_timeline(spark, sf_dir):
    return projects(spark, sf_dir).select("project_id", "timeline", duration_days(F.col("timeline")).alias("days"))


@query("parse_team_size", f"WITH projects AS ({PROJECTS_SQL}) SELECT project_id, team_qa_size, {team('team_qa_size')} AS qa, {team('team_dev_size')} AS dev FROM projects")
def parse_team_size(spark, sf_dir):
    return projects(spark, sf_dir).select("project_id", "team_qa_size", team_size(F.col("team_qa_size")).alias("qa"), team_size(F.col("team_dev_size")).alias("dev"))


ANSWERS = ("timeline", "team_qa_size", "team_dev_size", "compliance_requirements", "existing_automation")


@query("data_quality", f"WITH projects AS ({PROJECTS_SQL}) SELECT project_id, {' + '.join(map(points, ANSWERS))} AS quality FROM projects")
def quality(spark, sf_dir):
    return projects(spark, sf_dir).select("project_id", data_quality(*map(F.col, ANSWERS)).alias("quality"))
