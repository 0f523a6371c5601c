"""Boundary tables of the estimation rules, and golden estimates of known projects."""

import pytest
from pyspark.sql import functions as F

from estimora.functions.rules import confidence, confidence_label, data_quality
from estimora.functions.text import duration_days, team_size
from estimora.operators.estimate import estimated, risk_buffer
from estimora.sources.dims import FIELDS, TEMPLATES, templates
from estimora.sources.projects import projects


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, days",
    [("2 years", 460), ("18 months", 378), ("6 weeks", 30), ("", 130), (None, 130), ("year", 230), ("2.5 years", 575), ("monthly sprints", 126), ("1.5 months", 21), ("3", 63), ("TBD", 130), ("release in June 2026", 42546), ("18 months, target 2027 model year", 230), ("2-week sprints for 6 months", 42)],
)
def test_duration(spark, text, days):
    assert one(spark, duration_days(F.col("t")), t=text) == days


@pytest.mark.parametrize("text, size", [("2", 2), ("5 developers", 5), ("3 frontend + 2 backend", 5), ("no dedicated QA", 0), ("none", 0), ("three", 1), ("", 1), ("no QA", 1), ("n/a", 1), ("5-6", 11)])
def test_team_size(spark, text, size):
    assert one(spark, team_size(F.col("t")), t=text) == size


CONFIDENCE = [
    (90, 100, 100, -100, 0, 100, 40, "Medium"), (50, 100, 200, -100, 0, 100, 30, "Low"), (50, 100, 300, -100, 0, 100, 12, "Low"), (50, 100, 350, -100, 0, 100, 0, "Low"),
    (50, 100, 350, 30, 0, 100, 30, "Low"), (50, 100, 350, 15, 0, 100, 22, "Low"), (50, 100, 350, -15, 0, 100, 7, "Low"), (50, 100, 350, -30, 0, 100, 0, "Low"),
    (50, 100, 350, -100, 0, 0, 10, "Low"), (50, 100, 350, -100, 0, 50, 5, "Low"), (90, 100, 100, 50, 20, 0, 100, "High"), (90, 100, 100, 0, 10, 50, 70, "High"),
    (50, 100, 200, -15, 2, 90, 40, "Medium"), (50, 100, 200, -15, 2, 100, 39, "Low"), (600, 1600, 3200, -900, 4, 82, 33, "Low"), (100, 150, 200, 60, 20, 0, 100, "High"),
]


def test_confidence(spark):
    rows = spark.createDataFrame([(*map(float, c[:4]), c[4], float(c[5]), c[6], c[7]) for c in CONFIDENCE], "o double, e double, p double, gap double, q int, m double, score int, label string")
    found = rows.withColumn("got", confidence(*(F.col(c) for c in ("o", "e", "p", "gap", "q", "m"))))
    assert not found.filter((F.col("got") != F.col("score")) | (confidence_label(F.col("got")) != F.col("label"))).count()


def test_quality(spark):
    five = lambda *v: one(spark, data_quality(*(F.col(f"c{k}") for k in range(5))), **{f"c{k}": x for k, x in enumerate(v)})
    assert five("6 months", "3", "5", "GDPR", "Jest suite") == 20
    assert five("TBD", "unknown", "5", "GDPR", "Jest suite") == 16
    assert five("", "", "", None, "  ") == 0


# baseline, adjusted, O, M, P, E, SD, available, gap, buffer, final, score, label
GOLDEN = {
    "web_app": (42, 100.1, 141.8, 142.1, 201.4, 103.0, 171.8, 309.5, 183.3, 34.4, 189.0, 5.7, 27.5, 116.8, 337.0, 79, "High"),
    "mobile_app": (20, 63.0, 84.0, 75.6, 100.8, 52.9, 88.2, 158.8, 94.1, 17.7, 63.0, -31.1, 14.1, 59.9, 172.9, 65, "Medium"),
    "microservices": (15, 250.1, 354.4, 287.6, 407.6, 208.8, 347.8, 625.9, 371.0, 69.5, 425.2, 54.2, 55.6, 236.6, 681.5, 88, "High"),
    "automotive": (60, 972.0, 1512.0, 1555.2, 2419.2, 1192.1, 1987.1, 3576.8, 2119.6, 397.5, 1134.0, -985.6, 317.9, 1351.0, 3894.7, 61, "Medium"),
}
COLUMNS = ("mult_total", "base_min", "base_max", "adj_min", "adj_max", "pert_o", "pert_m", "pert_p", "pert_e", "pert_sd", "available", "gap", "buffer", "final_min", "final_max", "score", "label")


def test_golden_templates(spark):
    found = {r["template"]: r for r in estimated(templates(spark).withColumn("project_id", F.lit(1))).collect()}
    assert len(found) == len(TEMPLATES)
    for name, expected in GOLDEN.items():
        assert tuple(found[name][c] for c in COLUMNS) == pytest.approx(expected), name


ECU = ("ECU", "Brake control unit", "automotive embedded system", "C, AUTOSAR", "2", "6", "2 years", "V-model", "third-party CAN bus integration", "No existing automation", "ISO 26262 ASIL B, A-SPICE level 2")


def test_golden_ecu(spark):
    row = estimated(spark.createDataFrame([(1, *ECU)], "project_id long, " + ", ".join(f"{f} string" for f in FIELDS))).first()
    assert row["mult_total"] == 82 and len(row["mults"]) == 5 and len(row["activities"]) == 9
    assert (row["pert_o"], row["pert_m"], row["pert_p"], row["pert_e"], row["pert_sd"]) == (1237.6, 2062.8, 3713.1, 2200.3, 412.6)
    assert (row["gap"], row["buffer"], row["score"], row["label"]) == (-1510.3, 330.0, 59, "Medium")


def test_risk_buffer(spark):
    buffer = lambda text, e: one(spark, risk_buffer(F.col("t"), F.col("e")), t=text, e=float(e))
    assert buffer("", 100) == buffer(None, 100) == 15.0
    assert buffer("| R01 | High | Medium | level", 128.9) == 4.0
    assert buffer("critical " * 50, 100) == 35.0
    assert buffer("**Risk Level:** High", 100) == 0.0
    assert buffer("Risk Level: High", 100) == 3.0


def test_invariants_and_plan(spark):
    out = estimated(projects(spark, "/root/testdata/sf0.001"))
    bad = out.filter((F.col("pert_o") > F.col("pert_m")) | (F.col("pert_m") > F.col("pert_p")) | ~F.col("score").between(0, 100) | (F.col("buffer") > F.col("pert_e") * 0.35 + 0.1))
    assert not bad.count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
