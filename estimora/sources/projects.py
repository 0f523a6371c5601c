"""Project questionnaires derived from `customer`, for want of a table of projects.

Each field is one of a list of answers, chosen by arithmetic on the customer's key, so that the
same relation can be written in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estimora.sources.tables import table

#: field: (factor, shift, answers); the answer's place is (key * factor + shift) mod their number.
ANSWERS = {
    "project_description": (1, 0, ("Order desk for retail partners with nightly settlement", "Fleet telemetry and maintenance alerts", "short", "Patient intake forms and triage queue", "Ticket kiosk network of a railway")),
    "project_type": (1, 0, ("Web portal", "iOS and Android app", "REST API", "Embedded controller", "Desktop suite", "Data platform", "ticket kiosk", "Automotive ECU", "microservices backend", "email gateway", "forest inventory", "")),
    "tech_stack": (5, 1, ("React, Node.js", "Kotlin, Swift", "COBOL on a mainframe", "C, AUTOSAR, CANoe", "legacy PHP", "Spark, Airflow", "Java, Spring Boot", "")),
    "team_qa_size": (3, 1, ("2", "3 engineers", "no dedicated QA", "1", "5", "three", "4 testers + 2 leads", "none", "")),
    "team_dev_size": (7, 2, ("6", "3 frontend + 2 backend", "10 developers", "5 full-stack", "12", "4", "0", "")),
    "timeline": (1, 5, ("6 months", "2 years", "18 months", "6 weeks", "release in June 2026", "TBD", "1.5 years", "monthly sprints", "9", "18 months, target 2027 model year", "")),
    "methodology": (3, 0, ("Agile/Scrum with 2-week sprints", "Waterfall", "V-Model", "Kanban", "SAFe", "DevOps", "")),
    "known_risks": (11, 4, ("Third-party payment integration", "Safety-critical braking", "None", "External feeds and data migration", "ASIL traceability gaps", "login under load", "")),
    "existing_automation": (5, 3, ("No existing automation", "Jest unit tests", "CANoe scripted tests", "Playwright suite", "partial Selenium coverage", "Cypress E2E", "")),
    "compliance_requirements": (13, 6, ("GDPR", "PCI-DSS and GDPR", "ISO 26262 (ASIL B/C), A-SPICE Level 2", "HIPAA", "none", "ISO 26262 ASIL D, ASPICE level 3", "N/A", "iso26262", "unknown", "ISO 27001", "")),
}


def _chosen(key: Column, factor: int, shift: int, answers: tuple) -> Column:
    place = (key * factor + shift) % len(answers) + 1
    return F.element_at(F.array(*map(F.lit, answers)), place.cast("int"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each customer: project_id and the eleven answers."""
    key = F.col("c_custkey")
    named = F.concat(F.lit("Project "), F.col("c_mktsegment"), F.lit(" #"), key.cast("string"))
    return table(spark, sf_dir, "customer").select(key.alias("project_id"), named.alias("project_name"), *(_chosen(key, *a).alias(f) for f, a in ANSWERS.items()))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The same relation in SQL.
PROJECTS_SQL = (
    "SELECT c_custkey AS project_id, concat('Project ', c_mktsegment, ' #', CAST(c_custkey AS VARCHAR)) AS project_name, "
    + ", ".join(f"([{', '.join(map(_quoted, a))}])[CAST((c_custkey * {m} + {s}) % {len(a)} + 1 AS INTEGER)] AS {f}" for f, (m, s, a) in ANSWERS.items())
    + " FROM customer"
)
