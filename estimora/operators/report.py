"""Markdown reports of estimates, documents with front matter, and their file names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estimora.functions.text import otherwise, safe_name, section, titled
from estimora.sources import document_files

# Headings, heads of tables and labels of figures below, which readers of reports look for, and what stands in place of sections that a narrative lacks.
DEFAULTS = {
    "EXECUTIVE_SUMMARY": "QA effort estimate generated based on project context and industry benchmarks.",
    "ASSUMPTIONS": "- Standard working days assumed (8h/day)\n- 75% utilization rate for QA engineers",
    "RECOMMENDATIONS": "- Prioritize testing based on identified risks\n- Invest in test automation early",
}
PREFIXES = ("risk_register", "test_strategy", "effort_estimation", "test_plan")


def narrative(reply: Column, name: str) -> Column:
    return otherwise(section(F.coalesce(reply, F.lit("")), name), DEFAULTS[name])


def multiplier_table() -> Column:
    rows = F.transform("mults", lambda m: F.format_string("| %s | +%d%% |", m["reason"], m["pct"]))
    table = F.concat(F.lit("| Reason | Adjustment |\n|---|---|\n"), F.array_join(rows, "\n"))
    return F.when(F.size("mults") == 0, "_No complexity multipliers applied — standard baseline used._").otherwise(table)


def activity_table() -> Column:
    rows = F.transform("activities", lambda a: F.format_string("| %s | %.1fd | %.1fd | %.1fd | **%.1fd** | ±%.1fd |", a["activity"], a["optimistic"], a["most_likely"], a["pessimistic"], a["expected"], a["sd"]))
    total = F.format_string("| **TOTAL** | **%.1fd** | **%.1fd** | **%.1fd** | **%.1fd** | **±%.1fd** |", "pert_o", "pert_m", "pert_p", "pert_e", "pert_sd")
    head = "| Activity | Optimistic | Most Likely | Pessimistic | PERT Expected | SD |\n|---|---|---|---|---|---|\n"
    return F.concat(F.lit(head), F.array_join(rows, "\n"), F.lit("\n"), total)


def capacity_lines() -> Column:
    enough = F.format_string("✅ **Surplus:** %.1f person-days more than needed", "gap")
    short = F.format_string("⚠️ **Deficit:** %.1f person-days too few", F.abs("gap"))
    known = F.format_string("- **QA Team Size:** %d engineers\n- **Project Duration:** %d working days\n- **Utilization Rate:** 75%%\n- **Available Capacity:** %.1f person-days\n- **PERT Expected Need:** %.1f person-days\n- ", "qa", "days", "available", "pert_e")
    return F.concat(known, F.when(F.col("gap") >= 0, enough).otherwise(short))


def report(reply: Column | None = None) -> Column:
    """The report of an estimate in eight sections; wants the columns of estimates."""
    told = reply if reply is not None else F.lit("")
    gap = F.when(F.col("gap") >= 0, F.format_string("✅ Surplus: %.1f days", "gap")).otherwise(F.format_string("⚠️ Deficit: %.1f days", F.abs("gap")))
    figures = F.concat(
        F.format_string("| Metric | Value |\n|---|---|\n| **Final Effort Range** | %.1f – %.1f person-days |\n| **PERT Expected Effort** | %.1f person-days |\n| **Risk Buffer** | %.1f person-days |\n| **Available Capacity** | %.1f person-days |\n| **Capacity Gap** | ", "final_min", "final_max", "pert_e", "buffer", "available"),
        gap, F.format_string(" |\n| **Confidence Level** | %s (score: %d/100) |", "label", "score"),
    )
    base = F.format_string(
        "- **Project Type Detected:** %s\n- **Methodology Detected:** %s\n- **Baseline QA %%:** %d%% – %d%% of total project effort\n- **Project Duration:** ~%d working days\n- **Team:** %d QA + %d developers\n- **Baseline QA Effort:** %.1f – %.1f person-days",
        titled(F.col("ptype")), otherwise(titled(F.col("meth")), "General"), "pct_min", "pct_max", "days", "qa", "dev", "base_min", "base_max",
    )
    adjusted = F.format_string("**Total adjustment: +%.1f%%**\n**Adjusted effort: %.1f – %.1f person-days**", "mult_total", "adj_min", "adj_max")
    spread = F.format_string("**95%% confidence range: %.1f – %.1f person-days**", F.bround(F.col("pert_e") - F.col("pert_sd") * 2, 1), F.bround(F.col("pert_e") + F.col("pert_sd") * 2, 1))
    risk = F.format_string("- **Risk buffer applied:** %.1f person-days\n- **Based on:** levels named in the risk register\n- **Final effort range:** %.1f – %.1f person-days", "buffer", "final_min", "final_max")
    parts = [
        ("Executive Summary", F.concat_ws("\n\n", narrative(told, "EXECUTIVE_SUMMARY"), figures)), ("Baseline Calculation", base), ("Complexity Adjustments", F.concat_ws("\n\n", multiplier_table(), adjusted)),
        ("Activity Breakdown (PERT)", F.concat_ws("\n\n", activity_table(), spread)), ("Team Capacity Analysis", capacity_lines()), ("Risk Buffer", risk),
        ("Assumptions & Constraints", narrative(told, "ASSUMPTIONS")), ("Recommendations", narrative(told, "RECOMMENDATIONS")),
    ]
    body = [F.concat(F.lit(f"## {k}. {name}\n\n"), c) for k, (name, c) in enumerate(parts, 1)]
    return F.concat(F.lit("# Effort Estimation Report — "), F.col("project_name"), F.lit("\n\n"), F.concat_ws("\n\n---\n\n", *body), F.lit("\n"))


def file_name(prefix: str, project: Column, at: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), safe_name(project), F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(".md"))


def with_front_matter(body: Column, project: Column, at: Column, document_type: str | None = None) -> Column:
    kind = [F.lit(f"document_type: {document_type}")] if document_type else []
    head = F.concat_ws("\n", F.lit("---"), F.lit("generated_by: estimora"), F.concat(F.lit("date: "), F.date_format(at, "yyyy-MM-dd HH:mm")), F.concat(F.lit("project: "), project), *kind, F.lit("---"))
    return F.concat(head, F.lit("\n\n"), body)


def pdf(documents: DataFrame, render, column: str = "body") -> DataFrame:
    """documents with `pdf`: what `render` makes of the Markdown, null where it fails or the text is null."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = []
            for text in batch:
                try:
                    found.append(render(text) if isinstance(text, str) else None)
                except Exception:  # noqa: BLE001  a document that can't be rendered has no PDF
                    found.append(None)
            yield pd.Series(found, dtype=object)

    return documents.withColumn("pdf", run(F.col(column)))


def named(documents: DataFrame, document_type: str = "document_type", project: str = "project_name", at: str = "generated_at", body: str = "body") -> DataFrame:
    """file_name and body with its front matter, both made of the row: its type is the name's first part."""
    kind, text = F.col(document_type), F.col(body)
    head = F.concat_ws("\n", F.lit("---"), F.lit("generated_by: estimora"), F.concat(F.lit("date: "), F.date_format(at, "yyyy-MM-dd HH:mm")), F.concat(F.lit("project: "), F.col(project)), F.concat(F.lit("document_type: "), kind), F.lit("---"))
    name = F.concat(kind, F.lit("_"), safe_name(F.col(project)), F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(".md"))
    return documents.select(name.alias("file_name"), F.concat(head, F.lit("\n\n"), text).alias("body"))


def write_documents(documents: DataFrame, folder: str, mode: str = "append") -> None:
    """Write documents(file_name, body) as text files to a folder that all executors reach: all of them,
    or none if a task fails. A file that is there already is replaced; of rows with one name the
    greatest body is written, and null bodies and names are not."""
    document_files.register(documents.sparkSession)
    once = documents.filter("body IS NOT NULL AND file_name IS NOT NULL").groupBy("file_name").agg(F.max("body").alias("body"))
    once.write.format("document_files").mode(mode).save(folder)
