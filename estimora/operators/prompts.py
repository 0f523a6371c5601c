"""Text columns of a project: summaries, retrieval queries, prompts and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from estimora.functions.text import shortened
from estimora.functions.words import NO_TESTS, NOTHING

# Labels of the summary, padded to one width.
SUMMARY = (("Project Name:", "project_name"), ("Description:", "project_description"), ("Type:", "project_type"), ("Tech Stack:", "tech_stack"), ("QA Team Size:", "team_qa_size"), ("Dev Team Size:", "team_dev_size"), ("Timeline:", "timeline"), ("Methodology:", "methodology"), ("Known Risks:", "known_risks"), ("Existing Automation:", "existing_automation"), ("Compliance:", "compliance_requirements"))
# Sections that each generated document must have.
RISK_SECTIONS = ("Executive Summary", "Risk Matrix Overview", "Detailed Risk Analysis", "Risk-Based Testing Priorities", "Recommendations for QA Strategy")
STRATEGY_SECTIONS = ("Project Overview", "Scope — What Will Be Tested", "Scope — What Will NOT Be Tested", "Risk Assessment", "Test Types Recommended", "Test Approach & Methodology", "Entry & Exit Criteria", "Resources & Man Power Estimation", "Tools & Environment", "Key Risks & Mitigations", "References")
PLAN_SECTIONS = ("Introduction", "Test Items", "Features to be Tested", "Features NOT to be Tested", "Test Approach", "Entry and Exit Criteria", "Test Deliverables", "Testing Schedule", "Environmental Needs", "Responsibilities", "AI Tool Usage and Oversight", "Risks and Contingencies")
MATRIX = "| Risk ID | Risk Description | Likelihood | Impact | Risk Level | Priority |"
DETAILS = ("Category", "Description", "Likelihood", "Impact", "Risk Level", "Early Warning Signs", "Mitigation Strategy", "Contingency Plan")
REGISTER_MOST = 2000


def _said(c: Column, nothing, prefix: str) -> Column:
    """The prefix and the answer, or null where the answer says nothing."""
    return F.when(~F.lower(c).isin(*nothing), F.concat(F.lit(prefix), c))


def _given(c: Column, prefix: str) -> Column:
    return F.when(c != "", F.concat(F.lit(prefix), c))


def summary() -> Column:
    lines = [F.concat(F.lit(label.ljust(23)), F.col(f)) for label, f in SUMMARY]
    return F.rtrim(F.concat_ws("\n", F.lit("PROJECT CONTEXT SUMMARY\n========================"), *lines))


def strategy_query() -> Column:
    """What to look up for a test strategy; concat_ws leaves out what is null."""
    return F.concat_ws(
        " | ", F.concat(F.lit("Test strategy for "), "project_type", F.lit(" application")), F.concat(F.lit("methodology "), "methodology"),
        _given(F.col("known_risks"), "risks: "), _said(F.col("compliance_requirements"), NOTHING, "compliance: "), _said(F.col("existing_automation"), NO_TESTS, "automation: "),
    )


def risk_query() -> Column:
    return F.concat_ws(
        " | ", F.concat(F.lit("risk based testing "), "project_type"), F.concat(F.lit("testing risks "), "methodology"),
        _said(F.col("compliance_requirements"), NOTHING, "compliance risks "), _given(F.col("known_risks"), "risk analysis "), _given(F.col("tech_stack"), "testing risks "),
    )


def plan_query() -> Column:
    return F.concat_ws(
        " | ", F.concat(F.lit("test plan IEEE 829 "), "project_type"), F.concat(F.lit("test plan structure entry exit criteria "), "methodology"), F.lit("AI assisted test planning human oversight"),
        _said(F.col("compliance_requirements"), NOTHING, "test plan compliance "), _given(F.col("tech_stack"), "test plan tools "),
    )


def prompt(title: str, sections, context: Column, register: Column | None = None, *asked: Column | str) -> Column:
    """A prompt for a document: the project's summary, retrieved context, for plans the start of the
    risk register, the document's headings in order, and what else is asked for."""
    heads = "\n".join(f"## {s}" if title == "Risk Register" else f"## {k}. {s}" for k, s in enumerate(sections, 1))
    known = [F.lit("\nRISK REGISTER:\n"), shortened(register, REGISTER_MOST)] if register is not None else []
    more = [F.concat(F.lit("\n"), F.lit(x) if isinstance(x, str) else x) for x in asked]
    return F.concat(F.lit(f"Write a {title} for this project.\n\n"), summary(), *known, F.lit("\n\nKNOWLEDGE:\n"), context, F.lit(f"\n\nKeep to these headings:\n# {title} — "), F.col("project_name"), F.lit(f"\n{heads}\n"), *more)


def risk_prompt(context: Column) -> Column:
    return prompt("Risk Register", RISK_SECTIONS, context, None, f"All risks by priority in a table: {MATRIX}", f"For each risk a part R01, R02 and so on with: {', '.join(DETAILS)}.")


def strategy_prompt(context: Column) -> Column:
    return prompt("Test Strategy", STRATEGY_SECTIONS, context, None, "Rate likelihood and impact of each risk as High, Medium or Low, and name the three to five that matter most.")


def plan_prompt(context: Column, register: Column) -> Column:
    given = F.concat(F.lit("Plan for these tools: "), "tech_stack", F.lit("; this time: "), "timeline", F.lit("; these testers: "), "team_qa_size", F.lit("; these developers: "), "team_dev_size")
    return prompt("Test Plan", PLAN_SECTIONS, context, register, "Follow IEEE 829; say when testing is suspended and resumed.", given)


def narrative_prompt() -> Column:
    """Asks for the three free sections of an estimate; wants the columns of estimates."""
    figures = F.format_string("Multipliers: %.1f%%. Effort: %.1f to %.1f person-days. Confidence: %s. Capacity gap: %.1f days.", "mult_total", "final_min", "final_max", "label", "gap")
    return F.concat(F.lit("Explain this estimate.\n"), summary(), F.lit("\n"), figures, F.lit("\nWrite EXECUTIVE_SUMMARY:, ASSUMPTIONS: and RECOMMENDATIONS:."))


def question_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Answer from this knowledge only.\n\nKNOWLEDGE:\n"), context, F.lit("\n\nQUESTION: "), question)


def messages(user: Column, system: Column | None = None) -> Column:
    """Array of (role, content): the system's first, if there is one, then the user's."""
    entry = lambda role, c: F.when(c.isNotNull() & (c != ""), F.struct(F.lit(role).alias("role"), c.alias("content")))
    own = F.struct(F.lit("user").alias("role"), F.coalesce(user, F.lit("")).alias("content"))
    return F.array_compact(F.array(entry("system", system), own)) if system is not None else F.array(own)
