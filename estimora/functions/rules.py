"""Column builders of the classification and multiplier rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from estimora.functions import words as w
from estimora.functions.text import answer_points, contains_any


def first_kind(c: Column, rules, default: str) -> Column:
    out = None
    for kind, found in rules:
        hit = contains_any(c, found)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(default)


def project_kind(c: Column) -> Column:
    return first_kind(c, w.TYPE_WORDS, "default")


def method_kind(c: Column) -> Column:
    return first_kind(c, w.METHOD_WORDS, "")


def _entry(reason, pct) -> Column:
    return F.struct(F.lit(reason).alias("reason") if isinstance(reason, str) else reason.alias("reason"), F.lit(pct).cast("int").alias("pct") if isinstance(pct, int) else pct.cast("int").alias("pct"))


def multipliers(compliance: Column, automation: Column, risks: Column, stack: Column, qa_size: Column) -> Column:
    """Array of (reason, pct) of all that raises the effort, in order."""
    asil = None
    for reason, pct, found in w.ASIL:
        hit = contains_any(compliance, found)
        asil = F.when(hit, _entry(reason, pct)) if asil is None else asil.when(hit, _entry(reason, pct))
    level_3 = contains_any(compliance, w.LEVEL_3)
    spice = _entry(F.when(level_3, "A-SPICE compliance (Level 3)").otherwise("A-SPICE compliance (Level 2)"), F.when(level_3, 30).otherwise(20))
    found = [
        asil,
        F.when(contains_any(compliance, w.SPICE), spice),
        *(F.when(contains_any(compliance, (word,)), _entry(reason, pct)) for reason, pct, word in w.NORMS),
        F.when(contains_any(automation, w.NO_AUTOMATION), _entry("No existing automation — greenfield setup needed", 20)).when(contains_any(automation, w.SOME_AUTOMATION), _entry("Partial automation — maintenance + extension needed", 10)),
        F.when(qa_size <= 2, _entry("Small QA team (≤2 people) — context switching overhead", 10)),
        F.when(contains_any(risks, w.EXTERNAL), _entry("External integrations identified as risk", 12)),
        F.when(contains_any(risks, w.SAFETY) & ~contains_any(compliance, w.SAFETY_NORMS), _entry("Safety-critical components identified", 20)),
        F.when(contains_any(stack, w.LEGACY), _entry("Legacy technology stack", 20)),
    ]
    return F.array_compact(F.array(*found))


def data_quality(*answers: Column) -> Column:
    return sum((answer_points(a) for a in answers[1:]), answer_points(answers[0]))


def confidence(o: Column, e: Column, p: Column, gap: Column, quality: Column, total: Column) -> Column:
    """Score of 0 to 100: spread of the estimate, gap of capacity, answers, and size of the multipliers."""
    s, g = (p - o) / F.nullif(e, F.lit(0.0)), gap / F.nullif(e, F.lit(0.0))
    spread = F.when(e <= 0, 0).when(s < 1, 40).when(s < 2, (F.lit(40) - (s - 1) * 20).cast("int")).when(s < 3, (F.lit(20) - (s - 2) * 15).cast("int")).otherwise(0)
    slack = F.when(e <= 0, 0).when(g >= 0.3, 30).when(g >= -0.3, (F.lit(15) + g / 0.3 * 15).cast("int")).otherwise(0)
    return spread + slack + F.least(F.lit(20), F.greatest(F.lit(0), quality)) + F.greatest(F.lit(0), F.lit(10) - (total / 10).cast("int"))


def confidence_label(score: Column) -> Column:
    return F.when(score >= 70, "High").when(score >= 40, "Medium").otherwise("Low")
