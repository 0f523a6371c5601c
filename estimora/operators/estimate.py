"""Deterministic effort estimates of any number of projects, one row in and one row out.

Activities are kept in an array on the project's row, so the whole pipeline is one projection
after one broadcast lookup: no shuffle. Values are rounded half to even on their shortest decimal
form, which differs from binary rounding by a tenth at most in a step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estimora.functions.rules import confidence, confidence_label, data_quality, method_kind, multipliers, project_kind
from estimora.functions.text import duration_days, occurrences, team_size
from estimora.sources.dims import ACTIVITIES, AUTOMATION_SETUP, BASELINE, DEFAULT_RISK_SHARE, RISK_DAYS, RISK_SHARE, baseline


def tenth(c: Column) -> Column:
    """Half to even at one place."""
    return F.bround(c, 1)


def classified(projects: DataFrame) -> DataFrame:
    return projects.withColumns({"ptype": project_kind(F.col("project_type")), "meth": method_kind(F.col("methodology"))})


def with_baseline(projects: DataFrame) -> DataFrame:
    """Shares by type and methodology, else by type, else the default's: one broadcast lookup table
    for each of the two, of 16 rows at most."""
    dim = baseline(projects.sparkSession)
    exact = dim.filter("meth != ''").withColumnsRenamed({"pct_min": "exact_min", "pct_max": "exact_max"})
    loose = dim.filter("meth = '' AND ptype != 'default'").drop("meth").withColumnsRenamed({"pct_min": "loose_min", "pct_max": "loose_max"})
    default = dict(zip(("pct_min", "pct_max"), next(b[2:] for b in BASELINE if b[0] == "default"), strict=True))
    out = projects.join(F.broadcast(exact), ["ptype", "meth"], "left").join(F.broadcast(loose), "ptype", "left")
    for end in ("min", "max"):
        out = out.withColumn(f"pct_{end}", F.coalesce(f"exact_{end}", f"loose_{end}", F.lit(default[f"pct_{end}"])))
    return out.drop("exact_min", "exact_max", "loose_min", "loose_max")


def with_effort(projects: DataFrame) -> DataFrame:
    """Sizes, baseline, multipliers and adjusted effort."""
    out = projects.withColumns({"days": duration_days(F.col("timeline")), "qa": team_size(F.col("team_qa_size")), "dev": team_size(F.col("team_dev_size"))})
    out = out.withColumn("mults", multipliers(F.col("compliance_requirements"), F.col("existing_automation"), F.col("known_risks"), F.col("tech_stack"), F.col("qa")))
    out = out.withColumn("mult_total", F.aggregate("mults", F.lit(0.0), lambda a, x: a + x["pct"]))
    dev_days = F.col("dev") * F.col("days") * 0.75
    share = lambda end: F.least(F.col(f"pct_{end}"), F.lit(99)) / (F.lit(100) - F.least(F.col(f"pct_{end}"), F.lit(99)))
    out = out.withColumns({f"base_{end}": tenth(dev_days * share(end)) for end in ("min", "max")})
    return out.withColumns({f"adj_{end}": tenth(F.col(f"base_{end}") * (F.lit(1) + F.col("mult_total") / 100)) for end in ("min", "max")})


def with_activities(projects: DataFrame) -> DataFrame:
    """Three-point estimates of each activity, and their totals, summed in order.

    Each step is a projection of plain columns, so that a value is computed once, in generated code,
    however often later steps use it; the array of activities is made last.
    """
    middles = {k: (lo + hi) / 2 for k, _, lo, hi in ACTIVITIES}
    whole, setup = sum(middles.values()), middles[AUTOMATION_SETUP]
    scale = f"CASE WHEN mult_total > 0 THEN {100 / whole!r}D ELSE {100 / (whole - setup)!r}D END"
    steps = (
        {"_mid": "(adj_min + adj_max) / 2", "_scale": scale},
        {f"_share{k}": f"{mid!r}D * _scale" for k, mid in middles.items()},
        {f"_m{k}": f"bround(_mid * _share{k} / 100, 1)" for k in middles},
        {f"_{end}{k}": f"bround(_m{k} * {part}D, 1)" for k in middles for end, part in (("o", 0.6), ("p", 1.8))},
    )
    out = projects
    for step in steps:
        out = out.withColumns({name: F.expr(sql) for name, sql in step.items()})
    known = lambda k, sql: f"CASE WHEN mult_total > 0 THEN {sql} END" if k == AUTOMATION_SETUP else sql
    each = {
        k: known(k, f"named_struct('ord', {k}, 'activity', '{name}', 'optimistic', _o{k}, 'most_likely', _m{k}, 'pessimistic', _p{k}, 'expected', bround((_o{k} + _m{k} * 4 + _p{k}) / 6, 1), 'sd', bround((_p{k} - _o{k}) / 6, 1), 'pct', bround(_share{k}, 0))")
        for k, name, _, _ in ACTIVITIES
    }
    total = lambda x: " + ".join(f"coalesce({known(k, f'_{x}{k}')}, 0)" if k == AUTOMATION_SETUP else f"_{x}{k}" for k in middles)
    out = out.withColumns({"_activities": F.expr(f"array_compact(array({', '.join(each.values())}))"), **{f"_{x}": F.expr(total(x)) for x in "omp"}})
    found = "'activities', _activities, 'pert_o', bround(_o, 1), 'pert_m', bround(_m, 1), 'pert_p', bround(_p, 1), 'pert_e', bround((_o + _m * 4 + _p) / 6, 1), 'pert_sd', bround((_p - _o) / 6, 1)"
    # a generator of one row: filters on these columns stay above it, and don't repeat what they are made of
    return out.select(*projects.columns, F.expr(f"inline_outer(array(named_struct({found})))"))


def risk_days(register: Column) -> Column:
    """Days that the levels named in a risk register add up to."""
    low = F.lower(register)
    named = lambda level: occurrences(low, f"| {level}") + occurrences(low, f"risk level: {level}")
    return occurrences(low, "critical") * RISK_DAYS["critical"] + named("high") * RISK_DAYS["high"] + named("medium") * RISK_DAYS["medium"]


def risk_buffer(register: Column, expected: Column) -> Column:
    """Days by the register, at most a share of the expected effort; a smaller share without one."""
    none = F.coalesce(register, F.lit("")) == ""
    return tenth(F.when(none, expected * DEFAULT_RISK_SHARE).otherwise(F.least(risk_days(register).cast("double"), expected * RISK_SHARE)))


def with_result(projects: DataFrame, register: str | None = None) -> DataFrame:
    """Capacity, risk buffer, data quality, final range and confidence."""
    known = F.col(register) if register else F.lit("")
    answers = ("timeline", "team_qa_size", "team_dev_size", "compliance_requirements", "existing_automation")
    out = projects.withColumn("available", tenth(F.col("qa") * F.col("days") * 0.75))
    out = out.withColumns({"gap": tenth(F.col("available") - F.col("pert_e")), "buffer": risk_buffer(known, F.col("pert_e")), "quality": data_quality(*map(F.col, answers))})
    out = out.withColumns({"final_min": tenth(F.col("pert_o") + F.col("buffer") * 0.5), "final_max": tenth(F.col("pert_p") + F.col("buffer"))})
    out = out.withColumn("score", confidence(F.col("pert_o"), F.col("pert_e"), F.col("pert_p"), F.col("gap"), F.col("quality"), F.col("mult_total")))
    return out.withColumn("label", confidence_label(F.col("score")))


def estimated(projects: DataFrame, register: str | None = None) -> DataFrame:
    """All steps; `register` names the column of risk registers, if there is one."""
    return with_result(with_activities(with_effort(with_baseline(classified(projects)))), register)
