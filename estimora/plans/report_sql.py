"""The SQL twins of reports, prompts and the replies of the deterministic provider."""

from __future__ import annotations

from estimora.operators import prompts, report
from estimora.plans.dialogue import SUMMARY_SQL
from estimora.plans.sql import quoted


def activity_lists() -> str:
    return "acts AS (SELECT project_id, string_agg(concat('| ', activity, ' | ', printf('%.1fd | %.1fd | %.1fd | **%.1fd** | ±%.1fd', o, m, p, e, sd), ' |'), chr(10) ORDER BY ord) AS act_rows FROM pert GROUP BY project_id)"


def text(x: str) -> str:
    """A text as SQL, line by line."""
    return "concat(" + ", chr(10), ".join(map(quoted, x.split("\n"))) + ", '')"


def report_sql(told: dict[str, str] | None = None) -> str:
    """The whole report of a row of est and acts, wants to be passed through with_tenths; told: SQL of
    the three free sections."""
    told = {k: text(v) for k, v in report.DEFAULTS.items()} | (told or {})
    titled = lambda c: f"CASE WHEN {c} = 'v-model' THEN 'V-Model' ELSE concat(upper(left({c}, 1)), substr({c}, 2)) END"
    gap = "CASE WHEN gap >= 0 THEN printf('✅ Surplus: %.1f days', gap) ELSE printf('⚠️ Deficit: %.1f days', abs(gap)) END"
    figures = f"""concat({text("| Metric | Value |")}, chr(10), '|---|---|', chr(10), printf('| **Final Effort Range** | %.1f – %.1f person-days |', final_min, final_max), chr(10), printf('| **PERT Expected Effort** | %.1f person-days |', pert_e), chr(10),
      printf('| **Risk Buffer** | %.1f person-days |', buffer), chr(10), printf('| **Available Capacity** | %.1f person-days |', available), chr(10), '| **Capacity Gap** | ', {gap}, ' |', chr(10), '| **Confidence Level** | ', label, ' (score: ', score, '/100) |')"""
    base = f"""concat('- **Project Type Detected:** ', {titled('ptype')}, chr(10), '- **Methodology Detected:** ', CASE WHEN meth = '' THEN 'General' ELSE {titled('meth')} END, chr(10), '- **Baseline QA %:** ', pct_min, '% – ', pct_max, '% of total project effort', chr(10),
      '- **Project Duration:** ~', days, ' working days', chr(10), '- **Team:** ', qa, ' QA + ', dev, ' developers', chr(10), printf('- **Baseline QA Effort:** %.1f – %.1f person-days', base_min, base_max))"""
    mults = f"""CASE WHEN len(mults) = 0 THEN {quoted('_No complexity multipliers applied — standard baseline used._')} ELSE concat('| Reason | Adjustment |', chr(10), '|---|---|', chr(10), array_to_string(list_transform(mults, lambda x: concat('| ', x.reason, ' | +', x.pct, '% |')), chr(10))) END"""
    adjusted = "concat('**Total adjustment: +', printf('%.1f', mult_total), '%**', chr(10), printf('**Adjusted effort: %.1f – %.1f person-days**', adj_min, adj_max))"
    acts = """concat('| Activity | Optimistic | Most Likely | Pessimistic | PERT Expected | SD |', chr(10), '|---|---|---|---|---|---|', chr(10), coalesce(act_rows, ''), chr(10), printf('| **TOTAL** | **%.1fd** | **%.1fd** | **%.1fd** | **%.1fd** | **±%.1fd** |', pert_o, pert_m, pert_p, pert_e, pert_sd))"""
    spread = "concat('**95% confidence range: ', printf('%.1f – %.1f person-days**', tenth(pert_e - pert_sd * 2, 1), tenth(pert_e + pert_sd * 2, 1)))"
    capacity = """concat('- **QA Team Size:** ', qa, ' engineers', chr(10), '- **Project Duration:** ', days, ' working days', chr(10), '- **Utilization Rate:** 75%', chr(10), printf('- **Available Capacity:** %.1f person-days', available), chr(10), printf('- **PERT Expected Need:** %.1f person-days', pert_e), chr(10), '- ',
      CASE WHEN gap >= 0 THEN printf('✅ **Surplus:** %.1f person-days more than needed', gap) ELSE printf('⚠️ **Deficit:** %.1f person-days too few', abs(gap)) END)"""
    risk = "concat(printf('- **Risk buffer applied:** %.1f person-days', buffer), chr(10), '- **Based on:** levels named in the risk register', chr(10), printf('- **Final effort range:** %.1f – %.1f person-days', final_min, final_max))"
    two = lambda a, b: f"concat({a}, chr(10), chr(10), {b})"
    parts = (
        ("Executive Summary", two(told["EXECUTIVE_SUMMARY"], figures)), ("Baseline Calculation", base), ("Complexity Adjustments", two(mults, adjusted)), ("Activity Breakdown (PERT)", two(acts, spread)), ("Team Capacity Analysis", capacity),
        ("Risk Buffer", risk), ("Assumptions & Constraints", told["ASSUMPTIONS"]), ("Recommendations", told["RECOMMENDATIONS"]),
    )
    body = ", chr(10), chr(10), '---', chr(10), chr(10), ".join(f"'## {k}. {name}', chr(10), chr(10), {c}" for k, (name, c) in enumerate(parts, 1))
    return f"concat('# Effort Estimation Report — ', project_name, chr(10), chr(10), {body}, chr(10))"


def reply_sql(prompt: str) -> str:
    """What the deterministic provider replies to a prompt."""
    mark = f"substring(sha256({prompt}), 1, 8)"
    return f"concat('EXECUTIVE_SUMMARY: Summary ', {mark}, '.', chr(10), 'ASSUMPTIONS: - Team stays as it is', chr(10), 'RECOMMENDATIONS: - Start early', chr(10), '| R01 | Risk ', {mark}, ' | High | Medium | High |')"


def prompt_sql(title: str, sections, context: str, register: str | None, *asked: str) -> str:
    heads = "\n".join(f"## {s}" if title == "Risk Register" else f"## {k}. {s}" for k, s in enumerate(sections, 1))
    short = f"CASE WHEN length({register}) > {prompts.REGISTER_MOST} THEN concat(substring({register}, 1, {prompts.REGISTER_MOST}), '...') ELSE {register} END"
    known = f"chr(10), 'RISK REGISTER:', chr(10), {short}, " if register else ""
    more = "".join(f", chr(10), {a}" for a in asked)
    return f"concat('Write a {title} for this project.', chr(10), chr(10), rtrim({SUMMARY_SQL}), {known}chr(10), chr(10), 'KNOWLEDGE:', chr(10), {context}, chr(10), chr(10), 'Keep to these headings:', chr(10), '# {title} — ', project_name, chr(10), {text(heads)}, chr(10){more})"
