"""The SQL twin of the estimation pipeline, as one chain of common table expressions."""

from __future__ import annotations

import re

from estimora.functions import words as w
from estimora.sources.dims import ACTIVITIES, AUTOMATION_SETUP, BASELINE
from estimora.sources.projects import PROJECTS_SQL


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(column: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), {quoted(x)})" for x in words) + ")"


def kind(column: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(column, found)} THEN {quoted(name)}" for name, found in rules) + f" ELSE {quoted(default)} END"


def duration(c: str) -> str:
    first = f"try_cast(nullif(regexp_extract(lower({c}), '(\\d+)', 1), '') AS BIGINT)"
    years = f"try_cast(nullif(regexp_extract(lower({c}), '(\\d+\\.?\\d*)\\s*(?:year|yr)', 1), '') AS DOUBLE)"
    return (
        f"CASE WHEN {c} = '' THEN 130 WHEN {has(c, ('year', 'yr'))} THEN CAST(trunc(coalesce({years}, 1e0) * 230) AS BIGINT)"
        f" WHEN contains(lower({c}), 'month') THEN coalesce({first}, 6) * 21 WHEN contains(lower({c}), 'week') THEN coalesce({first}, 4) * 5 ELSE coalesce({first} * 21, 130) END"
    )


def team(c: str) -> str:
    found = f"regexp_extract_all(lower({c}), '(\\d+)', 1)"
    return f"CASE WHEN {has(c, w.NO_TEAM_WORDS)} THEN 0 WHEN len({found}) = 0 THEN 1 ELSE CAST(list_sum(list_transform({found}, lambda x: CAST(x AS BIGINT))) AS BIGINT) END"


def points(c: str) -> str:
    return f"CASE WHEN trim({c}) = '' THEN 0 WHEN {has(c, w.VAGUE_WORDS)} THEN 2 ELSE 4 END"


def _entry(reason: str, pct: int) -> str:
    return f"{{'reason': {quoted(reason)}, 'pct': {pct}}}"


def _multipliers() -> str:
    c, a, r, s = "compliance_requirements", "existing_automation", "known_risks", "tech_stack"
    found = [
        "CASE " + " ".join(f"WHEN {has(c, f)} THEN {_entry(n, p)}" for n, p, f in w.ASIL) + " END",
        f"CASE WHEN {has(c, w.SPICE)} AND {has(c, w.LEVEL_3)} THEN {_entry('A-SPICE compliance (Level 3)', 30)} WHEN {has(c, w.SPICE)} THEN {_entry('A-SPICE compliance (Level 2)', 20)} END",
        *(f"CASE WHEN {has(c, (f,))} THEN {_entry(n, p)} END" for n, p, f in w.NORMS),
        f"CASE WHEN {has(a, w.NO_AUTOMATION)} THEN {_entry('No existing automation — greenfield setup needed', 20)} WHEN {has(a, w.SOME_AUTOMATION)} THEN {_entry('Partial automation — maintenance + extension needed', 10)} END",
        f"CASE WHEN qa <= 2 THEN {_entry('Small QA team (≤2 people) — context switching overhead', 10)} END",
        f"CASE WHEN {has(r, w.EXTERNAL)} THEN {_entry('External integrations identified as risk', 12)} END",
        f"CASE WHEN {has(r, w.SAFETY)} AND NOT {has(c, w.SAFETY_NORMS)} THEN {_entry('Safety-critical components identified', 20)} END",
        f"CASE WHEN {has(s, w.LEGACY)} THEN {_entry('Legacy technology stack', 20)} END",
    ]
    return f"list_filter([{', '.join(found)}], lambda x: x IS NOT NULL)"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(quoted(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


SHARES = sum((lo + hi) / 2 for _, _, lo, hi in ACTIVITIES)
SETUP = next((lo + hi) / 2 for k, _, lo, hi in ACTIVITIES if k == AUTOMATION_SETUP)
TENTH = re.compile(r"tenth\(")


def with_tenths(sql: str) -> str:
    """Write tenth(x, 1) out: half to even at one place, on the shortest decimal form of x."""
    exact = "list_transform([CAST(CAST({} AS VARCHAR) AS DECIMAL(28,16))], lambda d: CAST(CASE WHEN abs(d * 10 - trunc(d * 10)) = 0.5 THEN 2 * round(d * 5) ELSE round(d * 10) END AS DOUBLE) / 10)[1]"
    while m := TENTH.search(sql):
        depth, k = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = sql[m.end() : k - 1].rsplit(",", 1)[0]
        sql = sql[: m.start()] + exact.format(inner) + sql[k:]
    return sql


def estimates(buffer: str = "pert_e * 0.15e0") -> str:
    """Common table expressions up to `pert` (a row for each project and activity) and `est` (for each project)."""
    return with_tenths(f"""WITH projects AS ({PROJECTS_SQL}),
dim(ptype, meth, pct_min, pct_max) AS (VALUES {values(BASELINE)}),
act(ord, activity, lo, hi) AS (VALUES {values(ACTIVITIES)}),
cls AS (SELECT *, {kind('project_type', w.TYPE_WORDS, 'default')} AS ptype, {kind('methodology', w.METHOD_WORDS, '')} AS meth,
  {duration('timeline')} AS days, {team('team_qa_size')} AS qa, {team('team_dev_size')} AS dev FROM projects),
base AS (SELECT c.*, coalesce(a.pct_min, b.pct_min, 20) AS pct_min, coalesce(a.pct_max, b.pct_max, 25) AS pct_max FROM cls c
  LEFT JOIN dim a ON c.ptype = a.ptype AND c.meth = a.meth AND a.meth <> '' LEFT JOIN dim b ON c.ptype = b.ptype AND b.meth = ''),
mul AS (SELECT *, {_multipliers()} AS mults FROM base),
tot AS (SELECT *, CAST(coalesce(list_sum(list_transform(mults, lambda x: x.pct)), 0) AS DOUBLE) AS mult_total,
  tenth(CAST(dev * days AS DOUBLE) * 0.75e0 * (CAST(pct_min AS DOUBLE) / (100 - pct_min)), 1) AS base_min,
  tenth(CAST(dev * days AS DOUBLE) * 0.75e0 * (CAST(pct_max AS DOUBLE) / (100 - pct_max)), 1) AS base_max FROM mul),
adj AS (SELECT *, tenth(base_min * (1 + mult_total / 100), 1) AS adj_min, tenth(base_max * (1 + mult_total / 100), 1) AS adj_max,
  CASE WHEN mult_total > 0 THEN 100e0 / {SHARES}e0 ELSE 100e0 / {SHARES - SETUP}e0 END AS scale FROM tot),
shares AS (SELECT p.*, act.*, ((lo + hi) / 2e0) * scale AS pct_mid FROM adj p CROSS JOIN act WHERE ord <> 4 OR mult_total > 0),
likely AS (SELECT *, tenth((adj_min + adj_max) / 2 * pct_mid / 100, 1) AS m FROM shares),
ends AS (SELECT *, tenth(m * 0.6e0, 1) AS o, tenth(m * 1.8e0, 1) AS p FROM likely),
pert AS (SELECT *, tenth((o + m * 4 + p) / 6, 1) AS e, tenth((p - o) / 6, 1) AS sd, round_even(round(pct_mid, 6), 0) AS pct FROM ends),
sums AS (SELECT project_id, list_reduce(list(o ORDER BY ord), lambda a, x: a + x) AS so, list_reduce(list(m ORDER BY ord), lambda a, x: a + x) AS sm, list_reduce(list(p ORDER BY ord), lambda a, x: a + x) AS sp FROM pert GROUP BY project_id),
exp AS (SELECT a.*, tenth(so, 1) AS pert_o, tenth(sm, 1) AS pert_m, tenth(sp, 1) AS pert_p, tenth((so + sm * 4 + sp) / 6, 1) AS pert_e, tenth((sp - so) / 6, 1) AS pert_sd,
  tenth(CAST(qa * days AS DOUBLE) * 0.75e0, 1) AS available FROM adj a JOIN sums USING (project_id)),
buf AS (SELECT *, tenth(available - pert_e, 1) AS gap, tenth({buffer}, 1) AS buffer,
  {' + '.join(points(c) for c in ('timeline', 'team_qa_size', 'team_dev_size', 'compliance_requirements', 'existing_automation'))} AS quality FROM exp),
fin AS (SELECT *, tenth(pert_o + buffer * 0.5e0, 1) AS final_min, tenth(pert_p + buffer, 1) AS final_max, (pert_p - pert_o) / nullif(pert_e, 0) AS spread, gap / nullif(pert_e, 0) AS slack FROM buf),
scored AS (SELECT *, CASE WHEN pert_e <= 0 THEN 0 WHEN spread < 1 THEN 40 WHEN spread < 2 THEN CAST(trunc(40 - (spread - 1) * 20) AS INTEGER) WHEN spread < 3 THEN CAST(trunc(20 - (spread - 2) * 15) AS INTEGER) ELSE 0 END
  + CASE WHEN pert_e <= 0 THEN 0 WHEN slack >= 0.3e0 THEN 30 WHEN slack >= -0.3e0 THEN CAST(trunc(15 + slack / 0.3e0 * 15) AS INTEGER) ELSE 0 END
  + least(20, greatest(0, quality)) + greatest(0, 10 - CAST(trunc(mult_total / 10) AS INTEGER)) AS score FROM fin),
est AS (SELECT *, CASE WHEN score >= 70 THEN 'High' WHEN score >= 40 THEN 'Medium' ELSE 'Low' END AS label FROM scored)
""")


ESTIMATES = estimates()
