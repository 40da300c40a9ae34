"""SQL for the oracle engine that says what the column builders say."""

from __future__ import annotations

from ..functions import patterns as P
from ..operators.rules import STEP_UP, THRESHOLDS
from .notes import DETAILS_SQL, DISCHARGE_SQL, NOTES_SQL


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(col: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({col}, {q('(?i)' + pattern)}), false)"


def found(col: str, pattern: str) -> str:
    """Null without a match."""
    return f"nullif(regexp_extract({col}, {q('(?i)' + pattern)}), '')"


def group(col: str, pattern: str, n: int) -> str:
    return f"nullif(regexp_extract({col}, {q('(?i)' + pattern)}, {n}), '')"


def first_of(col: str, rules, span: bool = False) -> str:
    return "CASE " + " ".join(f"WHEN {has(col, p)} THEN {found(col, p) if span else q(v)}" for p, v in rules) + " END"


def size(col: str) -> str:
    cases = []
    for _, pattern, how, unit in P.SIZES:
        n = pattern.count(P.NUMBER)
        xs = [f"try_cast({group(col, pattern, i + 1)} AS DOUBLE)" for i in range(n)]
        one = xs[0] if n == 1 else f"({xs[0]} + {xs[1]}) / 2" if how == "mean" else f"greatest({', '.join(xs)})"
        cases.append(f"WHEN {has(col, pattern)} THEN {one} * {unit}")
    return f"CASE {' '.join(cases)} END"


def density(col: str) -> str:
    return (
        f"CASE WHEN {has(col, P.PART_SOLID)} THEN 'part_solid' WHEN {has(col, P.GROUND_GLASS)} THEN 'ground_glass' "
        f"WHEN {has(col, P.CALCIFIED)} AND NOT {has(col, P.NOT_CALCIFIED)} THEN 'calcified' WHEN {has(col, P.SOLID)} AND NOT {has(col, P.NOT_SOLID)} THEN 'solid' "
        f"WHEN length({col}) > 0 THEN 'unclear' END"
    )


def location(col: str) -> str:
    return first_of(col, P.LOCATIONS)


def change(col: str) -> str:
    return first_of(col, P.CHANGES)


def sentences(col: str) -> str:
    marked = rf"regexp_replace(regexp_replace({col}, '([.!?;])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"


_HEAD = r"(?im)^\s*(" + "|".join(P.HEADERS) + r")\s*(?::\s*|\n+)"
_PARTS = rf"list_filter(string_split(regexp_replace(text, {q(_HEAD)}, chr(1) || '\1' || chr(2), 'g'), chr(1)), lambda p: contains(p, chr(2)))"


def _section(key: str) -> str:
    mine = rf"list_filter(parts, lambda p: regexp_replace(lower(split_part(p, chr(2), 1)), '\(s\)', '') = {q(key)})"
    return f"nullif(trim(split_part({mine}[-1], chr(2), 2), ' ' || chr(9) || chr(10) || chr(13)), '')"


SECTIONS = f"""sections AS (SELECT note_id, subject_id, ordinal, exam, text, {', '.join(f'{_section(s)} AS {s}' for s in P.SECTIONS if s != 'impression')},
 coalesce({_section('impression')}, {_section('recommendation')}) AS impression FROM (SELECT *, {_PARTS} AS parts FROM notes) x)"""
NOTES_CTE = f"notes AS ({NOTES_SQL})"


def _mentions(source: str, name: str) -> str:
    """Sessions of sentences: a start opens, a sentence that goes on extends, any other closes."""
    return f"""{name}_s AS (SELECT note_id, i, ss[i] AS s FROM (SELECT note_id, {sentences(f"coalesce({source}, '')")} AS ss FROM sections) a, unnest(range(1, len(ss) + 1)) t(i)),
 {name}_f AS (SELECT *, CASE WHEN {has('s', P.MENTION_START)} THEN 1 ELSE 0 END AS st, CASE WHEN {has('s', P.MENTION_GOES_ON)} THEN 1 ELSE 0 END AS go FROM {name}_s),
 {name}_g AS (SELECT *, sum(st) OVER (PARTITION BY note_id ORDER BY i) AS g FROM {name}_f),
 {name}_b AS (SELECT *, sum(CASE WHEN st = 0 AND go = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY note_id, g ORDER BY i) AS broke FROM {name}_g WHERE g > 0),
 {name} AS (SELECT note_id, g AS k, string_agg(s, ' ' ORDER BY i) AS mention FROM {name}_b WHERE broke = 0 GROUP BY note_id, g)"""


MENTIONS = f"{NOTES_CTE}, {SECTIONS}, {_mentions('findings', 'mf')}, {_mentions('impression', 'mi')}"
CUE = f"nullif(array_to_string(list_filter({sentences('both_text')}, lambda s: {has('s', P.CUE)}), ' '), '')"
NODULES = f"""{MENTIONS}, chosen AS (SELECT * FROM mf UNION ALL SELECT * FROM mi WHERE note_id NOT IN (SELECT note_id FROM mf)),
 counted AS (SELECT c.*, count(*) OVER (PARTITION BY c.note_id) AS n, s.subject_id, s.ordinal, concat(coalesce(s.impression, ''), ' ', s.text) AS both_text FROM chosen c JOIN sections s USING (note_id)),
 nodules AS (SELECT note_id, subject_id, ordinal, k, n, mention, {size('mention')} AS size_mm, {density('mention')} AS density_category, {location('mention')} AS location_lobe, {change('mention')} AS change_status,
  {CUE} AS cue, upper({group('both_text', P.LUNG_RADS, 1)}) AS rads FROM counted)"""


def _bounds(row: tuple) -> str:
    d, new, low, high, part = row[:5]
    tests = [f"density = {q(d)}"]
    if new is not None:
        tests.append("is_new" if new else "NOT is_new")
    if low:
        tests.append(f"size_mm >= {low}")
    if high != float("inf"):
        tests.append(f"size_mm < {high}")
    if part == "missing":
        tests.append("component IS NULL")
    elif part:
        tests.append(f"component >= {part[0]}")
        if part[1] != float("inf"):
            tests.append(f"component < {part[1]}")
    return " AND ".join(tests)


def _when(k: int) -> str:
    return "CASE " + " ".join(f"WHEN {_bounds(r)} THEN {q(r[k])}" for r in THRESHOLDS) + " END"


_STABLE = f"change_status = 'stable' AND {has('mention', P.TWO_YEARS)}"
_UP = "CASE base " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in STEP_UP.items()) + " END"
EVALUATED = f"""{NODULES}, facts AS (SELECT *, CASE WHEN density_category IN ('solid', 'part_solid', 'ground_glass', 'calcified', 'fat_containing') THEN density_category ELSE 'solid' END AS density,
  coalesce(change_status = 'new', false) AS is_new, try_cast(coalesce({group('mention', P.SOLID_COMPONENT, 1)}, {group('cue', P.SOLID_COMPONENT, 1)}) AS DOUBLE) AS component FROM nodules),
 based AS (SELECT *, CASE WHEN size_mm IS NULL THEN NULL ELSE {_when(5)} END AS base, CASE WHEN size_mm IS NULL THEN 'fallback_missing_size' ELSE {_when(6)} END AS rule FROM facts),
 evaluated AS (SELECT *, CASE WHEN base IN ('3', '4A') AND {_STABLE} THEN '2' WHEN change_status = 'increased' AND base IN ('2', '3', '4A') THEN {_UP} ELSE base END AS category FROM based),
 severe AS (SELECT *, coalesce(CASE category WHEN '2' THEN 2 WHEN '3' THEN 3 WHEN '4A' THEN 4 WHEN '4B' THEN 5 END, -1) AS severity FROM evaluated)"""
LEVEL = """CASE WHEN category = '2' THEN 'routine_screening' WHEN category = '3' THEN 'short_interval_followup' WHEN category = '4A' AND is_new THEN 'diagnostic_workup'
 WHEN category = '4A' THEN 'short_interval_followup' WHEN category = '4B' THEN 'tissue_sampling' ELSE 'insufficient_data' END"""
INTERVAL = "CASE category WHEN '2' THEN '12_months' WHEN '3' THEN '6_months' WHEN '4A' THEN '3_months' WHEN '4B' THEN 'immediate' END"

DETAILS_CTE = f"details AS ({DETAILS_SQL})"
SOCIAL = f"""discharge AS ({DISCHARGE_SQL}),
 social AS (SELECT *, regexp_matches(text, '(?im)^\\s*social history\\s*:\\s*') AS has_section,
  nullif(trim(split_part(split_part(regexp_replace(regexp_replace(text, '(?im)^\\s*social history\\s*:\\s*', chr(1)), {q('(?im)^' + chr(92) + 's*(?:' + P.AFTER_SOCIAL + ')' + chr(92) + 's*:' + chr(92) + 's*')}, chr(2), 'g'), chr(1), 2), chr(2), 1), ' ' || chr(9) || chr(10) || chr(13)), '') AS body FROM discharge)"""
