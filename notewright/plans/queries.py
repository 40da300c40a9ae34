"""The library's queries, each with SQL that another engine can check it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import adapter, audit, bundles, graph, metrics, radiology, rules, sampling, smoking, validation, weak
from ..session import written
from . import sqltext as S
from .notes import LINES_SQL, details, discharge, lines, notes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _chest(spark, sf):
    n = notes(spark, sf)
    return n.withColumnRenamed("exam", "exam_name")


def _facts_once(spark, sf, *fields, then=None):
    """The notes' keys with nodule_count and these fields of their nodules."""
    return radiology.facts_once(_chest(spark, sf), fields=fields, then=then)


# filters and joins


@query(f"""WITH {S.DETAILS_CTE}, f AS (SELECT note_id, arg_min(field_value, ordinal) AS exam_name FROM details WHERE lower(field_name) = 'exam_name' AND {S.has('field_value', P.CHEST_CT)} GROUP BY note_id),
 {S.NOTES_CTE} SELECT note_id, subject_id, exam_name FROM notes JOIN f USING (note_id)""")
def exam_filter_join(spark, sf):
    return radiology.chest_ct(notes(spark, sf).drop("exam", "text"), details(spark, sf)).select("note_id", "subject_id", "exam_name")


@query(rf"""WITH {S.NOTES_CTE}, p AS (SELECT note_id, string_split(regexp_replace(text, '(?i){P.NODULE}', chr(1) || '\0' || chr(1), 'g'), chr(1)) AS ps FROM notes),
 t AS (SELECT note_id, right(array_to_string(ps[1:2 * k - 1], ''), 20) AS tail FROM p, unnest(range(1, (len(ps) - 1) // 2 + 1)) u(k))
 SELECT DISTINCT note_id FROM t WHERE NOT regexp_matches(tail, '(?i){P.NEGATED_BEFORE}')""")
def nodule_filter_negation(spark, sf):
    return radiology.with_nodule(notes(spark, sf)).select("note_id")


@query(f"WITH {S.NOTES_CTE}, d AS ({S.DISCHARGE_SQL}) SELECT note_id, subject_id FROM d WHERE subject_id IN (SELECT subject_id FROM notes WHERE exam LIKE 'CTA%')")
def subject_semi_join(spark, sf):
    keep = notes(spark, sf).filter(F.col("exam").startswith("CTA")).select("subject_id")
    return discharge(spark, sf).join(keep, "subject_id", "left_semi").select("note_id", "subject_id")


# text


@query(f"WITH {S.NOTES_CTE}, {S.SECTIONS} SELECT note_id, indication, technique, comparison, findings, impression FROM sections")
def sections_parse(spark, sf):
    return notes(spark, sf).select("note_id", T.sections(F.col("text")).alias("s")).select("note_id", "s.*")


@query(f"WITH {S.MENTIONS} SELECT note_id, k, mention FROM mf")
def mentions_segment(spark, sf):
    s = notes(spark, sf).select("note_id", T.sections(F.col("text")).alias("s"))
    return s.select("note_id", F.posexplode(T.mentions(F.col("s.findings"))).alias("k", "mention")).withColumn("k", (F.col("k") + 1).cast("long"))


@query(f"WITH {S.NOTES_CTE} SELECT note_id, {S.size('text')} AS size_mm FROM notes")
def size_extract(spark, sf):
    return notes(spark, sf).select("note_id", T.size(F.col("text"))["value"].alias("size_mm"))


@query(f"WITH {S.NOTES_CTE} SELECT note_id, {S.density('text')} AS density FROM notes")
def density_extract(spark, sf):
    return notes(spark, sf).select("note_id", T.density(F.col("text"))["value"].alias("density"))


@query(f"WITH {S.NOTES_CTE} SELECT note_id, {S.location('text')} AS location, {S.first_of('text', P.LOCATIONS, True)} AS span FROM notes")
def location_extract(spark, sf):
    return notes(spark, sf).select("note_id", T.location(F.col("text")).alias("l")).select("note_id", F.col("l.value").alias("location"), "l.span")


@query(f"WITH {S.NOTES_CTE} SELECT note_id, {S.change('text')} AS change FROM notes")
def change_status(spark, sf):
    return notes(spark, sf).select("note_id", T.change(F.col("text"))["value"].alias("change"))


@query(f"WITH {S.NOTES_CTE} SELECT note_id, {S.has('text', P.CALCIFIED)} AND NOT {S.has('text', P.NOT_CALCIFIED)} AS calcification, {', '.join(f'{S.has("text", p)} AS {k}' for k, p in P.MORPHOLOGY)} FROM notes")
def morphology_flags(spark, sf):
    return notes(spark, sf).select("note_id", T.morphology(F.col("text")).alias("m")).select("note_id", "m.*")


@query(f"""WITH {S.NOTES_CTE} SELECT DISTINCT exam, CASE WHEN contains(lower(exam), 'low dose') THEN 'LDCT' WHEN {S.has('exam', r'\bcta\b')} THEN 'CTA' WHEN {S.has('exam', r'\b(mr|mri)\b')} THEN 'MRI'
 WHEN {S.has('exam', r'\bct\b')} THEN 'CT' ELSE 'other' END AS modality, CASE WHEN {S.has('exam', r'\b(chest|lung|thorax)\b')} THEN 'chest' WHEN {S.has('exam', r'\b(abd|abdomen)\b')} AND {S.has('exam', 'pelvis')} THEN 'chest_abdomen_pelvis' ELSE 'other' END AS body_site FROM notes""")
def modality_body_site(spark, sf):
    return notes(spark, sf).select("exam").distinct().select("exam", T.modality(F.col("exam")).alias("modality"), T.body_site(F.col("exam")).alias("body_site"))


@query(f"WITH {S.NOTES_CTE}, x AS (SELECT note_id, text AS both_text FROM notes) SELECT note_id, {S.CUE} AS cue FROM x")
def recommendation_cue(spark, sf):
    return notes(spark, sf).select("note_id", T.cue(F.col("text")).alias("cue"))


@query(f"WITH {S.NOTES_CTE} SELECT note_id, upper({S.group('text', P.LUNG_RADS, 1)}) AS category FROM notes")
def lung_rads_extract(spark, sf):
    return notes(spark, sf).select("note_id", T.lung_rads(F.col("text")).alias("category"))


@query(f"""WITH {S.NODULES} SELECT note_id, k, size_mm, density_category, location_lobe, change_status, rads, cue,
 CASE (size_mm IS NOT NULL)::INT + coalesce(density_category <> 'unclear', false)::INT + coalesce(location_lobe <> 'unclear', false)::INT WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence,
 CASE WHEN n = 1 THEN 'single' ELSE 'multiple' END AS count_type, mention AS evidence FROM nodules""")
def radiology_facts(spark, sf):
    m = radiology.mentions_once(_chest(spark, sf).select("note_id", "text"))
    return m.select("note_id", F.col("nodule_id_in_report").cast("long").alias("k"), "size_mm", "density_category", "location_lobe", "change_status", F.col("lung_rads_category").alias("rads"), F.col("recommendation_cue").alias("cue"), "confidence", "count_type", F.col("evidence_span").alias("evidence"))


@query(f"""WITH {S.NODULES} SELECT flag, count(*) AS n FROM (SELECT unnest([CASE WHEN size_mm IS NULL THEN 'size_mm' END, CASE WHEN location_lobe IS NULL THEN 'location_lobe' END,
 CASE WHEN change_status IS NULL THEN 'change_status' END, CASE WHEN rads IS NULL THEN 'lung_rads_category' END, CASE WHEN cue IS NULL THEN 'recommendation_cue' END]) AS flag FROM nodules) WHERE flag IS NOT NULL GROUP BY flag""")
def missing_flags(spark, sf):
    m = radiology.mentions_once(_chest(spark, sf).select("note_id", "text")).select(F.explode("missing_flags").alias("flag"))
    return m.filter(~F.col("flag").isin("size_text", "density_text", "location_text", "change_text")).groupBy("flag").agg(F.count("*").alias("n"))


@query(f"""WITH {S.MENTIONS}, u AS (SELECT note_id, 1 AS s, 'findings' AS section, k, mention FROM mf UNION ALL SELECT note_id, 2, 'impression', k, mention FROM mi)
 SELECT concat(note_id, '__', row_number() OVER (PARTITION BY note_id ORDER BY s, k)) AS sample_id, section, mention AS mention_text, {S.density('mention')} AS density_label, {S.size('mention')} IS NOT NULL AS has_size, coalesce({S.location('mention')}, 'no_location') AS location_label FROM u""")
def mention_numbering(spark, sf):
    return radiology.numbered_mentions(_chest(spark, sf)).select("sample_id", "section", "mention_text", "density_label", "has_size", "location_label")


# smoking


@query(f"WITH {S.SOCIAL} SELECT note_id, has_section, body FROM social")
def social_history(spark, sf):
    return discharge(spark, sf).select("note_id", T.has_social_history(F.col("text")).alias("has_section"), T.social_history(F.col("text")).alias("body"))


_STATUS = "CASE WHEN body IS NULL OR regexp_matches(body, '^[_\\s\\-*.]+$') THEN 'unknown' " + " ".join(
    [f"WHEN {S.has('body', p)} THEN 'never_smoker'" for p in P.NEVER]
    + [f"WHEN {S.has('body', p)} THEN 'former_smoker'" for p in P.FORMER]
    + [f"WHEN {S.has('body', p)} AND NOT {S.has('body', P.NOT_CURRENT)} THEN 'current_smoker'" for p in P.CURRENT]
    + [f"WHEN {S.has('body', P.TOBACCO_USE)} THEN 'current_smoker' ELSE 'unknown' END"]
)


@query(f"WITH {S.SOCIAL} SELECT note_id, {_STATUS} AS status FROM social")
def smoking_status(spark, sf):
    s = discharge(spark, sf).select("note_id", T.social_history(F.col("text")).alias("s"))
    return s.select("note_id", T.smoking_status(F.col("s"))["value"].alias("status"))


_PACKS = f"coalesce(try_cast({S.group('body', P.PACK_YEARS, 1)} AS DOUBLE), try_cast({S.group('body', P.PPD_TIMES_YEARS, 1)} AS DOUBLE) * try_cast({S.group('body', P.PPD_TIMES_YEARS, 2)} AS DOUBLE))"


@query(f"WITH {S.SOCIAL} SELECT note_id, {_PACKS} AS pack_years, try_cast({S.group('body', P.QUIT_YEARS, 1)} AS DOUBLE) AS quit_years FROM social")
def pack_years(spark, sf):
    s = discharge(spark, sf).select("note_id", T.social_history(F.col("text")).alias("s"))
    return s.select("note_id", T.pack_years(F.col("s"))["value"].alias("pack_years"), T.quit_years(F.col("s"))["value"].alias("quit_years"))


@query(f"""WITH {S.SOCIAL}, e AS (SELECT note_id, {_STATUS} AS status, {_PACKS} AS py, try_cast({S.group('body', P.QUIT_YEARS, 1)} AS DOUBLE) AS qy FROM social)
 SELECT note_id, CASE WHEN status = 'never_smoker' THEN 'not_eligible' WHEN status = 'unknown' THEN 'unknown' WHEN py IS NULL OR (status = 'former_smoker' AND qy IS NULL) THEN 'unknown'
 WHEN py >= 20 AND (status = 'current_smoker' OR qy <= 15) THEN 'eligible' ELSE 'not_eligible' END AS eligibility FROM e""")
def eligibility(spark, sf):
    s = discharge(spark, sf).select("note_id", T.social_history(F.col("text")).alias("s"))
    s = s.select("note_id", T.smoking_status(F.col("s"))["value"].alias("st"), T.pack_years(F.col("s"))["value"].alias("py"), T.quit_years(F.col("s"))["value"].alias("qy"))
    return s.select("note_id", smoking.eligibility(F.col("st"), F.col("py"), F.col("qy"))["value"].alias("eligibility"))


# rules, graph, bundles


def _case_rows(spark, sf):
    m = radiology.mentions_once(_chest(spark, sf).select("note_id", "subject_id", "exam_name", "text"))
    return m.withColumn("case_id", F.col("subject_id")).withColumn("ordinal", F.regexp_extract("note_id", r"(\d+)$", 1).cast("long") * 100 + F.col("nodule_id_in_report"))


def _cases(spark, sf):
    return notes(spark, sf).select(F.col("subject_id").alias("case_id")).distinct().withColumn("smoking_eligible", F.lit(None).cast("string"))


def _case_rows_once(spark, sf):
    """_case_rows with what rules and graph ask for, and _cases of them, written so that notes are read once for both."""
    columns = ("case_id", "ordinal", "size_mm", "density_category", "density_text", "change_status", "change_text", "evidence_span", "recommendation_cue", "confidence")
    return written(_case_rows(spark, sf).select(*columns), "case-rows"), _cases(spark, sf)


_TOP = "row_number() OVER (PARTITION BY subject_id ORDER BY severity DESC, coalesce(size_mm, -1) DESC, ordinal, k) AS r"


@query(f"""WITH {S.EVALUATED}, top AS (SELECT * FROM (SELECT *, {_TOP} FROM severe) x WHERE r = 1), c AS (SELECT DISTINCT subject_id FROM notes)
 SELECT c.subject_id AS case_id, CASE WHEN size_mm IS NULL THEN 'insufficient_data' ELSE {S.LEVEL} END AS recommendation_level, {S.INTERVAL} AS followup_interval, category AS lung_rads_category, size_mm FROM c LEFT JOIN top USING (subject_id)""")
def flat_recommendation(spark, sf):
    r = rules.recommend(_case_rows(spark, sf), _cases(spark, sf))
    return r.select("case_id", "recommendation_level", "followup_interval", "lung_rads_category", F.col("input_facts_used.nodule_size_mm").alias("size_mm"))


@query(f"WITH {S.EVALUATED} SELECT note_id, k, density, category, rule, severity::BIGINT AS severity FROM severe")
def flat_rules(spark, sf):
    e = radiology.mentions_once(notes(spark, sf).select("note_id", "text"), then=rules.evaluate)
    return e.select("note_id", F.col("nodule_id_in_report").cast("long").alias("k"), "density", "category", F.try_element_at("triggered_rules", F.lit(1)).alias("rule"), F.col("severity").cast("long").alias("severity"))


_GRAPH = f"""{S.EVALUATED}, gr AS (SELECT *, CASE WHEN size_mm IS NULL THEN 'missing_nodule_size' WHEN density_category IS NULL OR density_category = 'unclear' THEN 'missing_nodule_density' END AS why FROM severe),
 gt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY (why IS NULL) DESC, CASE WHEN why IS NULL THEN severity ELSE (why = 'missing_nodule_density')::INT END DESC,
  coalesce(nullif(size_mm, 0), -1) DESC, ordinal, k) AS r FROM gr) x WHERE r = 1), c AS (SELECT DISTINCT subject_id FROM notes),
 gres AS (SELECT c.subject_id AS case_id, CASE WHEN gt.subject_id IS NULL THEN 'no_structured_nodule' ELSE why END AS abstention_reason, CASE WHEN why IS NULL THEN category END AS lung_rads_category FROM c LEFT JOIN gt USING (subject_id))"""


@query(f"WITH {_GRAPH} SELECT case_id, abstention_reason, lung_rads_category, abstention_reason IS NOT NULL AS abstained FROM gres")
def graph_recommendation(spark, sf):
    return graph.execute(_case_rows(spark, sf), _cases(spark, sf)).select("case_id", "abstention_reason", "lung_rads_category", "abstained")


@query(f"""WITH {_GRAPH}, top AS (SELECT * FROM (SELECT *, {_TOP} FROM severe) x WHERE r = 1), both_r AS (SELECT g.*, t.category AS flat FROM gres g LEFT JOIN top t ON t.subject_id = g.case_id)
 SELECT count(*) AS cases, count(*) FILTER (WHERE abstention_reason IS NULL) AS actionable, count(*) FILTER (WHERE lung_rads_category IS NOT DISTINCT FROM flat) AS same, count(*) FILTER (WHERE abstention_reason IS NULL AND lung_rads_category = flat) AS same_actionable FROM both_r""")
def graph_vs_flat(spark, sf):
    rows, cases = _case_rows_once(spark, sf)
    g = graph.execute(rows, cases).select("case_id", "abstention_reason", "lung_rads_category", "abstained")
    f = rules.recommend(rows, cases).select("case_id", F.col("lung_rads_category").alias("flat"))
    j = g.join(f, "case_id")
    same = F.col("lung_rads_category").eqNullSafe(F.col("flat"))
    return j.agg(F.count("*").alias("cases"), F.count_if(~F.col("abstained")).alias("actionable"), F.count_if(same).alias("same"), F.count_if(~F.col("abstained") & same).alias("same_actionable"))


@query(f"WITH {_GRAPH} SELECT coalesce(abstention_reason, 'none') AS reason, count(*) AS n FROM gres GROUP BY 1")
def abstention_counts(spark, sf):
    return graph_recommendation(spark, sf).groupBy(F.coalesce("abstention_reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


def _smoking_first(spark, sf):
    """Smoking facts of each subject's first discharge note, which alone is read."""
    return smoking.smoking_facts(bundles.first_per_subject(discharge(spark, sf)))


def _bundles(spark, sf, *more):
    # texts and sections are in the notes: bundles are gathered by subject without them, and with the fields of nodules that are asked for
    f = _facts_once(spark, sf, "size_mm", "density_category", "confidence", "recommendation_cue", *more)
    smoke = _smoking_first(spark, sf)
    who = _table(spark, sf, "customer").select(F.col("c_custkey").alias("subject_id"), F.lit(None).cast("int").alias("age"), F.when(F.col("c_custkey") % 2 == 0, "male").otherwise("F").alias("sex"), F.lit(None).cast("string").alias("race"), F.col("c_mktsegment").alias("insurance"), F.lit("customer").alias("source"))
    return bundles.assemble(f, smoke, who)


@query(f"""WITH {S.NOTES_CTE} SELECT count(*) AS rows, count(*) FILTER (WHERE NOT regexp_matches(note_id, '^\\d+-RR-\\d+$')) AS bad_ids, count(*) FILTER (WHERE exam LIKE 'MR%') AS not_ct FROM notes""")
def fact_validation(spark, sf):
    n = notes(spark, sf).withColumn("modality", T.modality(F.col("exam")))
    checked = validation.validate(n, [validation.matching("note_id", r"^\d+-RR-\d+$"), validation.one_of("modality", ["CT", "CTA", "LDCT"])])
    of = lambda p: F.count_if(F.exists("errors", lambda e: e.startswith(p)))
    return checked.agg(F.count("*").alias("rows"), of("note_id").alias("bad_ids"), of("modality").alias("not_ct"))


# weak supervision


def _labelled(spark, sf, task, then=lambda rows: rows):
    """Mentions with lf_details and what then adds to them; each text is labelled once."""
    per_note = {"impression_density": weak.impression_density} if task == "density" else None
    return radiology.numbered_once(_chest(spark, sf), per_note=per_note, then=lambda m: then(weak.label_rows(m.withColumn("label_quality", F.lit("explicit")), task)))


def _with_labels(rows):
    return rows.select("keys", "k", _labels_joined())


def _labels_joined():
    return F.array_join(F.transform("lf_details", lambda x: F.coalesce(x["label"], F.lit("-"))), "|").alias("labels")


_SAMPLES = f"""{S.MENTIONS}, u AS (SELECT note_id, 1 AS s, 'findings' AS section, k, mention FROM mf UNION ALL SELECT note_id, 2, 'impression', k, mention FROM mi),
 samples AS (SELECT concat(u.note_id, '__', row_number() OVER (PARTITION BY u.note_id ORDER BY s, k)) AS sample_id, u.note_id, section, mention AS m,
  concat_ws(chr(10) || chr(10), 'FINDINGS: ' || x.findings, 'IMPRESSION: ' || x.impression) AS full_text FROM u JOIN sections x USING (note_id))"""
_S1 = " OR ".join(S.has("m", p) for _, p, _, _ in P.SIZES_STRICT)
_S2 = " OR ".join(S.has("m", p) for p in P.LF_SIZE_TYPOS)
_TF = lambda t: f"CASE WHEN {t} THEN 'true' ELSE '-' END"
_SIZE_LABELS = f"""concat_ws('|', {_TF(_S1)}, {_TF(_S2)}, {_TF(S.has('m', P.LF_NUMBER) + ' AND ' + S.has('m', P.LF_SIZE_CONTEXT))}, {_TF(S.has('m', P.LF_SIZE_WORDS))},
 CASE WHEN NOT regexp_matches(m, '\\d') AND NOT {S.has('m', P.LF_SIZE_WORDS)} AND NOT {S.has('m', P.LF_SIZE_CONTEXT)} THEN 'false' ELSE '-' END)"""


@query(f"WITH {_SAMPLES} SELECT sample_id, {_SIZE_LABELS} AS labels FROM samples")
def lf_size(spark, sf):
    return _labelled(spark, sf, "size", _with_labels).select("sample_id", "labels")


_LOBE_AT = [f"CASE WHEN {S.has('m', p)} THEN {{{{'p0': length(regexp_extract(m, '(?is)^(.*?)(?:{p})', 1)), 'label': '{label}', 'side': '{side}'}}}} END".replace("{{", "{").replace("}}", "}") for p, label, side in P.LOBES]
_LOBE_LIST = f"list_sort(list_filter([{', '.join(_LOBE_AT)}], lambda x: x IS NOT NULL))"
_ANY_LOBE = " OR ".join(S.has("m", p) for p, _, _ in P.LOBES)


@query(f"""WITH {_SAMPLES}, lo AS (SELECT *, {_LOBE_LIST} AS lobes, {S.first_of('m', P.LF_LOCATIONS)} AS l1, position(lower(m) IN lower(full_text)) AS pos0 FROM samples),
 lc AS (SELECT *, concat(substring(full_text, greatest(pos0 - 200, 1)::INT, least(pos0 - 1, 200)::INT), substring(full_text, (pos0 + length(m))::INT, 200)) AS around FROM lo)
 SELECT sample_id, concat_ws('|', coalesce(l1, '-'), CASE WHEN len(lobes) <= 1 THEN '-' WHEN len(list_distinct(list_transform(lobes, lambda x: x.side))) >= 2 THEN 'bilateral' ELSE lobes[1].label END,
 CASE WHEN {' OR '.join(S.has('m', p) for p in P.LF_BILATERAL)} THEN 'bilateral' ELSE '-' END, CASE WHEN NOT ({_ANY_LOBE}) AND ({' OR '.join(S.has('m', p) for p in P.LF_SIDES)}) THEN 'unclear' ELSE '-' END,
 CASE WHEN l1 IS NULL AND pos0 > 0 THEN coalesce({S.first_of('around', P.LF_LOCATIONS)}, '-') ELSE '-' END) AS labels FROM lc""")
def lf_location(spark, sf):
    return _labelled(spark, sf, "location", _with_labels).select("sample_id", "labels")


def _density_sql(col: str, rules_) -> str:
    rank = ("part_solid", "ground_glass", "calcified", "solid")
    lone = rf"regexp_replace({col}, '(?i){P.LF_PART_SOLID_SPAN}', chr(1), 'g')"
    return "CASE " + " ".join(f"WHEN {S.has(lone if p == P.SOLID else col, p)} THEN {S.q(v)}" for v, p in sorted(rules_, key=lambda r: rank.index(r[0]))) + " END"


_D3 = " OR ".join(S.has("m", rf"\b{n.replace(' ', chr(92) + 's+')}\b(?:\W+\w+){{0,3}}\W+{P.LF_DENSITY_WORD}") for n in P.LF_NEGATORS) + f" OR {S.has('m', P.LF_NONCALCIFIED)}"
_D4 = "len(list_distinct(list_filter([" + ", ".join(
    f"CASE WHEN {S.has(rf'regexp_replace(m, {S.q("(?i)" + P.LF_PART_SOLID_SPAN)}, chr(1), {S.q("g")})' if p == P.SOLID else 'm', p)} THEN {S.q(v)} END" for v, p in P.LF_PRIMARY + P.LF_FUZZY
) + "], lambda x: x IS NOT NULL))) >= 2"
_IMPRESSION = f"list_filter({S.sentences(chr(114) + 'egexp_extract(full_text, ' + S.q(r'(?is)IMPRESSION' + chr(92) + 's*:' + chr(92) + 's*(.*)') + ', 1)')}, lambda s: {S.has('s', P.LF_MENTION)})"


@query(f"""WITH {_SAMPLES}, dn AS (SELECT *, {_IMPRESSION} AS imp FROM samples),
 de AS (SELECT *, list_filter(list_transform(imp, lambda s: {_density_sql('s', P.LF_PRIMARY)}), lambda x: x IS NOT NULL)[1] AS d5 FROM dn)
 SELECT sample_id, concat_ws('|', coalesce({_density_sql('m', P.LF_PRIMARY)}, '-'), coalesce({_density_sql('m', P.LF_FUZZY)}, '-'), CASE WHEN {_D3} THEN 'unclear' ELSE '-' END, CASE WHEN {_D4} THEN 'unclear' ELSE '-' END,
 CASE WHEN section = 'findings' THEN coalesce(d5, '-') ELSE '-' END) AS labels FROM de""")
def lf_density(spark, sf):
    return _labelled(spark, sf, "density", _with_labels).select("sample_id", "labels")


_LF_ROWS = f"({LINES_SQL}) AS li, unnest([1, 2, 3, 4, 5]) t(i)"
_ABC = "CASE (l_partkey + i * l_linenumber) % 4 WHEN 0 THEN NULL WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'c' END"
_CONF = "CASE i WHEN 1 THEN 1.0 WHEN 2 THEN 0.75 WHEN 3 THEN 0.5 WHEN 4 THEN 0.75 ELSE 0.25 END::DOUBLE"
_WEIGHT = "CASE i WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 WHEN 3 THEN 0.25 WHEN 4 THEN 0.5 ELSE 1.0 END::DOUBLE"
_VOTE_W = {"L1": 1.0, "L2": 0.5, "L3": 0.25, "L4": 0.5, "L5": 1.0}


def _vote_rows(spark, sf):
    """Votes of five functions on every order line, by arithmetic on its keys."""
    conf = (1.0, 0.75, 0.5, 0.75, 0.25)
    label = lambda i: F.when((F.col("l_partkey") + i * F.col("l_linenumber")) % 4 == 1, "a").when((F.col("l_partkey") + i * F.col("l_linenumber")) % 4 == 2, "b").when((F.col("l_partkey") + i * F.col("l_linenumber")) % 4 == 3, "c")
    one = lambda i: F.struct(F.lit(f"L{i}").alias("lf_name"), label(i).alias("label"), F.when(label(i).isNull(), 0.0).otherwise(conf[i - 1]).alias("confidence"), label(i).alias("evidence_span"))
    return lines(spark, sf).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.array(*[one(i) for i in range(1, 6)]).alias("lf_details"))


def _vote_sql(weight: str, only: str = "true") -> str:
    return f"""v AS (SELECT l_orderkey * 10 + l_linenumber AS id, i, {_ABC} AS label, {_CONF} * {weight} AS score FROM {_LF_ROWS}),
 a AS (SELECT id, label, sum(score) AS score, min(i) AS first, count(*) AS n FROM v WHERE label IS NOT NULL AND {only} GROUP BY id, label),
 b AS (SELECT *, sum(score) OVER (PARTITION BY id) AS total, sum(n) OVER (PARTITION BY id) AS cov, row_number() OVER (PARTITION BY id ORDER BY score DESC, first) AS r FROM a),
 w AS (SELECT d.id, coalesce(label, '{P.ABSTAIN}') AS label, coalesce(score / total, 0) AS conf, coalesce(cov, 0)::BIGINT AS cov, coalesce(n / cov, 0) AS agr FROM (SELECT DISTINCT id FROM v) d LEFT JOIN (SELECT * FROM b WHERE r = 1) b USING (id))"""


def _vote_columns(rows):
    return rows.select("id", F.col("ws_label").alias("label"), F.round("ws_confidence", 4).alias("conf"), F.col("lf_coverage").cast("long").alias("cov"), F.round("lf_agreement", 4).alias("agr"))


_VOTE_OUT = "SELECT id, label, round(conf, 4) AS conf, cov, round(agr, 4) AS agr FROM w"


@query(f"WITH {_vote_sql(_WEIGHT)} {_VOTE_OUT}")
def vote(spark, sf):
    return _vote_columns(weak.aggregate_votes(_vote_rows(spark, sf), "x", weights=_VOTE_W))


@query(f"WITH {_vote_sql('1.0')} {_VOTE_OUT}")
def vote_uniform(spark, sf):
    return _vote_columns(weak.aggregate_votes(_vote_rows(spark, sf), "x", uniform=True))


@query(f"WITH {_vote_sql('1.0', 'i IN (1, 3)')} {_VOTE_OUT}")
def vote_two_sources(spark, sf):
    return _vote_columns(weak.aggregate_votes(_vote_rows(spark, sf), "x", uniform=True, sources=["L1", "L3"]))


_PASS = {g: f"label <> '{P.ABSTAIN}' AND conf >= {c} AND cov >= {n} AND agr >= {a}" for g, c, n, a in P.GATES}


@query(f"""WITH {_vote_sql(_WEIGHT)}, g AS (SELECT id, concat_ws('|', {', '.join(f"CASE WHEN {t} THEN '{k}' END" for k, t in _PASS.items())}) AS passed FROM w)
 SELECT id, passed, coalesce(nullif(string_split(passed, '|')[-1], ''), 'REJECTED') AS gate_level FROM g""")
def gates(spark, sf):
    return weak.aggregate_votes(_vote_rows(spark, sf), "x", weights=_VOTE_W).select("id", F.array_join("passed_gates", "|").alias("passed"), "gate_level")


@query(f"WITH {_vote_sql(_WEIGHT)} " + " UNION ALL ".join(f"SELECT '{k}' AS gate, count(*) FILTER (WHERE {t}) AS kept, round(count(*) FILTER (WHERE {t}) / count(*), 6) AS retention FROM w" for k, t in _PASS.items()))
def gate_retention(spark, sf):
    return weak.gate_retention(weak.aggregate_votes(_vote_rows(spark, sf), "x", weights=_VOTE_W)).withColumn("retention", F.round("retention", 6))


@query(f"SELECT concat('L', i) AS lf_name, count(*) AS rows, count({_ABC}) AS fired, round(count({_ABC}) / count(*), 6) AS rate FROM {_LF_ROWS} GROUP BY i")
def lf_coverage(spark, sf):
    return weak.lf_coverage(_vote_rows(spark, sf)).withColumn("rate", F.round("rate", 6))


@query(f"""WITH v AS (SELECT l_orderkey * 10 + l_linenumber AS id, i, {_ABC} AS label FROM {_LF_ROWS})
 SELECT concat('L', x.i) AS lf_a, concat('L', y.i) AS lf_b, count(*) AS overlap, count(*) FILTER (WHERE x.label = y.label) AS agree FROM v x JOIN v y ON x.id = y.id AND x.i < y.i WHERE x.label IS NOT NULL AND y.label IS NOT NULL GROUP BY x.i, y.i""")
def lf_pairwise_overlap(spark, sf):
    return weak.lf_overlap(_vote_rows(spark, sf))


@query(f"WITH v AS (SELECT l_orderkey * 10 + l_linenumber AS id, count(DISTINCT {_ABC}) AS d FROM {_LF_ROWS} GROUP BY 1) SELECT count(*) AS rows, count(*) FILTER (WHERE d > 1) AS conflicts FROM v")
def lf_conflicts(spark, sf):
    return weak.conflict_count(_vote_rows(spark, sf))


# metrics over order lines: truth, prediction and score by arithmetic

_PRED = "CASE WHEN (l_partkey + l_linenumber) % 3 = 0 THEN 'A' WHEN (l_partkey + l_linenumber) % 3 = 1 THEN l_returnflag ELSE 'N' END"
_EVAL = f"e AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS truth, {_PRED} AS pred, l_linestatus AS third, (l_partkey % 1000) / 1000.0::DOUBLE AS score, l_returnflag = 'R' AS pos, l_quantity AS x, l_quantity + (l_linenumber % 3) AS y, l_shipdate FROM lineitem)"


def _evals(spark, sf):
    li = _table(spark, sf, "lineitem")
    m = (F.col("l_partkey") + F.col("l_linenumber")) % 3
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("truth"), F.when(m == 0, "A").when(m == 1, F.col("l_returnflag")).otherwise("N").alias("pred"), F.col("l_linestatus").alias("third"),
        ((F.col("l_partkey") % 1000) / 1000.0).alias("score"), (F.col("l_returnflag") == "R").alias("pos"), F.col("l_quantity").alias("x"), (F.col("l_quantity") + F.col("l_linenumber") % 3).alias("y"),
    )


_LABELS = ["A", "N", "R", "Z"]
_GRID = ", ".join(f"('{x}')" for x in _LABELS)


@query(f"WITH {_EVAL} SELECT t.l AS truth, p.l AS predicted, count(e.id) AS n FROM (VALUES {_GRID}) t(l) CROSS JOIN (VALUES {_GRID}) p(l) LEFT JOIN e ON e.truth = t.l AND e.pred = p.l GROUP BY 1, 2")
def confusion_matrix(spark, sf):
    return metrics.confusion(_evals(spark, sf), "truth", "pred", _LABELS)


_PRF = f"""{_EVAL}, c AS (SELECT t.l AS label, count(*) FILTER (WHERE truth = l AND pred = l) AS tp, count(*) FILTER (WHERE truth <> l AND pred = l) AS fp, count(*) FILTER (WHERE truth = l AND pred <> l) AS fn FROM (VALUES {_GRID}) t(l), e GROUP BY 1),
 f AS (SELECT *, tp + fn AS support, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c)"""


@query(f"WITH {_PRF} SELECT label, tp, fp, fn, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def prf_per_class(spark, sf):
    m = metrics.per_class(_evals(spark, sf), "truth", "pred", _LABELS)
    return m.select("label", "tp", "fp", "fn", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {_PRF} SELECT round((SELECT count(*) FILTER (WHERE truth = pred) / count(*) FROM e), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f")
def prf_macro(spark, sf):
    return metrics.summary(_evals(spark, sf), "truth", "pred", _LABELS).select(*[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")])


_CURVE = f"""{_EVAL}, d AS (SELECT score, count(*) FILTER (WHERE pos) AS p, count(*) FILTER (WHERE NOT pos) AS n FROM e GROUP BY score),
 k AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS ps, sum(n) OVER () AS ns FROM d)"""


@query(f"WITH {_CURVE} SELECT round(sum(p * tp / (tp + fp)) / max(ps), 6) AS average_precision, round(sum(n * (tp - p / 2.0)) / (max(ps) * max(ns)), 6) AS auroc FROM k")
def binary_ap_auroc(spark, sf):
    return metrics.ranking(_evals(spark, sf), "pos", "score").select(F.round("average_precision", 6).alias("average_precision"), F.round("auroc", 6).alias("auroc"))


@query(f"WITH {_CURVE} SELECT score AS threshold, round(2 * tp / (tp + fp + ps), 6) AS f1 FROM k ORDER BY 2 * tp / (tp + fp + ps) DESC, score LIMIT 1")
def threshold_tuning(spark, sf):
    return metrics.best_threshold(_evals(spark, sf), "pos", "score").select("threshold", F.round("f1", 6).alias("f1"))


@query(f"WITH {_EVAL} SELECT count(*) AS n, round(avg(abs(x - y)), 6) AS mae, round(avg((x = y)::INT), 6) AS exact, round(avg((abs(x - y) <= 1)::INT), 6) AS within, median(abs(x - y)) AS median_error, max(abs(x - y)) AS max_error FROM e")
def regression_tolerance(spark, sf):
    r = metrics.regression(_evals(spark, sf), "x", "y", 1.0)
    return r.select("n", *[F.round(c, 6).alias(c) for c in ("mae", "exact", "within")], "median_error", "max_error")


@query(f"WITH {_EVAL}, z AS (SELECT pos, score * 4 - 2 AS z FROM e) " + " UNION ALL ".join(f"SELECT {t}::DOUBLE AS temperature, round(avg(ln(1 + exp(-(CASE WHEN pos THEN z ELSE -z END) / {t}))), 6) AS nll FROM z" for t in (0.5, 1.0, 2.0, 4.0)))
def temperature_grid(spark, sf):
    e = _evals(spark, sf).withColumn("z", F.col("score") * 4 - 2)
    return metrics.temperature(e, "pos", "z", [0.5, 1.0, 2.0, 4.0]).withColumn("nll", F.round("nll", 6))


@query(f"WITH {_EVAL} SELECT CASE WHEN score >= 0.95 THEN 'high' WHEN score >= 0.8 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n, round(avg((truth = pred)::INT), 6) AS accuracy, round(avg(score), 6) AS mean_confidence FROM e GROUP BY 1")
def confidence_buckets(spark, sf):
    return metrics.confidence_buckets(_evals(spark, sf), "truth", "pred", "score").select("bucket", "n", F.round("accuracy", 6).alias("accuracy"), F.round("mean_confidence", 6).alias("mean_confidence"))


@query(f"""WITH {_EVAL}, b AS (SELECT truth = pred AS ab, truth = third AS ac, pred = third AS bc FROM e) SELECT count(*) AS n, round(avg(ab::INT), 6) AS agree_ab, round(avg(ac::INT), 6) AS agree_ac, round(avg(bc::INT), 6) AS agree_bc,
 round(avg((ab AND bc)::INT), 6) AS all_same, round(avg(((ab OR ac OR bc) AND NOT (ab AND bc))::INT), 6) AS one_differs, round(avg((NOT (ab OR ac OR bc))::INT), 6) AS all_different FROM b""")
def three_way_agreement(spark, sf):
    r = metrics.three_way(_evals(spark, sf), "truth", "pred", "third")
    return r.select("n", *[F.round(c, 6).alias(c) for c in r.columns if c != "n"])


@query(f"WITH {_EVAL} SELECT 'truth' AS dimension, truth AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM e), 6) AS fraction FROM e GROUP BY truth UNION ALL SELECT 'pred', pred, count(*), round(count(*) / (SELECT count(*) FROM e), 6) FROM e GROUP BY pred")
def distribution(spark, sf):
    return metrics.distribution(_evals(spark, sf), ["truth", "pred"]).withColumn("fraction", F.round("fraction", 6))


@query(f"WITH {_EVAL} SELECT truth AS split, pred AS quality, count(*) AS n FROM e GROUP BY GROUPING SETS ((truth, pred), (pred))")
def label_stats_grouping_sets(spark, sf):
    return metrics.label_stats(_evals(spark, sf).select(F.col("truth").alias("split"), F.col("pred").alias("quality")), "split", "quality")


@query(f"WITH {_EVAL} SELECT truth, count(x) AS n, min(x) AS min, max(x) AS max, round(avg(x), 4) AS mean, median(x) AS median, quantile_cont(x, 0.9) AS p90 FROM e GROUP BY truth")
def size_summary(spark, sf):
    return metrics.numeric_summary(_evals(spark, sf), "x", ["truth"])


@query(f"WITH {_EVAL} SELECT truth, pred, count(x) AS n, round(avg(x), 6) AS mean, round(CASE WHEN count(x) = 1 THEN 0 ELSE stddev_samp(x) END, 6) AS std FROM e GROUP BY ALL")
def seed_summary(spark, sf):
    return metrics.seed_summary(_evals(spark, sf), ["truth", "pred"], "x").select("truth", "pred", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


# splits and samples

_CUST = "c AS (SELECT c_custkey AS k, c_mktsegment AS seg, c_nationkey AS nat, c_acctbal AS bal FROM customer)"


def _customers(spark, sf):
    return _table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nat"), F.col("c_acctbal").alias("bal"))


_DRAW = "md5(concat('42|', k::VARCHAR))"
_CUTS = "greatest(floor(n * 0.7), 1) AS at0, greatest(floor(n * 0.7), 1) + greatest(floor(n * 0.15), 1) AS to0"


@query(f"""WITH {_CUST}, r AS (SELECT k, row_number() OVER (ORDER BY {_DRAW}, k) AS r, count(*) OVER () AS n FROM c), s AS (SELECT *, {_CUTS} FROM r)
 SELECT k, CASE WHEN r <= least(at0, least(to0, n - 1) - 1) THEN 'train' WHEN r <= least(to0, n - 1) THEN 'val' ELSE 'test' END AS split FROM s""")
def subject_split(spark, sf):
    return sampling.subject_split(_customers(spark, sf), "k")


@query(f"""WITH {_CUST}, r AS (SELECT k, seg, row_number() OVER (PARTITION BY seg ORDER BY {_DRAW}, k) AS r, count(*) OVER (PARTITION BY seg) AS n FROM c),
 s AS (SELECT *, greatest(round_even(n * 0.7, 0), 1) AS at0, greatest(round_even(n * 0.15, 0), 1) AS v FROM r), u AS (SELECT *, least(at0 + v, n - 1) AS to0 FROM s)
 SELECT k, seg, CASE WHEN n = 1 THEN 'train' WHEN n = 2 THEN CASE WHEN r = 1 THEN 'train' ELSE 'test' END WHEN r <= least(at0, to0 - 1) THEN 'train' WHEN r <= to0 THEN 'val' ELSE 'test' END AS split FROM u""")
def stratified_group_split(spark, sf):
    return sampling.label_split(_customers(spark, sf), "k", "seg")


@query("WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (k)) AS n_both, (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS only_a, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS only_b")
def split_overlap(spark, sf):
    o = _table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return sampling.overlap(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), "k")


@query("SELECT o_custkey AS k, count(DISTINCT o_orderstatus) AS splits FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def leakage(spark, sf):
    return sampling.leakage(_table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("split")), "k")


@query(f"WITH {_CUST}, r AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY {_DRAW}, k) AS r FROM c) SELECT k, seg FROM r WHERE r <= CASE seg WHEN 'BUILDING' THEN 5 WHEN 'MACHINERY' THEN 3 ELSE 0 END")
def quota_sample(spark, sf):
    return sampling.strata_sample(_customers(spark, sf), "seg", "k", {"BUILDING": 5, "MACHINERY": 3}).select("k", "seg")


@query(f"""WITH {_CUST}, r AS (SELECT *, {_DRAW} AS h, row_number() OVER (PARTITION BY nat ORDER BY {_DRAW}, k) AS r, greatest(1, round_even(40.0 * count(*) OVER (PARTITION BY nat) / count(*) OVER (), 0)) AS want FROM c)
 SELECT k, nat FROM r WHERE r <= want ORDER BY r, h, k LIMIT 40""")
def stratified_sample(spark, sf):
    return sampling.proportional_sample(_customers(spark, sf), "nat", "k", 40).select("k", "nat")


@query(f"WITH {_CUST} SELECT k, bal FROM (SELECT * FROM c ORDER BY bal DESC, k LIMIT 60) x ORDER BY {_DRAW}, k LIMIT 20")
def oversample(spark, sf):
    return sampling.oversampled(_customers(spark, sf), "bal", "k", 20).select("k", "bal")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10")
def top_counts(spark, sf):
    return sampling.top_counts(_table(spark, sf, "part"), "p_brand", 10)


@query("WITH t AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 5) SELECT CASE WHEN p_brand IN (SELECT p_brand FROM t) THEN p_brand ELSE 'OTHER' END AS bucket, count(*) AS n FROM part GROUP BY 1")
def exam_group_other_bucket(spark, sf):
    return sampling.top_or_other(_table(spark, sf, "part"), "p_brand", 5).groupBy("bucket").agg(F.count("*").alias("n"))


@query("WITH m AS (SELECT o_custkey AS k, o_orderpriority AS p, count(*) AS c, min(o_orderkey) AS f FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c DESC, f) AS r FROM m) SELECT k, p FROM r WHERE r = 1")
def majority_label(spark, sf):
    o = _table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("p"), "o_orderkey")
    return sampling.majority_label(o, "k", "p", "o_orderkey")


# predictions to candidates

_CAND = f"""cand AS (SELECT o_custkey AS case_id, concat(o_custkey, '-', o_orderkey % 3) AS note_id, concat('s', l_orderkey * 10 + l_linenumber) AS sample_id, l_orderkey * 10 + l_linenumber AS ordinal,
 CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE (l_partkey % 40)::DOUBLE END AS size_mm, CASE l_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'solid' WHEN 2 THEN 'part_solid' ELSE 'ground_glass' END AS density, l_discount AS confidence FROM ({LINES_SQL}) li JOIN orders ON l_orderkey = o_orderkey)"""


def _candidates(spark, sf):
    j = lines(spark, sf).join(_table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    s = F.col("l_suppkey") % 4
    return j.select(
        F.col("o_custkey").alias("case_id"), F.concat_ws("-", "o_custkey", F.col("o_orderkey") % 3).alias("note_id"), F.concat(F.lit("s"), F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"),
        F.when(F.col("l_partkey") % 3 != 0, (F.col("l_partkey") % 40).cast("double")).alias("size_mm"), F.when(s == 1, "solid").when(s == 2, "part_solid").when(s == 3, "ground_glass").alias("density"), F.col("l_discount").alias("confidence"),
    )


@query(f"WITH {_CAND} SELECT sample_id, row_number() OVER (PARTITION BY case_id, note_id ORDER BY (density IS NOT NULL) DESC, coalesce(nullif(size_mm, 0), -1) DESC, coalesce(confidence, 0) DESC, sample_id DESC)::INT AS candidate_rank FROM cand")
def candidate_rank(spark, sf):
    return adapter.ranked_candidates(_candidates(spark, sf)).select("sample_id", "candidate_rank")


# a note's preferred mention is its first, of every second case; some densities are unclear or empty
@query(f"""WITH {_CAND}, x AS (SELECT case_id, note_id, sample_id, ordinal, coalesce(confidence, 0)::DOUBLE AS sure, size_mm, CASE WHEN density IS NULL AND ordinal % 3 = 0 THEN 'unclear' WHEN density IS NULL AND ordinal % 3 = 1 THEN '' ELSE density END AS d,
  case_id % 2 = 0 AND ordinal = min(ordinal) OVER (PARTITION BY case_id, note_id) AS liked FROM cand),
 s AS (SELECT *, 'size_mm' AS field, size_mm::VARCHAR AS v, row_number() OVER (PARTITION BY case_id, note_id ORDER BY liked DESC, CASE WHEN size_mm = 0 THEN -1 ELSE size_mm END DESC, sure DESC, ordinal) AS r FROM x WHERE size_mm IS NOT NULL),
 t AS (SELECT *, 'density_category' AS field, d AS v, row_number() OVER (PARTITION BY case_id, note_id ORDER BY liked DESC, sure DESC, d DESC, ordinal) AS r FROM x WHERE d IN ('solid', 'part_solid', 'ground_glass')), u AS (FROM s UNION ALL FROM t)
 SELECT case_id, note_id, field, any_value(v) FILTER (WHERE r = 1) AS value, any_value(sample_id) FILTER (WHERE r = 1) AS mention, count(DISTINCT v) > 1 AS conflict, string_agg(DISTINCT v, '|' ORDER BY v) AS alternatives, string_agg(sample_id, '|' ORDER BY sample_id) AS source_mentions, count(*) AS mentions FROM u GROUP BY ALL""")
def conflict_select(spark, sf):
    c = _candidates(spark, sf)
    k = F.col("ordinal") % 3
    rows = c.withColumn("density_category", F.coalesce("density", F.when(k == 0, "unclear").when(k == 1, "")))
    first = c.filter("case_id % 2 = 0").groupBy("case_id", "note_id").agg(F.min_by("sample_id", "ordinal").alias("preferred"))
    return adapter.selected_values(rows, ["size_mm", "density_category"], first).drop("all", "samples")


@query(f"""WITH {_CAND}, u AS (SELECT case_id, note_id, 'size_mm' AS field, size_mm::VARCHAR AS v, size_mm AS a, coalesce(confidence, 0) AS b, '' AS c, sample_id FROM cand WHERE size_mm IS NOT NULL
  UNION ALL SELECT case_id, note_id, 'density_category', density, coalesce(confidence, 0), 0, density, sample_id FROM cand WHERE density IS NOT NULL),
 g AS (SELECT case_id, note_id, field, arg_max(v, (a, b, c)) AS selected, list_sort(list(DISTINCT v)) AS vs, count(DISTINCT sample_id) AS m FROM u GROUP BY ALL HAVING count(DISTINCT v) > 1)
 SELECT case_id, note_id, field, selected, array_to_string(vs, '|') AS alternatives, CASE WHEN field = 'density_category' AND m > 1 THEN 'high' ELSE 'medium' END AS risk,
 CASE WHEN field = 'size_mm' THEN CASE WHEN len(vs) <= 3 THEN 'largest_size_case_or_note_level_resolution_possible' ELSE 'many_size_values_largest_size_possible_but_review_recommended' END
  WHEN m > 1 THEN 'density_subtype_conflict_changes_cdsg_path_manual_review' ELSE 'density_conflict_single_mention_duplicate' END AS resolution, field <> 'size_mm' OR len(vs) > 3 AS needs_review FROM g""")
def conflict_risks(spark, sf):
    rows = _candidates(spark, sf).withColumnRenamed("density", "density_category")
    return adapter.conflicts(rows, ["size_mm", "density_category"]).select("case_id", "note_id", "field", "selected", "alternatives", "risk", "resolution", "needs_review")


_NEAR = f"""{_CAND}, s AS (SELECT * FROM (SELECT case_id, note_id AS sn, ordinal AS so, size_mm AS sz, row_number() OVER (PARTITION BY case_id ORDER BY size_mm DESC, ordinal) AS r FROM cand WHERE size_mm IS NOT NULL) x WHERE r = 1),
 n AS (SELECT * FROM (SELECT c.case_id, sz AS size_mm, density, row_number() OVER (PARTITION BY c.case_id ORDER BY (note_id = sn) DESC, abs(ordinal - so), coalesce(confidence, 0) DESC, ordinal) AS r FROM cand c JOIN s USING (case_id) WHERE density IS NOT NULL) y WHERE r = 1)"""


@query(f"WITH {_NEAR} SELECT case_id, size_mm, density FROM n")
def nearest_density(spark, sf):
    return adapter.nearest_density(_candidates(spark, sf))


@query(f"""WITH {_NEAR}, sm AS (SELECT case_id, max(size_mm) AS z FROM cand WHERE size_mm IS NOT NULL AND density IS NOT NULL GROUP BY 1),
 sn AS (SELECT case_id, note_id, max(size_mm) AS z FROM cand GROUP BY ALL HAVING count(size_mm) > 0 AND count(density) > 0), sc AS (SELECT case_id, max(size_mm) AS z FROM cand GROUP BY 1 HAVING count(size_mm) > 0 AND count(density) > 0),
 al AS (SELECT 'same_mention' AS strategy, case_id, z FROM sm UNION ALL SELECT 'same_note', case_id, max(z) FROM sn GROUP BY case_id UNION ALL SELECT 'same_case', case_id, z FROM sc UNION ALL SELECT 'nearest', case_id, size_mm FROM n)
 SELECT strategy, count(*) AS cases, sum(z) AS sizes FROM al GROUP BY 1""")
def union_strategies(spark, sf):
    return adapter.simulate_strategies(_candidates(spark, sf)).groupBy("strategy").agg(F.count("*").alias("cases"), F.sum("size_mm").alias("sizes"))


_TASKS = ["size", "density", "location"]
_MENTIONS = (
    "thyroid nodule", "", "lung nodule in RUL", "mass", "adrenal and pulmonary nodule", "Right upper lobe opacity near the liver dome", "calcified  granuloma", "rib lesion next to a nodule", "Pleural thickening, hilar node",
    "nodule of skin and bowel", "left kidney, ground glass change", "hilar node", "opacity in RUL, apical", "RLL opacity by a vertebra", "granuloma of the breast", " \t ", "bones and lobes", "enlarged lymph nodes",
)


def _predictions(spark, sf):
    li = lines(spark, sf)
    task = F.element_at(F.array(*[F.lit(t) for t in _TASKS]), (F.col("l_linenumber") % 3 + 1).cast("int"))
    text = F.element_at(F.array(*[F.lit(t) for t in _MENTIONS]), (F.col("l_partkey") % len(_MENTIONS) + 1).cast("int"))
    return li.select(
        F.concat(F.lit("p"), F.col("l_orderkey")).alias("sample_id"), F.when(F.col("l_orderkey") % 7 != 0, F.col("l_orderkey").cast("string")).alias("note_id"), text.alias("mention_text"), task.alias("task"),
        F.when(F.col("l_quantity") > 5, F.col("l_returnflag")).alias("label"), F.col("l_discount").alias("confidence"), F.col("l_linenumber").alias("ordinal"),
    )


_PREDS = f"""p AS (SELECT concat('p', l_orderkey) AS sample_id, CASE WHEN l_orderkey % 7 <> 0 THEN l_orderkey::VARCHAR END AS note_id, [{', '.join(S.q(t) for t in _MENTIONS)}][l_partkey % {len(_MENTIONS)} + 1] AS mention_text,
 ['size', 'density', 'location'][l_linenumber % 3 + 1] AS task, CASE WHEN l_quantity > 5 THEN l_returnflag END AS label, l_linenumber AS ordinal FROM ({LINES_SQL}) li),
 f AS (SELECT sample_id, arg_min(coalesce(note_id, '-'), ordinal) AS note_id, arg_min(mention_text, ordinal) AS mention_text FROM p GROUP BY 1),
 l AS (SELECT sample_id, task, label FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, task ORDER BY ordinal DESC) AS r FROM p) x WHERE r = 1),
 m AS (SELECT f.*, a.label AS size, b.label AS density, c.label AS location FROM f LEFT JOIN l a ON a.sample_id = f.sample_id AND a.task = 'size' LEFT JOIN l b ON b.sample_id = f.sample_id AND b.task = 'density' LEFT JOIN l c ON c.sample_id = f.sample_id AND c.task = 'location')"""


@query(f"WITH {_PREDS} SELECT sample_id, note_id, mention_text, size, density, location FROM m")
def prediction_merge(spark, sf):
    m = adapter.merge_tasks(_predictions(spark, sf), _TASKS)
    return m.select("sample_id", F.coalesce("note_id", F.lit("-")).alias("note_id"), "mention_text", *[F.col(t)["label"].alias(t) for t in _TASKS])


# the reason by hand: what each text of _MENTIONS is, in order
_REASONS = (
    "non_pulmonary_mention_filtered", "empty_mention_text", None, "no_pulmonary_nodule_cue", None, None, None, "non_pulmonary_mention_filtered", None,
    None, None, "non_pulmonary_mention_filtered", "no_pulmonary_nodule_cue", "no_pulmonary_nodule_cue", "non_pulmonary_mention_filtered", "empty_mention_text", "non_pulmonary_mention_filtered", "non_pulmonary_mention_filtered",
)


@query(f"""WITH {_PREDS}, r AS (SELECT m.*, o_custkey FROM m LEFT JOIN orders ON o_orderkey::VARCHAR = note_id AND o_orderkey % 5 <> 0),
 w AS (SELECT * FROM (VALUES {', '.join(f"({S.q(t)}, {S.q(r) if r else 'NULL'})" for t, r in zip(_MENTIONS, _REASONS, strict=True))}) v(mention_text, why))
 SELECT mention_text, coalesce(CASE WHEN note_id = '-' THEN 'missing_note_id' WHEN o_custkey IS NULL THEN 'note_id_not_in_case_bundle' WHEN why IS NOT NULL THEN why
 WHEN coalesce(size, density, location) IS NULL THEN 'no_direct_fact' END, 'accepted') AS reason, count(*) AS n FROM r JOIN w USING (mention_text) GROUP BY ALL""")
def dead_letter(spark, sf):
    case = _table(spark, sf, "orders").filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").cast("string").alias("note_id"), F.col("o_custkey").alias("case_id"))
    r = adapter.routed(adapter.merge_tasks(_predictions(spark, sf), _TASKS), case)
    return r.groupBy("mention_text", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {_CAND}, n AS (SELECT case_id, count(*) AS c, count(size_mm) AS s, count(density) AS d, count(*) FILTER (WHERE size_mm IS NOT NULL AND density IS NOT NULL) AS b FROM cand GROUP BY 1)
 SELECT case_id, c AS candidates, s AS with_size, d AS with_density, b AS with_both, s - b AS size_alone, d - b AS density_alone, CASE WHEN b > 0 THEN 'actionable' WHEN s > 0 AND d > 0 THEN 'split_across_candidates'
 WHEN s > 0 THEN 'density_never_stated' WHEN d > 0 THEN 'size_never_stated' ELSE 'neither_stated' END AS root_cause FROM n""")
def abstention_root_cause(spark, sf):
    return audit.root_cause(audit.candidate_counts(_candidates(spark, sf)))


_AUDIT = """a AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'correct' WHEN 1 THEN 'incorrect' WHEN 2 THEN 'uncertain' ELSE '' END AS size_ok, CASE o_custkey % 3 WHEN 0 THEN 'Correct ' WHEN 1 THEN NULL ELSE 'None' END AS density_ok,
 CASE o_custkey % 3 WHEN 0 THEN 'x|y' WHEN 1 THEN 'y' ELSE '' END AS groups FROM orders)"""


def _audits(spark, sf):
    m, c = F.col("o_orderkey") % 4, F.col("o_custkey") % 3
    return _table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.when(m == 0, "correct").when(m == 1, "incorrect").when(m == 2, "uncertain").otherwise("").alias("size_ok"),
        F.when(c == 0, "Correct ").when(c == 2, "None").alias("density_ok"), F.when(c == 0, "x|y").when(c == 1, "y").otherwise("").alias("groups"),
    )


@query(f"""WITH {_AUDIT} SELECT f AS field, count(*) AS rows, count(*) FILTER (WHERE v IS NOT NULL AND trim(v) NOT IN ('', 'None')) AS filled, round(count(*) FILTER (WHERE v IS NOT NULL AND trim(v) NOT IN ('', 'None')) / count(*), 6) AS rate
 FROM (SELECT 'size_ok' AS f, size_ok AS v FROM a UNION ALL SELECT 'density_ok', density_ok FROM a) x GROUP BY f""")
def audit_completion(spark, sf):
    return audit.completion(_audits(spark, sf), ["size_ok", "density_ok"]).withColumn("rate", F.round("rate", 6))


@query(f"""WITH {_AUDIT}, g AS (SELECT unnest(list_filter(string_split(groups, '|'), lambda s: s <> '')) AS audit_group, size_ok, density_ok FROM a),
 l AS (SELECT audit_group, 'size_ok' AS field, lower(trim(size_ok)) AS v FROM g UNION ALL SELECT audit_group, 'density_ok', lower(trim(density_ok)) FROM g)
 SELECT audit_group, field, count(*) FILTER (WHERE v IN ('correct', 'incorrect')) AS judged, round(coalesce(count(*) FILTER (WHERE v = 'correct') / nullif(count(*) FILTER (WHERE v IN ('correct', 'incorrect')), 0), 0), 6) AS correct_rate FROM l GROUP BY ALL""")
def audit_scores(spark, sf):
    return audit.scores(_audits(spark, sf), ["size_ok", "density_ok"], "groups").withColumn("correct_rate", F.round("correct_rate", 6))


@query(f"WITH {_AUDIT} SELECT 'ids' AS name, 'pass' AS status, 0::BIGINT AS failures, NULL::VARCHAR AS first_example UNION ALL SELECT 'sure', 'fail', count(*), min(k)::VARCHAR FROM a WHERE size_ok NOT IN ('correct', 'incorrect')")
def audit_checks(spark, sf):
    return audit.checks(_audits(spark, sf), "k", {"ids": F.col("k").isNotNull(), "sure": F.col("size_ok").isin("correct", "incorrect")})
