"""Cue patterns of mentions and notes as columns: what a text states explicitly, features for models, key terms, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: What counts as stated explicitly in a radiology note.
EXPLICIT = (
    ("has_size", r"(\d+\.?\d*)\s*(?:x\s*\d+\.?\d*\s*)?(?:mm|cm)\b"),
    ("has_density", r"\b(solid|part[- ]?solid|ground[- ]?glass|ggo|ggn|calcified)\b"),
    ("has_location", r"\b(right upper|right middle|right lower|left upper|left lower|lingula|RUL|RML|RLL|LUL|LLL)\b"),
    ("has_change", r"\b(new|stable|unchanged|increased|decreased|growing|enlarging|resolved|interval change)\b"),
    ("has_recommendation_cue", r"\b(recommend|follow[- ]?up|suggested|advised|should be|lung[- ]?rads|screening)\b"),
)
#: Cues of a smoking history, of its status and of amounts.
SMOKING_STATUS = r"\b(smoker|former smoker|never smoker|non[- ]?smoker|current smoker|quit smoking|tobacco use|pack[- ]?year|ppd|packs? per day|years? smoked)\b"
SMOKING_AMOUNT = r"\b(\d+\.?\d*)\s*(?:pack[- ]?year|ppd|packs?\s*per\s*day|years?\s*(?:of\s+)?smok)"

#: Features of a size and of a location.
_N, _UNIT, _BY = r"\d+(?:\.\d+)?", r"(?:mm|cm)", r"(?:x|X|×|by)"
SIZE_FEATURES = (
    ("size_unit_mm_cm", rf"\b{_UNIT}\b"),
    ("size_numeric_unit", rf"\b{_N}\s*{_UNIT}\b"),
    ("size_2d_pattern", rf"\b{_N}\s*{_BY}\s*{_N}\s*(?:{_UNIT})?\b"),
    ("size_3d_pattern", rf"\b{_N}\s*{_BY}\s*{_N}\s*{_BY}\s*{_N}\s*(?:{_UNIT})?\b"),
    ("size_range_pattern", rf"\b(?:{_N}\s*(?:-|to)\s*{_N}\s*{_UNIT}|between\s+{_N}\s+and\s+{_N}\s*{_UNIT})\b"),
    ("size_context_word", r"\b(?:measur(?:e|es|ed|ing)|diameter|dimension|size|nodule[s]?\s+(?:is|are|measures?))\b"),
)
LOBE_FEATURES = (
    ("rul", r"\b(?:RUL|right\s+upper\s+lobe)\b"), ("rml", r"\b(?:RML|right\s+middle\s+lobe)\b"), ("rll", r"\b(?:RLL|right\s+lower\s+lobe)\b"),
    ("lul", r"\b(?:LUL|left\s+upper\s+lobe)\b"), ("lll", r"\b(?:LLL|left\s+lower\s+lobe)\b"),
)
PLACE_FEATURES = (
    ("lingula", r"\blingula(?:r)?\b"), ("bilateral", r"\b(?:bilateral|both\s+lungs|both\s+sides)\b"), ("right", r"\bright\b"), ("left", r"\bleft\b"), ("upper", r"\bupper\b"),
    ("middle", r"\bmiddle\b"), ("lower", r"\blower\b"), ("lobe", r"\blobe\b"), ("apical", r"\bapic(?:al|es?)\b"), ("basal", r"\b(?:basal|base|bases)\b"),
)
#: Words that carry a recommendation.
KEY_TERMS = ("follow", "followup", "follow-up", "ct", "ldct", "pet", "petct", "biopsy", "month", "months", "year", "years", "immediate", "annual")


def explicit_fields(text: Column) -> Column:
    """Struct of flags, and explicit_field_count."""
    t = F.coalesce(text, F.lit(""))
    flags = [T.has(t, p).alias(k) for k, p in EXPLICIT]
    return F.struct(*flags, sum(T.has(t, p).cast("int") for _, p in EXPLICIT).alias("explicit_field_count"))


def smoking_cues(text: Column) -> Column:
    """(has_status_cue, has_quantitative_cue, cue_source); keep notes with either."""
    t = F.coalesce(text, F.lit(""))
    source = F.when(T.has_social_history(t), "social_history").otherwise("full_text_fallback")
    return F.struct(T.has(t, SMOKING_STATUS).alias("has_status_cue"), T.has(t, SMOKING_AMOUNT).alias("has_quantitative_cue"), source.alias("cue_source"))


def _yes(test: Column) -> Column:
    return F.when(test, "yes").otherwise("no")


def _bucket(n: Column) -> Column:
    return F.when(n <= 0, "0").when(n == 1, "1").when(n == 2, "2").otherwise("3plus")


def size_features(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    out = {k: _yes(T.has(t, p)) for k, p in SIZE_FEATURES}
    return out | {"size_numeric_unit_count": _bucket(F.regexp_count(t, F.lit(T.ci(SIZE_FEATURES[1][1]))))}


def location_features(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    out = {f"loc_{k}": _yes(T.has(t, p)) for k, p in (*LOBE_FEATURES, *PLACE_FEATURES)}
    hits = lambda rules: sum(T.has(t, p).cast("int") for _, p in rules)
    return out | {"loc_abbreviation_count": _bucket(hits(LOBE_FEATURES)), "loc_directional_count": _bucket(hits(PLACE_FEATURES))}


FEATURES = {"size": size_features, "location": location_features}


def feature_block(task: str, text: Column) -> Column:
    """One line: the task and its features, key=value, by key."""
    f = FEATURES[task](text)
    return F.concat(F.lit(f"[{task.upper()} CUE FEATURES] "), F.concat_ws(" ; ", *[F.concat(F.lit(f"{k}="), f[k]) for k in sorted(f)]))


def augmented(task: str, mention: Column, base: Column) -> Column:
    """The feature line before the text that a model reads: base, or the mention if that is empty."""
    return T.strip(F.concat(feature_block(task, mention), F.lit("\n"), F.coalesce(F.nullif(base, F.lit("")), mention, F.lit(""))))


def joined_sections(findings: Column, impression: Column) -> Column:
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws("\n\n", part("FINDINGS", findings), part("IMPRESSION", impression))


def section_aware(full_text: Column, section: Column, exam: Column, mention: Column) -> Column:
    """Struct of findings_text, impression_text, findings_impression_text and section_aware_text, the input of a model that reads sections."""
    s = T.sections(full_text)
    e = lambda c, other="": F.coalesce(c, F.lit(other))
    both = joined_sections(s["findings"], s["impression"])
    aware = F.concat(F.lit("[SECTION] "), e(section, "unknown"), F.lit("\n[EXAM] "), e(exam), F.lit("\n[MENTION] "), e(mention), F.lit("\n"), both)
    return F.struct(e(s["findings"]).alias("findings_text"), e(s["impression"]).alias("impression_text"), both.alias("findings_impression_text"), T.strip(aware).alias("section_aware_text"))


def model_text(text: Column, exam: Column | None = None) -> Column:
    """What a model reads: the text, after its exam if that is given."""
    t = F.coalesce(text, F.lit(""))
    return t if exam is None else T.strip(F.concat(F.lit("[EXAM] "), F.coalesce(exam, F.lit("")), F.lit(" [TEXT] "), t))


def tokens(text: Column) -> Column:
    """Distinct words in lower case; pet-ct and follow-up are one each."""
    t = F.replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("pet-ct"), F.lit("petct")), F.lit("follow-up"), F.lit("followup"))
    return F.array_distinct(F.regexp_extract_all(t, F.lit("([a-z0-9]+)"), F.lit(1)))


def key_terms(cue: Column) -> Column:
    """Words of a cue that carry its recommendation, or those of three letters and more."""
    t = tokens(cue)
    key = F.filter(t, lambda w: w.isin(*KEY_TERMS) | w.contains("month") | w.contains("year") | w.endswith("ct"))
    return F.when(F.size(key) > 0, key).otherwise(F.filter(t, lambda w: F.length(w) >= 3))


def agrees(action: Column, cue: Column) -> Column:
    """All key terms of the cue are among the action's words, and there are some."""
    terms = key_terms(cue)
    return (F.size(terms) > 0) & (F.size(F.array_except(terms, tokens(action))) == 0)


# ids, keys and labels


def radiology_note_id(note_id: Column, subject: Column, seq: Column) -> Column:
    """The id as it is if it has the form of one, else made of subject and sequence number, or of a number as id, or 0."""
    raw = T.strip(F.coalesce(note_id.cast("string"), F.lit("")))
    whole = lambda c: F.when(T.strip(c.cast("string")).rlike(r"^[+-]?[0-9]+$"), T.strip(c.cast("string")).try_cast("long"))
    n = F.when(whole(seq) > 0, whole(seq)).when(whole(note_id) > 0, whole(note_id)).otherwise(F.lit(0))
    return F.when(raw.rlike(r"^[0-9]+-RR-[0-9]+$"), raw).otherwise(F.concat_ws("-RR-", subject.cast("string"), n.cast("string")))


def discharge_note_id(note_id: Column, subject: Column, index: Column) -> Column:
    raw = T.strip(F.coalesce(note_id.cast("string"), F.lit("")))
    return F.when(raw.rlike(r"^[0-9]+-DS-[0-9]+$"), raw).otherwise(F.concat_ws("-DS-", subject.cast("string"), index.cast("string")))


def group_key(patient: Column, subject: Column, case: Column) -> Column:
    """The first that is not null, with its kind: what rows must stay together by."""
    named = lambda kind, c: F.concat(F.lit(f"{kind}:"), c.cast("string"))
    return F.coalesce(named("patient", patient), named("subject", subject), F.concat(F.lit("case:"), F.coalesce(case.cast("string"), F.lit("None"))))


def mention_key(sample: Column, mention: Column) -> Column:
    some = lambda c: F.nullif(c.cast("string"), F.lit(""))
    return F.coalesce(some(sample), some(mention))


def slug(text: Column) -> Column:
    """Lower-case letters, digits and single underscores."""
    return F.btrim(F.regexp_replace(F.lower(T.strip(F.coalesce(text, F.lit("")))), r"[^a-z0-9]+", "_"), F.lit("_"))


def truncated(text: Column, limit: int = 180) -> Column:
    """White space collapsed, and cut with dots; null if empty."""
    t = F.btrim(F.regexp_replace(F.nullif(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.left(t, F.lit(limit - 3)), F.lit("...")))


def pipe_parts(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), r"\|"), lambda x: x != "")


def as_number(text: Column) -> Column:
    """A plain decimal number, else null (what try_cast would take from 4d or from blanks is none)."""
    t = T.strip(text.cast("string"))
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))


def as_flag(value: Column) -> Column:
    return F.coalesce(F.lower(T.strip(value.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def optional_number(text: Column) -> Column:
    """as_number, where empty, nan, none, null and na are null and anything else that is no number is an error."""
    t = F.lower(T.strip(F.coalesce(text.cast("string"), F.lit(""))))
    return F.when(t.isin("", "nan", "none", "null", "na", "n/a"), F.lit(None).cast("double")).otherwise(F.coalesce(as_number(text), F.raise_error(F.concat(F.lit("no number: "), t)).cast("double")))


def nested(json: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text, as text; null where it ends early."""
    return F.get_json_object(json, "$." + path)


def confidence_label(value: Column) -> Column:
    return F.when(value.isNull(), "unknown").when(value >= 0.9, "high").when(value >= 0.7, "medium").otherwise("low")
