"""Radiology notes to structured facts. DataFrame to DataFrame; texts are read without Python on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from .cutting import cut_reports
from .repeats import by_text, dealt, exploded

NODULE_FIELDS = (
    "size_mm", "size_text", "density_category", "density_text", "location_lobe", "location_text", "count_type", "change_status", "change_text",
    "calcification", "spiculation", "lobulation", "cavitation", "perifissural", "lung_rads_category", "recommendation_cue", "evidence_span", "confidence",
)


def exam_names(details: DataFrame, *, ordinal: str = "ordinal") -> DataFrame:
    """note_id, exam_name: the first chest CT name of each note, by ordinal."""
    hit = (F.lower("field_name") == "exam_name") & T.has(F.col("field_value"), P.CHEST_CT)
    return details.filter(hit).groupBy("note_id").agg(F.min_by("field_value", ordinal).alias("exam_name"))


def chest_ct(notes: DataFrame, details: DataFrame, *, ordinal: str = "ordinal") -> DataFrame:
    """Notes of chest CT exams with their exam name; both sides are pruned before the join, which the optimizer may broadcast."""
    return notes.join(exam_names(details, ordinal=ordinal), "note_id")


def with_nodule(notes: DataFrame, text: str = "text") -> DataFrame:
    """Notes with a nodule word that is not negated."""
    return notes.filter(T.negation_aware_mention(F.col(text)))


#: What is read from a mention.
READ = {"text": lambda m: m, "size": T.size, "density": T.density, "place": T.location, "change": T.change, "shape": T.morphology}


def _read(mention: Column) -> Column:
    """What the mention says, each part once."""
    return F.struct(*[f(mention).alias(k) for k, f in READ.items()])


def _nodule(x: Column, index: Column, count: Column, rads: Column, cue: Column) -> Column:
    """The fields of a mention that has been read, but for missing_flags."""
    kind = F.when(count == 1, "single").when(count > 1, "multiple").otherwise("unclear")
    size, density, place, change, shape = (x[k] for k in ("size", "density", "place", "change", "shape"))
    values = [
        size["value"], size["span"], density["value"], density["span"], place["value"], place["span"], kind, change["value"], change["span"],
        shape["calcification"], shape["spiculation"], shape["lobulation"], shape["cavitation"], shape["perifissural"],
        rads, cue, x["text"], T.confidence(size["value"], density["value"], place["value"]),
    ]
    return F.struct(index.cast("int").alias("nodule_id_in_report"), *[c.alias(k) for k, c in zip(NODULE_FIELDS, values, strict=True)])


def _flagged(n: Column) -> Column:
    return F.struct(*[n[k].alias(k) for k in ("nodule_id_in_report", *NODULE_FIELDS)], T.missing(**{k: n[k] for k in NODULE_FIELDS}).alias("missing_flags"))


def nodules(mentions: Column, count: Column, rads: Column, cue: Column) -> Column:
    """Array of the 20 fields of each mention. Three transforms in a row, so that no pattern is in the plan twice."""
    return F.transform(F.transform(F.transform(mentions, _read), lambda x, i: _nodule(x, i + 1, count, rads, cue)), _flagged)


def _staged(notes: DataFrame, text: str) -> DataFrame:
    """notes with sections, found (mentions), cue, rads and nodule_count; each stage binds what the next shares."""
    staged = notes.withColumn("sections", T.sections(F.col(text)))
    staged = staged.withColumn("found", T.mentions(F.col("sections.findings")))
    staged = staged.withColumn("found", F.when(F.size("found") > 0, F.col("found")).otherwise(T.mentions(F.col("sections.impression"))))
    both = F.concat_ws(" ", F.coalesce("sections.impression", F.lit("")), F.coalesce(F.col(text), F.lit("")))
    return staged.withColumn("cue", T.cue(both)).withColumn("rads", T.lung_rads(both)).withColumn("nodule_count", F.size("found"))


def mention_facts(notes: DataFrame, text: str = "text") -> DataFrame:
    """One row per nodule: note_id, subject_id, exam_name and the nodule's fields.

    Mentions are exploded before they are read, so that every pattern is compiled code over a row's column."""
    return read_mentions(_staged(notes, text))


def read_mentions(staged: DataFrame, outer: bool = False) -> DataFrame:
    """mention_facts of notes with found (mentions), cue, rads and nodule_count; the notes' keys are those that staged has.

    outer: a note without mentions is a row whose nodule_id_in_report is null."""
    keys = [c for c in ("note_id", "subject_id", "exam_name", "ordinal") if c in staged.columns]
    # found may be dear: see exploded()
    rows = exploded(staged, F.col("found"), "m", [*keys, "cue", "rads", "nodule_count"], "i", outer)
    rows = rows.withColumn("low", F.lower("m")).withColumn("parts", T.size_parts(T.sized(F.col("m"), F.col("low"))))
    m, low = F.col("m"), F.col("low")
    rows = rows.withColumn("density", T.density(m, low)).withColumn("change", T.change(m, low)).withColumn("shape", T.morphology(m, low))
    # the JVM compiles no method that is as long as one with all patterns: where the text is asked for too, its lambda has the step's fields made in methods of their own
    rows = rows.withColumn("place", T.location(m, low)).withColumn("text", T.bound(m, lambda x: x))
    rows = rows.withColumn("size", T.size_of(F.col("parts")))
    x = {k: F.col(k) for k in ("text", "size", "density", "place", "change", "shape")}
    rows = rows.select(*keys, _nodule(x, F.col("i") + 1, F.col("nodule_count"), F.col("rads"), F.col("cue")).alias("n")).select(*keys, "n.*")
    return rows.withColumn("missing_flags", T.missing(**{k: F.col(k) for k in NODULE_FIELDS}))


def mentions_cut(notes: DataFrame, text: str = "text") -> DataFrame:
    """mention_facts of notes whose mentions and cues are cut in batches, without the Lung-RADS category; a note without mentions is a row whose nodule_id_in_report is null."""
    keys = [c for c in ("note_id", "subject_id", "exam_name", "ordinal") if c in notes.columns]
    found = cut_reports(notes.select(*keys, text), text)
    rows = found.withColumn("nodule_count", F.size("found")).withColumn("rads", F.lit(None).cast("string"))
    # of a note without mentions nothing is said
    rows = read_mentions(rows.withColumn("cue", F.when(F.col("nodule_count") > 0, F.col("cue"))), outer=True)
    return rows


def facts(notes: DataFrame, text: str = "text") -> DataFrame:
    """Notes (note_id, subject_id, exam_name, text) with sections, nodules (an array) and what is derived from them."""
    staged = _staged(notes, text)
    return staged.select(
        *[c for c in notes.columns if c != text],
        F.col(text).alias("report_text"),
        T.modality(F.col("exam_name")).alias("modality"),
        T.body_site(F.col("exam_name")).alias("body_site"),
        "sections",
        "nodule_count",
        nodules(F.col("found"), F.col("nodule_count"), F.col("rads"), F.col("cue")).alias("nodules"),
    )


def _text_nodules(notes: DataFrame, text: str) -> DataFrame:
    staged = _staged(by_text(notes, text), "text")
    return staged.withColumn("nodules", nodules(F.col("found"), F.col("nodule_count"), F.col("rads"), F.col("cue")))


def facts_once(notes: DataFrame, text: str = "text", fields: tuple[str, ...] | None = None, then: dict[str, Column] | None = None) -> DataFrame:
    """The other columns of notes with nodule_count, nodules (an array) and what then makes of these, each text read once.

    fields: those of a nodule that are kept; others are not carried from texts to notes."""
    read = _text_nodules(notes, text)
    if fields is not None:
        read = read.withColumn("nodules", F.transform("nodules", lambda n: F.struct(*[n[f].alias(f) for f in fields])))
    return dealt(read.select("keys", "nodule_count", "nodules", *[c.alias(k) for k, c in (then or {}).items()]))


def mentions_once(notes: DataFrame, text: str = "text", then: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """The other columns of notes with the fields of each nodule and what then adds to them (rows of keys and fields), each text read once."""
    return dealt(then(exploded(_text_nodules(notes, text), F.col("nodules"), "n", ["keys"]).select("keys", "n.*")))


def mention_rows(facts_: DataFrame) -> DataFrame:
    """One row per nodule: the note's keys and the nodule's fields."""
    return facts_.select("note_id", "subject_id", "exam_name", F.explode("nodules").alias("n")).select("note_id", "subject_id", "exam_name", "n.*")


def numbered_mentions(notes: DataFrame, text: str = "text", per_note: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Mentions of findings, then impression, numbered through the note: sample_id = note_id__k.

    per_note: columns made of the joined sections, once a note, that all its mentions carry."""
    rows = _section_mentions(notes, text, per_note or {}, ("note_id", "subject_id", "exam_name"))
    return rows.select(F.concat_ws("__", "note_id", F.col("k") + 1).alias("sample_id"), *[c for c in rows.columns if c != "k"])


def numbered_once(notes: DataFrame, text: str = "text", per_note: dict[str, Callable[[Column], Column]] | None = None, then: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """numbered_mentions with what then adds to the mentions, each text read once."""
    rows = dealt(then(_section_mentions(by_text(notes.select("note_id", "subject_id", "exam_name", text), text), "text", per_note or {}, ("keys",))))
    return rows.select(F.concat_ws("__", "note_id", F.col("k") + 1).alias("sample_id"), *[c for c in rows.columns if c != "k"])


def _section_mentions(notes: DataFrame, text: str, per_note: dict[str, Callable[[Column], Column]], keep: tuple[str, ...]) -> DataFrame:
    cut = notes.withColumn("sections", T.sections(F.col(text)))
    tagged = lambda s: F.transform(T.mentions(F.col(f"sections.{s}")), lambda m: F.struct(F.lit(s).alias("section"), m.alias("mention_text")))
    full = F.concat_ws(
        "\n\n",
        F.when(F.col("sections.findings").isNotNull(), F.concat(F.lit("FINDINGS: "), F.col("sections.findings"))),
        F.when(F.col("sections.impression").isNotNull(), F.concat(F.lit("IMPRESSION: "), F.col("sections.impression"))),
    )
    cut = cut.withColumn("full_text", full)
    for k, f in per_note.items():
        cut = cut.withColumn(k, f(F.col("full_text")))
    rows = exploded(cut, F.concat(tagged("findings"), tagged("impression")), "m", [*keep, "full_text", *per_note], "k")
    size, place = T.size(F.col("m.mention_text")), T.location(F.col("m.mention_text"))
    return rows.select(
        *keep, "k", "m.section", "m.mention_text", "full_text",
        T.density(F.col("m.mention_text"))["value"].alias("density_label"), size["value"].alias("size_label"), size["span"].alias("size_text"), size["value"].isNotNull().alias("has_size"),
        F.coalesce(place["value"], F.lit("no_location")).alias("location_label"), place["value"].isNotNull().alias("has_location"), *per_note,
    )
