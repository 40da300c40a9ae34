import pytest
from pyspark.sql import functions as F

from notewright.functions import text as T
from notewright.operators import radiology, smoking


def one(spark, value, build):
    df = spark.createDataFrame([(value,)], "t string").select(build(F.col("t")).alias("r"))
    return df.first().r


@pytest.mark.parametrize(
    "text,want",
    [
        ("4 mm nodule", (4.0, "4 mm")), ("1.2 cm nodule", (12.0, "1.2 cm")), ("nodule measures 4 x 3 mm", (4.0, "4 x 3 mm")), ("lesion is 1.2 x 0.8 cm", (12.0, "1.2 x 0.8 cm")),
        ("a 4-mm nodule", (4.0, "4-mm")), ("tiny nodules ranging 1-2 mm", (1.5, "1-2 mm")), ("no number", (None, None)), ("2 x 3 x 4 mm", (4.0, "2 x 3 x 4 mm")), (None, (None, None)), ("5mmx", (None, None)),
    ],
)
def test_size(spark, text, want):
    assert tuple(one(spark, text, T.size)) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("solid nodule", "solid"), ("part-solid", "part_solid"), ("ground-glass opacity", "ground_glass"), ("calcified granuloma", "calcified"), ("non-calcified solid", "solid"),
        ("indeterminate", "unclear"), ("", None), (None, None),
    ],
)
def test_density(spark, text, want):
    assert one(spark, text, T.density).value == want


@pytest.mark.parametrize("text,want", [("right upper lobe", "RUL"), ("left lower lobe", "LLL"), ("lingula", "lingula"), ("right lung", "unclear"), ("bilateral RUL", "bilateral"), ("x", None)])
def test_location(spark, text, want):
    assert one(spark, text, T.location).value == want


@pytest.mark.parametrize("text,want", [("stable", "stable"), ("new", "new"), ("increased", "increased"), ("new but stable", "stable"), ("smaller", "decreased"), ("no longer seen", "resolved"), ("", None)])
def test_change(spark, text, want):
    assert one(spark, text, T.change).value == want


def test_morphology_and_category(spark):
    m = one(spark, "spiculated mass, not definitely calcified", T.morphology)
    assert m.spiculation and not m.calcification
    assert one(spark, "Lung-RADS category: 2", T.lung_rads) == "2" and one(spark, "lung rads 4a", T.lung_rads) == "4A" and one(spark, "x", T.lung_rads) is None


def test_mentions(spark):
    text = "There is a nodule. It is stable.\nPleural effusion. It is new. A new lesion in the RUL; measuring 5 mm."
    assert one(spark, text, T.mentions) == ["There is a nodule. It is stable.", "A new lesion in the RUL; measuring 5 mm."]
    assert one(spark, None, T.mentions) == [] and one(spark, "", T.mentions) == []


def test_sections(spark):
    s = one(spark, "EXAMINATION: CT\nFINDINGS :  one\nIMPRESSION:\n\nFINDINGS:\ntwo\nRECOMMENDATION(S): three", T.sections)
    assert s.asDict() == {"indication": None, "technique": None, "comparison": None, "findings": "two", "impression": "three"}
    assert set(one(spark, "no headers here", T.sections).asDict().values()) == {None}
    assert set(one(spark, None, T.sections).asDict().values()) == {None}


@pytest.mark.parametrize(
    "text,want",
    [("There is a nodule.", True), ("No nodules identified.", False), ("No nodule. But a nodule there", True), ("without any nodular change", False), (None, False), ("no finding in the left lung at all but a nodule", True)],
)
def test_negation(spark, text, want):
    assert one(spark, text, T.negation_aware_mention) is want


@pytest.mark.parametrize(
    "exam,want",
    [("CT CHEST W/CONTRAST", ("CT", "chest")), ("CT LOW DOSE LUNG SCREENING", ("LDCT", "chest")), ("CTA CHEST", ("CTA", "chest")), ("PET CT", ("PET_CT", "other")), ("MR ABDOMEN AND PELVIS", ("MRI", "chest_abdomen_pelvis")), ("CHEST (PORTABLE AP)", ("X-ray", "chest")), (None, ("other", "other"))],
)
def test_exam(spark, exam, want):
    assert (one(spark, exam, T.modality), one(spark, exam, T.body_site)) == want


def test_chest_filter(spark):
    notes = spark.createDataFrame([(1, 100, "a"), (2, 101, "b"), (3, 102, "c")], "note_id int, subject_id int, text string")
    details = spark.createDataFrame([(1, "exam_name", "CT CHEST W/CONTRAST", 1), (2, "exam_name", "CT HEAD", 1), (3, "other", "CT CHEST", 1), (1, "EXAM_NAME", "CHEST CT", 0)], "note_id int, field_name string, field_value string, ordinal int")
    assert [(r.note_id, r.exam_name) for r in radiology.chest_ct(notes, details).collect()] == [(1, "CHEST CT")]


SMOKING = [
    ("___", "unknown", None, None, None, None, "none"),
    ("Current smoker, 40 pack-year history", "current_smoker", 40.0, None, None, None, "high"),
    ("Former smoker, quit 5 years ago", "former_smoker", None, None, None, 5.0, "medium"),
    ("Denies tobacco use", "never_smoker", None, None, None, None, "low"),
    ("Smokes 1 ppd x 20 years", "current_smoker", 20.0, 1.0, 20.0, None, "high"),
    ("PPD 2, postpartum day 2", "unknown", None, None, None, None, "none"),
    ("PPD placed, read at 0mm", "unknown", None, None, None, None, "none"),
    ("Former 2ppd smoker x 30 years, quit 10 years ago", "former_smoker", 60.0, 2.0, 30.0, 10.0, "high"),
]


def test_smoking(spark):
    rows = [(i, f"{i}-DS-1", f"Admission Date: 1\nSocial History: {t}\nFamily History: none") for i, (t, *_) in enumerate(SMOKING)]
    got = {r.subject_id: r for r in smoking.smoking_facts(spark.createDataFrame(rows, "subject_id int, note_id string, text string")).collect()}
    for i, (_, status, py, ppd, years, quit_, quality) in enumerate(SMOKING):
        r = got[i]
        assert (r.smoking_status_norm, r.pack_year_value, r.ppd_value, r.years_smoked_value, r.quit_years_value, r.evidence_quality) == (status, py, ppd, years, quit_, quality)


def test_smoking_fallback(spark):
    rows = [
        (1, "a", "HPI: former smoker with 40 pack-year history.\nSocial History: ___\n"),
        (2, "b", "Social History: Never smoked\nHPI: former smoker"),
        (3, "c", "nothing of that kind"), (4, "d", None),
    ]
    got = {r.subject_id: r for r in smoking.smoking_facts(spark.createDataFrame(rows, "subject_id int, note_id string, text string")).collect()}
    assert (got[1].source_section, got[1].smoking_status_norm, got[1].evidence_quality) == ("full_text_fallback", "former_smoker", "low")
    assert (got[2].source_section, got[2].smoking_status_norm, got[2].eligible_for_high_risk_screening) == ("Social History", "never_smoker", "not_eligible")
    for i in (3, 4):
        assert got[i].source_section is None and got[i].smoking_status_norm == "unknown" and got[i].evidence_quality == "none"


def test_facts_two_ways(spark):
    """The nested facts and the exploded mentions say the same."""
    text = "FINDINGS: A 4 mm solid nodule in the right upper lobe. It is stable. Effusion. New part-solid lesion in RML.\nIMPRESSION: Lung-RADS category: 2. Follow-up is advised."
    notes = spark.createDataFrame([("1-RR-1", 1, "CT CHEST", text), ("1-RR-2", 1, "CT", "no sections"), ("1-RR-3", 1, None, None)], "note_id string, subject_id int, exam_name string, text string")
    f = radiology.facts(notes)
    assert {r.note_id: r.nodule_count for r in f.collect()} == {"1-RR-1": 2, "1-RR-2": 0, "1-RR-3": 0}
    nested, flat = sorted(radiology.mention_rows(f).collect()), sorted(radiology.mention_facts(notes).collect())
    assert nested == flat and flat[0].count_type == "multiple" and flat[0].confidence == "high" and "change_status" not in flat[0].missing_flags
