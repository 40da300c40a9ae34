"""Mentions, cues and sizes against a plain reading of their rules, sentence by sentence and pattern by pattern."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from notewright.functions import patterns as P
from notewright.functions import text as T
from notewright.operators import cutting, radiology, variants

BLANKS = " \t\n\r\f\v"
STARTS, GOES_ON, CUE = (re.compile(p.replace(r"\s", f"[{BLANKS}]"), re.I) for p in (P.MENTION_START, P.MENTION_GOES_ON, P.CUE))
WORDS = (
    "nodule Nodules granuloma GGO ground glass opacity lesion stable New left lobe part-solid ground-glass follow-up Follow up recommend should be lung-rads screening Normal. heart; seen? "
    "pulmonary énodule noduleé nodule3 nodule_ kidney \u212aey \u017fize lobe\u0301 no 5mm measuring x"
).split(" ")
GAPS = [" ", " ", " ", ". ", ".\n", "\n", " \n ", "; ", ".", "!\t", "?\v", "\r\n", "\u00a0", " .  \n\n", ""]


def sentences(t):
    return [s for s in (x.strip(BLANKS) for x in re.split(r"\n+|\x01", re.sub(rf"([.!?;])[{BLANKS}]+", "\\1\x01", t or ""))) if s]


def words(s):
    """The sentence with accents as letters, as the JVM has them."""
    return "".join("_" if unicodedata.category(c) == "Mn" else c for c in s)


def mentions(t):
    out, open_ = [], None
    for s in sentences(t):
        if STARTS.search(words(s)):
            out.append(s)
            open_ = True
        elif open_ and GOES_ON.search(words(s)):
            out[-1] += " " + s
        else:
            open_ = None
    return out


def cue(t):
    return " ".join(s for s in sentences(t) if CUE.search(words(s))) or None


def texts():
    pick = random.Random(7)
    made = ["".join(pick.choice(GAPS) + pick.choice(WORDS) for _ in range(pick.randint(0, 30))) for _ in range(3000)]
    # Python folds these two letters into ASCII, the JVM does not
    return [None, "", " \n ", "nodule. " + "stable. " * 20_000, *[t.replace("\u212a", "").replace("\u017f", "") for t in made]]


def test_batches_and_columns_cut_alike(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    batches = {r.id: (r.found, r.cue) for r in cutting.cut(df, ("text",), "text").collect()}
    columns = {r.id: (r.m, r.c, r.s) for r in df.select("id", T.mentions(F.col("text")).alias("m"), T.cue(F.col("text")).alias("c"), T.sentences(F.col("text")).alias("s")).collect()}
    for i, t in rows:
        want = mentions(t), cue(t)
        assert columns[i] == (*want, sentences(t)), t
        assert batches[i] == want, t


def test_letters_beyond_ascii_are_not_folded(spark):
    df = spark.createDataFrame([(0, "le\u017fion. kidney"), (1, "nodule\u0663 nodule\u0301")], "id int, text string")
    assert [r.found for r in cutting.cut(df, ("text",), "text").orderBy("id").collect()] == [[], []]
    assert [r.m for r in df.orderBy("id").select(T.mentions(F.col("text")).alias("m")).collect()] == [[], []]


def test_the_next_text_is_cut_where_the_first_has_no_mention(spark):
    df = spark.createDataFrame([(0, "A nodule.", "A lesion.", "Follow-up."), (1, "Normal.", "A lesion. Stable.", None), (2, None, None, "x")], "id int, a string, b string, c string")
    got = cutting.cut(df, ("a", "b"), "c").orderBy("id").collect()
    assert [(r.found, r.cue) for r in got] == [(["A nodule."], "Follow-up."), (["A lesion. Stable."], None), ([], None)]


def size(t, rules):
    for _, pattern, how, unit in rules:
        if m := re.search(pattern.replace(r"\s", r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"), t, re.I | re.A):
            n = [float(x) for x in m.groups()]
            return (sum(n) / 2 if how == "mean" else max(n)) * unit, m[0]
    return None, None


def test_sizes_are_those_of_the_first_rule_that_matches(spark):
    pick = random.Random(3)
    bits = ["5", "12", "3.4", "7.", "1.2.3", " ", " ", "-", "–", " x ", "x", "×", "mm", "cm", " mm", "MM ", "mmm", "and", ".", "\u00a0", "\n", "m", "4x3x2 cm"]
    rows = [(i, "".join(pick.choice(bits) for _ in range(pick.randint(0, 9)))) for i in range(4000)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(2)
    for rules in (P.SIZES, P.SIZES_STRICT):
        got = {r.id: tuple(r.s) for r in df.select("id", T.size(F.col("text"), rules).alias("s")).collect()}
        for i, t in rows:
            assert got[i] == size(t, rules), t
    assert df.limit(1).select(T.size(F.lit(None).cast("string")).alias("s")).first().s == (None, None)


def test_whole_reports_are_cut_in_batches(spark):
    """No pattern of mentions is left in the plan, where a test for empty arrays had made all of them twice."""
    rows = [(f"1-RR-{i}", 1, "CT CHEST", f"FINDINGS: A {i} mm solid nodule in the lingula. It is stable.\nIMPRESSION: A ggo, {i} x 2 cm. Follow-up CT." if i % 3 else None) for i in range(9)]
    notes = spark.createDataFrame(rows, "note_id string, subject_id long, exam_name string, text string")
    got = variants.full_text_mentions(notes)
    assert "granuloma" not in got._jdf.queryExecution().optimizedPlan().toString()
    key = lambda df: sorted(df.collect(), key=lambda r: (r.note_id, r.nodule_id_in_report))
    assert key(got) == key(radiology.mention_rows(variants.full_text_facts(notes))) and got.count() == 12


def test_reports_are_cut_by_their_sections(spark):
    pick = random.Random(11)
    bits = ["FINDINGS:", "Findings :", "IMPRESSION:", "impression\n\n", "RECOMMENDATION(S):", "recommendation:", "TECHNIQUE:", "A nodule.", "Stable, left.", "Follow-up CT.", "FINDING\u017f:", "ggo", "\x02", "\x01"]
    gaps = ["\n", "\n", " ", "\n\n  ", "\r\n", "\r", "\x85", "\u2028", "\v", ". ", ""]
    rows = [(0, None), (1, ""), (2, "FINDINGS:")] + [(i, "".join(pick.choice(gaps) + pick.choice(bits) for _ in range(pick.randint(0, 12)))) for i in range(3, 4000)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    want = {r.id: (r.found, r.cue) for r in radiology._staged(df, "text").collect()}
    got = {r.id: (r.found, r.cue) for r in cutting.cut_reports(df, "text").collect()}
    for i, t in rows:
        assert got[i] == want[i], t
