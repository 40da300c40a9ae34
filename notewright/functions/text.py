"""Column builders for the fields of radiology and discharge texts; all run inside the JVM.

A text argument is a Column. Builders that give a value and its evidence return a struct (value, span), both null on no match.
"""

from __future__ import annotations

import functools
import re._parser as re_parser
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

_MARK, _END = "\u0001", "\u0002"
BLANKS = " \t\n\r\f\u000b"
#: White space beyond ASCII's counts between a number and its unit.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def ci(pattern: str) -> str:
    return "(?i)" + pattern


def _literals(parts) -> set[str] | None:
    """Of parsed parts of a pattern: words of which any match holds one; None if there are none."""
    best: set[str] | None = None
    run, letters = "", []

    def better(words: set[str] | None) -> None:
        nonlocal best
        if words and (best is None or min(map(len, words)) > min(map(len, best))):
            best = words

    for op, arg in parts:
        name = str(op)
        if name == "LITERAL" and chr(arg).isascii() and chr(arg).isalnum():
            run += chr(arg).lower()
            letters.append((op, arg))
            continue
        better({run} if run else None)
        if name == "SUBPATTERN":
            better(_literals(arg[-1]))
        elif name == "BRANCH":  # with the letters before it, which the parser takes out of alternatives that begin alike
            each = [_literals([*letters, *x]) for x in arg[1]]
            better(set().union(*each) if all(each) else None)
        elif name == "MAX_REPEAT" and arg[0] > 0:
            better(_literals(arg[2]))
        run, letters = "", []
    better({run} if run else None)
    return best


@functools.cache
def literals(pattern: str) -> tuple[str, ...]:
    """Up to eight words of three letters or more, in lower case, of which any match of the pattern holds one; else none."""
    found = _literals(re_parser.parse(pattern)) or set()
    found = {w for w in found if not any(x != w and x in w for x in found)}
    return tuple(sorted(found)) if len(found) <= 8 and all(len(w) >= 3 for w in found) else ()


def _firsts(parts) -> set[str]:
    """Letters of which a match begins with one; none if they are not known."""
    for op, arg in parts:
        name = str(op)
        if name == "AT":
            continue
        if name == "SUBPATTERN":
            return _firsts(arg[-1])
        if name == "BRANCH":
            each = [_firsts(x) for x in arg[1]]
            return set().union(*each) if all(each) else set()
        return {chr(arg)} if name == "LITERAL" and chr(arg).isalpha() else set()
    return set()


def quick(pattern: str) -> str:
    """The pattern, tried only where one of its first letters is."""
    letters = "".join(sorted(_firsts(re_parser.parse(pattern))))
    return f"(?=[{letters}])(?:{pattern})" if letters else f"(?:{pattern})"


def _worded(text: Column, pattern: str, low: Column | None = None) -> Column | None:
    """Whether the text holds a word that any match of the pattern holds; None if there are no such words or the text is dear. low: the text in lower case."""
    words = () if low is None and any(x in str(text) for x in ("concat", "regexp", "substring")) else literals(pattern)
    low, any_ = F.lower(text) if low is None else low, None
    for w in words:
        one = F.contains(low, F.lit(w))
        any_ = one if any_ is None else any_ | one
    return any_


def has(text: Column, pattern: str, low: Column | None = None) -> Column:
    """Whether the pattern matches, in any case. Where its matches hold one of a few words, the words are looked for first:
    that is a fraction of the pattern's cost, and most texts have none. low: the text in lower case, if that is at hand."""
    hit, worded = text.rlike(ci(pattern)), _worded(text, pattern, low)
    return F.coalesce(hit if worded is None else worded & hit, F.lit(False))


def found(text: Column, pattern: str) -> Column:
    """First match or null."""
    return F.regexp_substr(text, F.lit(ci(pattern)))


def group(text: Column, pattern: str, n: int) -> Column:
    """A group of the first match; null where there is none."""
    return F.nullif(F.regexp_extract(text, ci(pattern), n), F.lit(""))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def nonempty(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used: a lambda's variable is not inlined."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_case(cases: list[tuple[Column, Column, Column]], kind: str = "string", otherwise: Column | None = None) -> Column:
    """(value, span) of the first case (hit, value, span) that holds; one CASE, so that each test runs once."""
    pair = lambda v, s: F.struct(v.cast(kind).alias("value"), s.cast("string").alias("span"))
    out = F
    for hit, value, span in cases:
        out = out.when(hit, pair(value, span))
    return out.otherwise(pair(F.lit(None) if otherwise is None else otherwise, F.lit(None)))


def first_of(text: Column, rules, low: Column | None = None) -> Column:
    """(value, span) of the first (pattern, value) rule that matches."""
    return first_case([(has(text, pattern, low), F.lit(label), found(text, pattern)) for pattern, label in rules])


def sections(text: Column) -> Column:
    """Struct of the five sections; of a repeated header the last holds; impression falls back to recommendations."""
    head = r"(?im)^\s*(" + "|".join(P.HEADERS) + r")\s*(?::\s*|\n+)"
    marked = F.regexp_replace(text, head, f"{_MARK}$1{_END}")
    parts = F.filter(F.split(marked, _MARK), lambda p: p.contains(_END))
    entry = lambda p: F.struct(
        F.regexp_replace(F.lower(F.substring_index(p, _END, 1)), r"\(s\)", "").alias("key"),
        nonempty(F.substring_index(p, _END, -1)).alias("body"),
    )
    last = lambda es, key: F.try_element_at(F.filter(es, lambda e: e["key"] == key), F.lit(-1))["body"]

    def fields(es: Column) -> Column:
        out = {k: last(es, k) for k in P.SECTIONS}
        out["impression"] = F.coalesce(out["impression"], last(es, "recommendation"))
        return F.struct(*[c.alias(k) for k, c in out.items()])

    return bound(F.transform(parts, entry), fields)


def marked(text: Column) -> Column:
    """The text with one mark between each two sentences and no blanks beside it. Classes are spelled out: that makes them tables."""
    gap = f"[{BLANKS}{_MARK}]*+"
    return F.regexp_replace(strip(text), f"[{BLANKS}]*[\n{_MARK}]{gap}|(?<=[.!?;])[{BLANKS}]{gap}", _MARK)


def sentences(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(marked(text), F.lit("")), _MARK), "")


def _sentence(pattern: str) -> str:
    """A whole sentence of a marked text that the pattern matches in; a pattern that matches no mark."""
    return f"[^{_MARK}]*?{quick(pattern)}[^{_MARK}]*+"


#: Before a sentence of a marked text.
_BEGIN = f"(?<![^{_MARK}])"
#: A sentence that begins with a nodule word and those that go on about it. Loops give nothing back: each sentence is tried once, without recursion.
_MENTION = ci(f"{_BEGIN}{_sentence(P.MENTION_START)}(?:{_MARK}(?![^{_MARK}]*?{quick(P.MENTION_START)}){_sentence(P.MENTION_GOES_ON)})*+")
_CUE = ci(_BEGIN + _sentence(P.CUE))


def _whole(text: Column, cut: Column | None) -> Column:
    return marked(text) if cut is None else cut


def mentions(text: Column, cut: Column | None = None) -> Column:
    """Sentences that begin with a nodule word, each with those that go on about it. cut: the marked text, if that is at hand."""
    found_ = F.transform(F.regexp_extract_all(_whole(text, cut), F.lit(_MENTION), F.lit(0)), lambda m: F.replace(m, F.lit(_MARK), F.lit(" ")))
    # most notes speak of no nodule and are not cut
    worded = _worded(text, P.MENTION_START)
    return F.when(F.coalesce(text.isNotNull() if worded is None else worded, F.lit(False)), found_).otherwise(F.array().cast("array<string>"))


_N = r"\d++(?:\.\d*+)?+"
#: Up to three numbers and a unit: what every match of a rule for sizes lies in.
_SIZED = ci(rf"(?:{_N}{SPACE}*[-–x×]{SPACE}*){{0,2}}{_N}{SPACE}*-?{SPACE}*[cm]m\b")


def sized(text: Column, low: Column | None = None) -> Column:
    """The numbers with units of a text, apart by a mark: what any rule for sizes finds in the text it finds in them. low: the text in lower case, if that is at hand."""
    low = F.lower(text) if low is None else low
    # most texts have no unit
    return F.when(F.contains(low, F.lit("mm")) | F.contains(low, F.lit("cm")), F.array_join(F.regexp_extract_all(text, F.lit(_SIZED), F.lit(0)), _MARK)).otherwise("")


def _size_rules(rules) -> tuple[str, str, list[tuple[str, float, int]]]:
    """A pattern that matches all of a text that any rule matches in, and what the first rule to match has found: its span, and the
    numbers of each kind of rule (how, unit and how many)."""
    tried, spans, kinds, g = [], "", {}, 0
    for _, pattern, how, unit in rules:
        n = pattern.count(P.NUMBER)
        numbers = kinds.setdefault((how, unit), [])
        numbers += [""] * (n - len(numbers))
        for i in range(n):
            numbers[i] += f"${g + 2 + i}"
        spans, g = f"{spans}${g + 1}", g + 1 + n
        tried.append(f"(?s:.*?)({pattern})".replace(r"\s", SPACE))
    spelled = _MARK.join([spans, *[x for numbers in kinds.values() for x in numbers]])
    return ci(f"^(?:{'|'.join(tried)})(?s:.*+)"), spelled, [(*kind, len(numbers)) for kind, numbers in kinds.items()]


def size_parts(sized_: Column, rules=P.SIZES) -> Column:
    """What the first rule that matches has found, an array; one expression for all rules."""
    pattern, spelled, _ = _size_rules(rules)
    return F.split(F.regexp_replace(sized_, pattern, spelled), _MARK)


def size_of(parts: Column, rules=P.SIZES) -> Column:
    """(value in mm, span) of size_parts()."""
    kinds = _size_rules(rules)[2]
    at, values = 1, []
    for how, unit, n in kinds:
        # a cast of no digits is an exception, which is dear
        numbers = [F.when(F.get(parts, F.lit(i)) != "", F.get(parts, F.lit(i)).try_cast("double")) for i in range(at, at + n)]
        values.append(((numbers[0] + numbers[1]) / 2.0 if how == "mean" else F.greatest(*numbers)) * unit)
        at += n
    # a text that no rule matches in stays as it is
    return F.when(F.size(parts) == at, F.struct(F.coalesce(*values).alias("value"), F.get(parts, F.lit(0)).alias("span"))).otherwise(F.struct(F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("span")))


def size(text: Column, rules=P.SIZES) -> Column:
    """(value in mm, span). Rules are tried on the numbers with units that the text has, not on all of it."""
    return bound(size_parts(sized(text), rules), lambda parts: size_of(parts, rules))


def density(text: Column, low: Column | None = None) -> Column:
    """(class, span); a text without a density word is unclear, a null or empty one null."""
    calc = has(text, P.CALCIFIED, low) & ~has(text, P.NOT_CALCIFIED, low)
    solid = has(text, P.SOLID, low) & ~has(text, P.NOT_SOLID, low)
    cases = [(has(text, P.PART_SOLID, low), "part_solid", P.PART_SOLID), (has(text, P.GROUND_GLASS, low), "ground_glass", P.GROUND_GLASS), (calc, "calcified", P.CALCIFIED), (solid, "solid", P.SOLID)]
    return first_case([(hit, F.lit(label), found(text, pattern)) for hit, label, pattern in cases], otherwise=F.when(F.length(text) > 0, "unclear"))


def location(text: Column, low: Column | None = None) -> Column:
    return first_of(text, P.LOCATIONS, low)


def change(text: Column, low: Column | None = None) -> Column:
    return first_of(text, P.CHANGES, low)


def morphology(text: Column, low: Column | None = None) -> Column:
    flags = [has(text, p, low).alias(k) for k, p in P.MORPHOLOGY]
    return F.struct((has(text, P.CALCIFIED, low) & ~has(text, P.NOT_CALCIFIED, low)).alias("calcification"), *flags)


def cue(text: Column, cut: Column | None = None) -> Column:
    """Sentences with a recommendation cue, joined; null without one. cut: the marked text, if that is at hand."""
    hits = F.regexp_extract_all(_whole(text, cut), F.lit(_CUE), F.lit(0))
    worded = _worded(text, P.CUE)
    return F.when(has(text, P.CUE) if worded is None else worded, F.nullif(F.array_join(hits, " "), F.lit("")))


def lung_rads(text: Column) -> Column:
    return F.upper(group(text, P.LUNG_RADS, 1))


def solid_component(*texts: Column) -> Column:
    return F.coalesce(*[group(t, P.SOLID_COMPONENT, 1).try_cast("double") for t in texts])


def two_years_stable(change_text: Column, evidence: Column) -> Column:
    return has(F.concat_ws(" ", F.coalesce(change_text, F.lit("")), F.coalesce(evidence, F.lit(""))), P.TWO_YEARS)


def modality(exam: Column) -> Column:
    t = F.lower(F.coalesce(exam, F.lit("")))
    return (
        F.when(t.contains("low dose") & (t.contains("ct") | t.contains("lung screening")), "LDCT")
        .when(has(t, r"\bcta\b"), "CTA")
        .when(has(t, r"\bpet\b"), "PET_CT")
        .when(has(t, r"\b(mr|mri)\b"), "MRI")
        .when(t.contains("ultrasound") | has(t, r"\bus\b"), "ultrasound")
        .when(has(t, r"\bct\b"), "CT")
        .when(t.contains("x-ray") | has(t, r"\b(cxr|radiograph|portable ap|pa and lat)\b") | t.contains("chest ("), "X-ray")
        .otherwise("other")
    )


def body_site(exam: Column) -> Column:
    t = F.lower(F.coalesce(exam, F.lit("")))
    chest, abdomen, pelvis = has(t, r"\b(chest|lung|thorax)\b"), has(t, r"\b(abd|abdomen|abdominal)\b"), has(t, r"\bpelvis|pelvic\b")
    several = (chest & (abdomen | pelvis)) | (abdomen & pelvis)
    return F.when(several, "chest_abdomen_pelvis").when(chest, "chest").when(abdomen, "abdomen").when(pelvis, "pelvis").otherwise("other")


def confidence(size_mm: Column, density_class: Column, lobe: Column) -> Column:
    clear = lambda c: F.coalesce(c != "unclear", F.lit(False)).cast("int")
    n = size_mm.isNotNull().cast("int") + clear(density_class) + clear(lobe)
    return F.when(n == 3, "high").when(n == 2, "medium").otherwise("low")


def missing(**columns: Column) -> Column:
    """Names of the null ones, in order."""
    flags = F.array(*[F.when(c.isNull(), F.lit(k)) for k, c in columns.items()])
    return F.filter(flags, lambda x: x.isNotNull())


def negation_aware_mention(text: Column) -> Column:
    """A nodule word that is not closely preceded by no or without.

    Each nodule word's own 20 characters before it are judged: pieces between nodule words are put together again up to each."""
    word = ci(P.NODULE)
    pieces = F.split(F.regexp_replace(text, word, f"{_MARK}$0{_MARK}"), _MARK)
    tails = F.transform(
        F.sequence(F.lit(1), F.greatest(F.floor((F.size(pieces) - 1) / 2), F.lit(1)).cast("int")),
        lambda k: F.right(F.array_join(F.slice(pieces, 1, 2 * k - 1), ""), F.lit(20)),
    )
    return has(text, P.NODULE) & F.exists(tails, lambda t: ~has(t, P.NEGATED_BEFORE))


# smoking


def deidentified(text: Column) -> Column:
    return blank(text) | F.coalesce(text.rlike(P.DEIDENTIFIED), F.lit(True))


def social_history(text: Column) -> Column:
    """The body of the section (null if blank), after its first header."""
    head = "(?im)" + P.SOCIAL
    marked = F.regexp_replace(F.regexp_replace(text, head, f"{_MARK}"), rf"(?im)^\s*(?:{P.AFTER_SOCIAL})\s*:\s*", _END)
    body = F.substring_index(F.substring(marked, F.locate(_MARK, marked) + 1, 10**9), _END, 1)
    return F.when(F.coalesce(text.rlike(head), F.lit(False)), nonempty(F.replace(body, F.lit(_MARK), F.lit("\n"))))


def has_social_history(text: Column) -> Column:
    return F.coalesce(text.rlike("(?im)" + P.SOCIAL), F.lit(False))


def smoking_sentences(text: Column) -> Column:
    parts = F.split(F.coalesce(F.regexp_replace(text, r"([.!?\n])\s+", f"$1{_MARK}"), F.lit("")), _MARK)
    keep = F.filter(parts, lambda s: has(s, P.SMOKING_SENTENCE) & (~has(s, P.OTHER_PPD) | has(s, P.STRONG_TOBACCO)))
    return F.when(F.size(keep) > 0, F.array_join(F.transform(keep, strip), " "))


def smoking_status(text: Column) -> Column:
    """(value: never, former, current smoker or unknown; span)."""
    rules = [(has(text, p), "never_smoker", found(text, p)) for p in P.NEVER]
    rules += [(has(text, p), "former_smoker", found(text, p)) for p in P.FORMER]
    rules += [(has(text, p) & ~has(text, P.NOT_CURRENT), "current_smoker", found(text, p)) for p in P.CURRENT]
    rules += [(has(text, P.TOBACCO_USE), "current_smoker", found(text, P.TOBACCO_USE)), (has(text, P.TOBACCO), "unknown", found(text, P.TOBACCO))]
    return first_case([(deidentified(text), F.lit("unknown"), F.lit(None)), *[(hit, F.lit(label), s) for hit, label, s in rules]], otherwise=F.lit("unknown"))


def amount(text: Column) -> Column:
    t = F.lower(strip(text))
    return F.when(t.isin("half", "a half", "half a", "1/2"), F.lit(0.5)).when(t.rlike(r"^[0-9.]+$"), t.try_cast("double"))


def pack_years(text: Column) -> Column:
    explicit = has(text, P.PACK_YEARS)
    span2 = found(text, P.PPD_TIMES_YEARS)
    product = amount(group(text, P.PPD_TIMES_YEARS, 1)) * amount(group(text, P.PPD_TIMES_YEARS, 2))
    computed = has(span2, P.TOBACCO_CONTEXT) & product.isNotNull()
    return F.struct(
        F.when(explicit, group(text, P.PACK_YEARS, 1).try_cast("double")).when(computed, product).alias("value"),
        F.when(explicit, found(text, P.PACK_YEARS)).when(computed, span2).alias("span"),
    )


def _in_context(text: Column, pattern: str, radius: int, ok) -> Column:
    """First match of pattern whose surroundings of radius characters pass ok; null without one."""
    pieces = F.split(F.regexp_replace(text, "(" + ci(pattern) + ")", f"{_MARK}$1{_MARK}"), _MARK)
    hits = F.transform(
        F.sequence(F.lit(1), F.greatest(F.floor((F.size(pieces) - 1) / 2), F.lit(1)).cast("int")),
        lambda k: F.struct(
            F.get(pieces, 2 * k - 1).alias("m"),
            F.concat(
                F.right(F.array_join(F.slice(pieces, 1, 2 * k - 1), ""), F.lit(radius)),
                F.coalesce(F.get(pieces, 2 * k - 1), F.lit("")),
                F.left(F.array_join(F.slice(pieces, 2 * k + 1, F.size(pieces)), ""), F.lit(radius)),
            ).alias("around"),
        ),
    )
    return F.try_element_at(F.filter(hits, lambda h: h["m"].isNotNull() & ok(h["around"])), F.lit(1))["m"]


def ppd(text: Column) -> Column:
    ok = lambda around: ~has(around, P.PPD_NOT) & (has(around, P.TOBACCO_CONTEXT) | has(around, P.FOR_YEARS))
    spans = [_in_context(text, p, 60, ok) for p in P.PPD]
    values = [F.when(F.lower(s).contains("half a pack"), F.lit(0.5)).otherwise(amount(group(s, p, 1)) if "(" in p else F.lit(None).cast("double")) for s, p in zip(spans, P.PPD, strict=True)]
    value, span = F, F
    for s, v in zip(spans, values, strict=True):
        value, span = value.when(s.isNotNull(), v), span.when(s.isNotNull(), s)
    return F.struct(value.alias("value"), span.alias("span"))


def years_smoked(text: Column) -> Column:
    spans = [_in_context(text, p, 50, lambda around: has(around, P.TOBACCO_CONTEXT)) for p in P.YEARS_SMOKED]
    value, span = F, F
    for s, p in zip(spans, P.YEARS_SMOKED, strict=True):
        value, span = value.when(s.isNotNull(), group(s, p, 1).try_cast("double")), span.when(s.isNotNull(), s)
    return F.struct(value.alias("value"), span.alias("span"))


def quit_years(text: Column) -> Column:
    couple, years = has(text, P.COUPLE_OF_YEARS), has(text, P.QUIT_YEARS)
    return F.struct(
        F.when(couple, F.lit(2.0)).when(years, group(text, P.QUIT_YEARS, 1).try_cast("double")).alias("value"),
        F.when(couple, found(text, P.COUPLE_OF_YEARS)).when(years, found(text, P.QUIT_YEARS)).otherwise(found(text, P.STOPPED_IN)).alias("span"),
    )
