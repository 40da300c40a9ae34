"""Line dedup by a log-template tree; DataFrame functions only.

Method (after He et al., 2017). Tokens with a digit are variable at once, unless they are
more than half of a line, which is data then and compared as it is. A line goes down a
tree of fixed depth: by its number of tokens, then by the tokens that lead it. As any field
may be variable, the first ones too, it goes down by several paths: a short line by all of
its tokens but one, for each; a longer one by three of its five parts, for each three. The tokens
of a path are a template, so a leaf is one template and lines belong to several; at least
60 % of a template is constant. A line recurs if it, masked, or one of its templates is seen
in RECURS documents. Recurring lines are dropped. Paragraphs, lines of more than LONGEST
tokens, are no log lines: they recur only as themselves, masked.

Documents that are copies of each other count as one: equal texts, and documents of which
more than COPY (of the tokens) are lines that other texts have too, digits and all, if the longest such
line is the same.

Scale. A line travels as hashes; texts travel once, to their own dropped line
numbers. Counts are combined before each shuffle; a line that every document has
is one row a task, and where it is joined it is dealt to many. No step gathers a
template, a line's documents or a text's copies: the widest row is a text's dropped line numbers.

Edge cases. Null text stays null and has no lines; blank lines are never dropped.
Rows that repeat a doc_id are documents of their own, equal texts are treated alike.
Lines of fewer than four tokens have no templates, only themselves. Other columns pass
through; names that begin with nw_ are refused.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, materialise, refuse, salted_join

RECURS, COPY = 10, 0.5
#: Tokens of the longest line with templates, of the shortest that is cut into PARTS, and how many parts are taken as variable.
LONGEST, CUT, PARTS, VARIABLE = 64, 10, 5, 2
#: Parts of a text's copies in the last join.
SALT = 16
SPACE = r"[ \t\x0B\f\r]+"
BLANKS = " \t\x0b\f\r"
SOME = r"[^ \t\x0B\f\r]"
MASK = "<*>"
#: A token with a digit; tried at the beginning of tokens only.
NUMBERED = r"(?<![^ \t\x0B\f\r])[^ \t\x0B\f\r0-9]*+[0-9][^ \t\x0B\f\r]*"


def _tokens(line: Column) -> Column:
    """Tokens of a line, those with a digit masked if they are half at most; a blank line has none."""
    cut = lambda x: F.split(F.btrim(x, F.lit(BLANKS)), SPACE)
    masked = cut(F.regexp_replace(line, NUMBERED, MASK))
    data = 2 * F.size(F.filter(masked, lambda t: t == MASK)) > F.size(masked)
    tokens = F.when(line.rlike("[0-9]"), F.when(data, cut(line)).otherwise(masked)).otherwise(cut(line))
    return F.when(line.rlike(SOME), tokens).otherwise(F.array().cast("array<string>"))


def _parts(tokens: Column, n: Column) -> Column:
    """Hashes of what a line's paths are made of: its tokens, or its PARTS if it is longer; none without templates."""
    step = F.floor(n / PARTS).cast("int")
    cut = [F.slice(tokens, step * j + 1, step if j < PARTS - 1 else n - step * j) for j in range(PARTS)]
    short = F.transform(tokens, lambda t: F.xxhash64(t))
    return F.when((n >= CUT) & (n <= LONGEST), F.array(*[F.xxhash64(x) for x in cut])).when((n >= 4) & (n < CUT), short).otherwise(F.array().cast("array<long>"))


def _paths(parts: Column, n: Column) -> Column:
    """A hash for each template of a line."""
    kept = [tuple(j for j in range(PARTS) if j not in gone) for gone in combinations(range(PARTS), VARIABLE)]
    long_ = F.array(*[F.xxhash64(n, F.lit(i), *[F.get(parts, F.lit(j)) for j in k]) for i, k in enumerate(kept)])
    short = F.transform(parts, lambda _, i: F.xxhash64(n, i, F.concat(F.slice(parts, 1, i), F.slice(parts, i + 2, F.size(parts)))))
    return F.when(n >= CUT, long_).otherwise(short)


def _hashed(docs: DataFrame, text: str) -> DataFrame:
    """nw_hash, nw_i (line number from 0), n, raw, masked, parts of every line that is not blank."""
    lines = docs.filter(F.col(text).isNotNull()).select("nw_hash", F.posexplode(F.split(text, "\n")).alias("nw_i", "line"))
    # blank lines go by a look at the text: a filter on n would be pushed below and cut every line twice
    t = lines.filter(F.col("line").rlike(SOME)).withColumn("tokens", _tokens(F.col("line"))).withColumn("n", F.size("tokens"))
    return t.select("nw_hash", "nw_i", "n", F.xxhash64("line").alias("raw"), F.xxhash64("n", "tokens").alias("masked"), _parts(F.col("tokens"), F.col("n")).alias("parts"))


def _templates(hashed: DataFrame, recurs: int) -> DataFrame:
    """masked, template: the templates of lines that may recur, from distinct lines and the number of texts of each."""
    weight = hashed.filter(F.size("parts") > 0).groupBy("masked", "nw_hash").agg(F.first("n").alias("n"), F.first("parts").alias("parts"))
    weight = weight.groupBy("masked").agg(F.count("*").alias("w"), F.first("n").alias("n"), F.first("parts").alias("parts"))
    path = weight.select("masked", "w", F.explode(_paths(F.col("parts"), F.col("n"))).alias("template"))
    # a template of one line says no more than the line
    often = path.groupBy("template").agg(F.sum("w").alias("total"), F.min("masked").alias("a"), F.max("masked").alias("b"))
    often = often.filter((F.col("total") >= recurs) & (F.col("a") < F.col("b"))).select("template")
    return path.select("masked", "template").join(often, "template")


def _classes(hashed: DataFrame, rows: int) -> DataFrame:
    """nw_hash, class: what stands for a text where documents are counted; copies have one."""
    line = hashed.groupBy("raw", "nw_hash").agg(F.first("n").alias("n"))
    shared = materialise(line.groupBy("raw").agg(F.count("*").alias("texts")).filter("texts > 1"), "shared")
    hot = hot_keys(shared, "raw", "texts", rows)
    common = salted_join(line, shared.select("raw"), "raw", hot, F.col("nw_hash")).groupBy("nw_hash").agg(F.sum("n").alias("common"), F.max(F.struct("n", "raw")).alias("longest"))
    # a text's lines are in one part of hashed: its total needs no line to travel
    total = hashed.groupBy("nw_hash", "raw").agg(F.first("n").alias("n")).groupBy("nw_hash").agg(F.sum("n").alias("all"))
    copy = common.join(total, "nw_hash").filter(F.col("common") > COPY * F.col("all"))
    return copy.select("nw_hash", F.col("longest.raw").alias("class"))


def recurring_lines(hashed: DataFrame, rows: int, *, recurs: int = RECURS) -> tuple[DataFrame, list]:
    """masked: hashes of the masked lines that recur by themselves or by a template; and those of them that are in very many texts."""
    held = hashed.select("masked", "nw_hash").distinct()
    alone = materialise(held.groupBy("masked").agg(F.count("*").alias("w")).filter(F.col("w") >= recurs), "alone")
    hot = hot_keys(alone, "masked", "w", rows)
    member = materialise(_templates(hashed, recurs).select("masked", "template").union(alone.select("masked", F.col("masked").alias("template"))), "templates")
    seen = salted_join(held, member, "masked", hot, F.col("nw_hash")).select("template", "nw_hash").distinct()
    classes = materialise(_classes(hashed, rows), "classes")
    counted = seen.join(classes, "nw_hash", "left").select("template", F.coalesce("class", "nw_hash").alias("class")).distinct()
    again = counted.groupBy("template").agg(F.count("*").alias("w")).filter(F.col("w") >= recurs).select("template")
    return member.join(again, "template").select("masked").distinct(), hot


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", recurs: int = RECURS) -> DataFrame:
    """docs with recurring lines gone from text_col, and nw_lines and nw_dropped (numbers of lines)."""
    refuse(docs)
    keyed = docs.withColumn("nw_hash", F.xxhash64(text_col))
    texts = keyed.select("nw_hash", F.col(text_col).alias("nw_text"))
    hashed = materialise(_hashed(texts, "nw_text"), "hashed")
    again, hot = recurring_lines(hashed, hashed.count(), recurs=recurs)
    again = materialise(again, "again")
    hit = salted_join(hashed.select("masked", "nw_hash", "nw_i"), again, "masked", hot, F.col("nw_hash")).groupBy("nw_hash").agg(F.collect_set("nw_i").alias("nw_gone"))
    # a text that a third of all rows repeat goes to several tasks
    hit = hit.withColumn("nw_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).withColumnRenamed("nw_hash", "nw_hash2").withColumnRenamed("nw_salt", "nw_salt2")
    salt = F.pmod(F.xxhash64(id_col), F.lit(SALT)).cast("int")
    out = keyed.withColumn("nw_salt", salt).join(hit, (F.col("nw_hash") == F.col("nw_hash2")) & (F.col("nw_salt") == F.col("nw_salt2")), "left")
    ls = F.split(text_col, "\n")
    # numbers of the lines that stay by a hash set, not by a search for each line
    stay = lambda xs: F.transform(F.array_except(F.sequence(F.lit(0), F.size(xs) - 1), F.col("nw_gone")), lambda i: F.get(xs, i))
    left = F.array_join(F.element_at(F.transform(F.array(ls), stay), 1), "\n")
    changed = F.col("nw_gone").isNotNull() & F.col(text_col).isNotNull()
    out = out.withColumn("nw_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(ls)).cast("long"))
    out = out.withColumn("nw_dropped", F.when(changed, F.size("nw_gone")).otherwise(0).cast("long"))
    out = out.withColumn(text_col, F.when(changed, left).otherwise(F.col(text_col)))
    return out.select(*docs.columns, "nw_lines", "nw_dropped")
