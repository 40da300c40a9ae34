"""Secret scan with corpus-wide ownership frequency.

Method. Candidates are what the base patterns find and, beyond them, long mixed
tokens of high entropy. The hash of each candidate's value is counted over the whole
corpus by distinct repositories and distinct owners. A value that few owners have in
few repositories is theirs and looks live; one that many owners have, or that is in many
repositories of few, is a copied example. Live-looking tokens
beyond the base become spans of kind live; base spans stay either way and carry
their verdict in n_live and n_example.

Scale. Texts are read once; only candidates travel. A value that a third of the
corpus holds is counted by partial aggregation, and its candidates are dealt to many tasks where they are joined with their counts.

Edge cases. Null text: empty. Null owners or repositories count as none; a value with
no owner at all is live if it is in few repositories. Rows that repeat an id are rows of their own. Spans are
code points, end exclusive. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, materialise, salted_join
from .spans import SPAN, SPAN_ARROW, joined_column, key_of, rows_with_spans

KINDS = ("assign", "access", "hex", "live")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Whole runs only: a run of fewer than 32 fails and is dropped anyway.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: Tokens beyond the base: at least 20 characters with a digit among them.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
MIN_ENTROPY = 3.5
#: A value of at most as many owners and repositories is theirs.
MAX_OWNERS, MAX_REPOS = 2, 5


def entropy(s: str) -> float:
    """Bits a character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, hash of the value)."""
    out = [("assign", m.start(), m.end(), key_of(m[2])) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end(), key_of(m[0])) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end(), key_of(m[0])) for m in HEX.finditer(text)]
    return out


def _find(text: str) -> tuple[list[tuple], list[dict]]:
    base = base_spans(text)
    more = []
    for m in TOKEN.finditer(text):
        value = m[0]
        if any(s < m.end() and m.start() < e for _, s, e, _ in base) or not re.search("[0-9]", value) or not re.search("[A-Za-z]", value) or entropy(value) < MIN_ENTROPY:
            continue
        more.append({"kind": "live", "start": m.start(), "end": m.end(), "key": key_of(value)})
    return base, more


def secret_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans,
    verdicts (kind:start:end:live or example of every candidate, joined likewise), n_live,
    n_example (candidates by verdict), found (array of spans with owners and verdict)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(owner_col).alias("owner"), F.xxhash64(repo_col).alias("repo"), F.col(owner_col).isNull().alias("no_owner"), F.col(repo_col).isNull().alias("no_repo"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = docs.mapInArrow(
        rows_with_spans(_find, pa.list_(SPAN_ARROW), KINDS),
        f"row long, doc_id {kind}, owner long, repo long, no_owner boolean, no_repo boolean, base array<{SPAN}>, base_sha256 string, more array<{SPAN}>",
    )
    got = materialise(got, "secrets")
    one = got.filter("size(base) + size(more) > 0").select("row", "owner", "repo", "no_owner", "no_repo", F.explode(F.concat("base", "more")).alias("x"))
    one = one.select("row", F.when(~F.col("no_owner"), F.col("owner")).alias("owner"), F.when(~F.col("no_repo"), F.col("repo")).alias("repo"), "x", F.col("x.key").alias("key"))
    spread = one.groupBy("key").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos"))
    counts = one.groupBy("key").agg(F.count("*").alias("n"))
    hot = hot_keys(counts, "key", "n", one.count())
    judged = salted_join(one, spread, "key", hot, F.col("row")).withColumn("live", (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos))
    span = F.struct(F.col("x.kind").alias("kind"), F.col("x.start").alias("start"), F.col("x.end").alias("end"), "owners", "repos", "live")
    place = F.struct(F.col("x.start").alias("s"), F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("x.kind")).alias("k"), span.alias("x"))
    by_row = judged.groupBy("row").agg(F.array_sort(F.collect_list(place))["x"].alias("found"))
    out = got.join(by_row, "row", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<kind:string,start:int,end:int,owners:long,repos:long,live:boolean>>")))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    shown = F.filter("found", lambda x: (x["kind"] != "live") | x["live"])
    return out.select(
        "doc_id",
        *[count(k) for k in KINDS[:3]],
        "base_sha256",
        joined_column(shown, KINDS).alias("spans"),
        F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"], F.when(x["live"], "live").otherwise("example"))), ",").alias("verdicts"),
        F.size(F.filter("found", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("found", lambda x: ~x["live"])).cast("long").alias("n_example"),
        "found",
    )
