"""JSON documents of any shape: the first of several keys at any depth, and what a set of documents holds.

Both go down level by level inside the row, as a fold over an array of open nodes: nothing is shuffled to walk a
document. Texts keep the order of keys, which VARIANT does not; VARIANT tells what a value is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels that are gone down; a document that is deeper is an error, not a shorter result.
DEPTH = 32


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _members(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _elements(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _folded(start: Column, level: Callable[[Column], Column], depth: int) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), start, lambda state, _: level(state))


def first_key(json: Column, keys: Sequence[str], *, depth: int = DEPTH) -> Column:
    """The value of the first of the keys that a JSON text holds, depth first and in the order of the text; as text, null if there is none.

    An object's first such key ends the search of that object even if its value is null; the search goes on outside of it. Strings are
    without quotes, arrays and objects are JSON texts. What is neither a JSON object nor an array is null."""

    def entry(hit: Column, v: Column, text: Column) -> Column:
        inside = _members(v).isNotNull() | _elements(v).isNotNull()
        return F.struct(hit.alias("hit"), F.is_variant_null(v).alias("void"), inside.alias("open"), text.alias("text"))

    def upto_hit(xs: Column) -> Column:
        at = lambda x: F.array_position(F.transform(x, lambda i: i["hit"]), True).cast("int")
        return _let(xs, lambda x: F.when(F.exists(x, lambda i: i["hit"]), F.slice(x, F.lit(1), at(x))).otherwise(x))

    def children(n: Column) -> Column:
        text = n["text"]
        of_object = F.zip_with(F.map_entries(F.from_json(text, "map<string,string>")), F.map_values(F.from_json(text, "map<string,variant>")), lambda e, v: entry(e["key"].isin(*keys), v, e["value"]))
        of_array = F.zip_with(F.from_json(text, "array<string>"), F.from_json(text, "array<variant>"), lambda t, v: entry(F.lit(False), v, t))
        found = F.coalesce(F.when(F.startswith(F.ltrim(text), F.lit("{")), of_object).otherwise(of_array), F.array().cast("array<struct<hit:boolean,void:boolean,open:boolean,text:string>>"))
        left = F.filter(upto_hit(found), lambda i: F.when(i["hit"], ~i["void"]).otherwise(i["open"]))
        return F.transform(left, lambda i: F.struct(i["hit"].alias("hit"), i["text"].alias("text")))

    def level(nodes: Column) -> Column:
        return upto_hit(F.flatten(F.transform(nodes, lambda n: F.when(n["hit"], F.array(n)).otherwise(children(n)))))

    root = F.array(F.struct(F.lit(False).alias("hit"), json.alias("text")))
    end = lambda w: F.when(F.size(w) > 0, F.when(w[0]["hit"], w[0]["text"]).otherwise(F.raise_error(F.lit(f"deeper than {depth} levels")).cast("string")))
    return F.when(json.isNotNull(), _let(_folded(root, level, depth), end))


def nodes(json: Column, *, depth: int = DEPTH) -> Column:
    """Every value of a JSON text as an array of path, type (object, array, string, number, boolean, null): the root is $, a
    member $.name, an element of an array $[]. Null for what is no JSON."""

    def node(path: Column, v: Column) -> Column:
        return F.struct(path.alias("path"), v.alias("v"))

    def children(n: Column) -> Column:
        members = F.transform(F.map_entries(_members(n["v"])), lambda e: node(F.concat(n["path"], F.lit("."), e["key"]), e["value"]))
        elements = F.transform(_elements(n["v"]), lambda v: node(F.concat(n["path"], F.lit("[]")), v))
        return F.coalesce(members, elements, F.array().cast("array<struct<path:string,v:variant>>"))

    def kind(v: Column) -> Column:
        said = F.schema_of_variant(v)
        named = F.when(F.startswith(said, F.lit("OBJECT")), "object").when(F.startswith(said, F.lit("ARRAY")), "array").when(said == "STRING", "string").when(said == "BOOLEAN", "boolean").when(said == "VOID", "null")
        return named.otherwise("number")

    def level(state: Column) -> Column:
        done = F.concat(state["done"], F.transform(state["open"], lambda n: F.struct(n["path"].alias("path"), kind(n["v"]).alias("type"))))
        return F.struct(done.alias("done"), F.flatten(F.transform(state["open"], children)).alias("open"))

    root = F.struct(F.array().cast("array<struct<path:string,type:string>>").alias("done"), F.array(node(F.lit("$"), F.try_parse_json(json))).alias("open"))
    end = lambda s: F.when(F.size(s["open"]) == 0, s["done"]).otherwise(F.raise_error(F.lit(f"deeper than {depth} levels")).cast("array<struct<path:string,type:string>>"))
    return F.when(F.try_parse_json(json).isNotNull(), _let(_folded(root, level, depth), end))


def contents(rows: DataFrame, json: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, path, rows (documents that hold the path), values (how often they do), types (sorted) of every path of a set of JSON texts.

    One pass: a document's paths are put in order inside its row, and counts are summed before they are sent, one row for each task and path."""
    own = rows.select(*keys, F.array_sort(nodes(F.col(json))).alias("c_all"))
    before = F.concat(F.array(F.lit(None).cast("struct<path:string,type:string>")), "c_all")
    marked = F.zip_with("c_all", F.slice(before, F.lit(1), F.size("c_all")), lambda n, p: F.struct(n["path"].alias("path"), n["type"].alias("type"), (~n["path"].eqNullSafe(p["path"])).cast("long").alias("first")))
    one = own.filter("c_all IS NOT NULL").select(*keys, F.explode(marked).alias("x"))
    return one.groupBy(*keys, F.col("x.path").alias("path")).agg(F.sum("x.first").alias("rows"), F.count("*").alias("values"), F.array_sort(F.collect_set("x.type")).alias("types"))


def shape(rows: DataFrame, json: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, parsed, failed, schema: one schema that all JSON texts of a group have, merged task by task."""
    v = F.try_parse_json(F.col(json))
    return rows.groupBy(*keys).agg(F.count(v).alias("parsed"), F.count_if(F.col(json).isNotNull() & v.isNull()).alias("failed"), F.schema_of_variant_agg(v).alias("schema"))
