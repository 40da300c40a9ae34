"""JSON Schema (draft 2020-12) compiled to columns: every rule of a schema gives a message where a row breaks it.

A row's columns are the instance's properties. A null is a missing property or null: it breaks "required" unless the
property may be null. What Spark's own type rules out is decided once, not for every row.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

_KINDS = {"string": (S.StringType,), "integer": (S.IntegralType,), "number": (S.NumericType,), "boolean": (S.BooleanType,), "object": (S.StructType, S.MapType), "array": (S.ArrayType,)}


def load_schemas(spark: SparkSession, folder: str) -> dict[str, dict]:
    """All schemas of a folder, by file name and by $id."""
    out: dict[str, dict] = {}
    for r in spark.read.text(f"{folder}/*.json", wholetext=True).select("value", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name")).collect():
        schema = json.loads(r["value"])
        out[r["name"]] = schema
        if "$id" in schema:
            out[schema["$id"]] = schema
    return out


#: Keywords with a meaning here: those whose values are schemas by name, lists of schemas, schemas, or none of these; and annotations, which have none.
_NAMED = {"properties", "$defs", "definitions"}
_LISTS = {"allOf", "anyOf", "oneOf"}
_SCHEMAS = {"items", "not", "if", "then", "else", "additionalProperties"}
_PLAIN = {"$ref", "type", "enum", "const", "pattern", "minLength", "maxLength", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minItems", "maxItems", "uniqueItems", "required"}
_NOTES = {"$schema", "$id", "$comment", "title", "description", "format", "default", "examples", "deprecated", "readOnly", "writeOnly"}


def refuse_unknown(schema: dict | bool, at: str = "#") -> None:
    """An error for a keyword that would be ignored, wherever it stands in the schema."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"{at} is no schema")
    if unknown := sorted(set(schema) - _NAMED - _LISTS - _SCHEMAS - _PLAIN - _NOTES):
        raise ValueError(f"keywords {unknown} at {at} are not supported")
    for k in _NAMED & set(schema):
        for name, sub in schema[k].items():
            refuse_unknown(sub, f"{at}/{k}/{name}")
    for k in _LISTS & set(schema):
        for i, sub in enumerate(schema[k]):
            refuse_unknown(sub, f"{at}/{k}/{i}")
    for k in _SCHEMAS & set(schema):
        refuse_unknown(schema[k], f"{at}/{k}")
    if isinstance(schema.get("additionalProperties"), dict):
        raise ValueError(f"additionalProperties at {at} can only be true or false")


class Compiler:
    def __init__(self, schema: dict, store: dict[str, dict] | None = None):
        self.root, self.store = schema, store or {}
        for s in [schema, *self.store.values()]:
            refuse_unknown(s)

    def _resolved(self, schema: dict, root: dict) -> tuple[dict, dict]:
        while "$ref" in schema:
            file, _, pointer = schema["$ref"].partition("#")
            if file:
                name = file if file in self.store else file.rsplit("/", 1)[-1]
                root = self.store[name]
            schema = root
            for part in [p for p in pointer.split("/") if p]:
                schema = schema[part.replace("~1", "/").replace("~0", "~")]
        return schema, root

    def errors(self, path: Column, value: Column, kind: S.DataType, schema: dict | bool, root: dict | None = None) -> list[Column]:
        """Columns of type array<string>: path and message of what is broken."""
        root = root or self.root
        if isinstance(schema, bool):
            return [] if schema else [self._said(path, F.lit(True), F.lit("is not allowed"))]
        schema, root = self._resolved(schema, root)
        there, out = value.isNotNull(), []
        out += self._type(path, value, kind, schema)
        shown = self._shown(value, kind)
        if "enum" in schema:
            out.append(self._said(path, there & ~self._among(value, kind, schema["enum"]), F.concat(shown, F.lit(f" is not one of {schema['enum']!r}"))))
        if "const" in schema:
            out.append(self._said(path, there & ~self._among(value, kind, [schema["const"]]), F.lit(f"{schema['const']!r} was expected")))
        if isinstance(kind, S.StringType):
            if "pattern" in schema:
                out.append(self._said(path, there & ~value.rlike(schema["pattern"]), F.concat(shown, F.lit(f" does not match {schema['pattern']!r}"))))
            if "minLength" in schema:
                out.append(self._said(path, F.length(value) < schema["minLength"], F.concat(shown, F.lit(" should be non-empty" if schema["minLength"] == 1 else " is too short"))))
            if "maxLength" in schema:
                out.append(self._said(path, F.length(value) > schema["maxLength"], F.concat(shown, F.lit(" is too long"))))
        if isinstance(kind, S.NumericType):
            for name, broken, words in (("minimum", lambda v: value < v, "less than the minimum of"), ("maximum", lambda v: value > v, "greater than the maximum of"), ("exclusiveMinimum", lambda v: value <= v, "less than or equal to the minimum of"), ("exclusiveMaximum", lambda v: value >= v, "greater than or equal to the maximum of"), ("multipleOf", lambda v: F.pmod(value, F.lit(v)) != 0, "not a multiple of")):
                if name in schema:
                    out.append(self._said(path, broken(schema[name]), F.concat(shown, F.lit(f" is {words} {schema[name]}"))))
        if isinstance(kind, S.ArrayType):
            if "minItems" in schema:
                out.append(self._said(path, there & (F.size(value) < schema["minItems"]), F.lit("[] should be non-empty" if schema["minItems"] == 1 else "is too short")))
            if "maxItems" in schema:
                out.append(self._said(path, there & (F.size(value) > schema["maxItems"]), F.lit("is too long")))
            if schema.get("uniqueItems"):
                out.append(self._said(path, F.size(F.array_distinct(value)) < F.size(value), F.lit("has non-unique elements")))
            if "items" in schema:
                inner = lambda x, i: self._all(self.errors(F.concat(path, F.lit("."), i.cast("string")), x, kind.elementType, schema["items"], root))
                out.append(F.when(there, F.flatten(F.transform(value, inner))))
        if isinstance(kind, S.StructType):
            out += self._struct(path, value, kind, schema, root)
        out += self._combined(path, value, kind, schema, root)
        return out

    def _struct(self, path, value, kind, schema, root) -> list[Column]:
        have, there, out = {f.name: f.dataType for f in kind}, value.isNotNull(), []
        at = lambda name: F.concat(F.when(path == "", "").otherwise(F.concat(path, F.lit("."))), F.lit(name))
        properties = schema.get("properties", {})
        for name in schema.get("required", []):
            part = value[name] if name in have else F.lit(None)
            if name not in have or not self._nullable(properties.get(name, True), root):
                out.append(self._said(path, there & part.isNull(), F.lit(f"{name!r} is a required property")))
        if schema.get("additionalProperties") is False:
            for name in have:
                if name not in properties:
                    out.append(self._said(path, there & value[name].isNotNull(), F.lit(f"Additional properties are not allowed ({name!r} was unexpected)")))
        for name, sub in properties.items():
            if name in have:
                out += [F.when(value[name].isNotNull(), e) for e in self.errors(at(name), value[name], have[name], sub, root)]
        return out

    def _combined(self, path, value, kind, schema, root) -> list[Column]:
        fits = lambda sub: F.size(self._all(self.errors(path, value, kind, sub, root))) == 0
        out = [e for sub in schema.get("allOf", []) for e in self.errors(path, value, kind, sub, root)]
        number = lambda subs: sum(fits(s).cast("int") for s in subs)
        if "oneOf" in schema:
            out.append(self._said(path, value.isNotNull() & (number(schema["oneOf"]) != 1), F.lit("is not valid under exactly one of the given schemas")))
        if "anyOf" in schema:
            out.append(self._said(path, value.isNotNull() & (number(schema["anyOf"]) == 0), F.lit("is not valid under any of the given schemas")))
        if "not" in schema:
            out.append(self._said(path, fits(schema["not"]) & (value.isNotNull() | F.lit(self._nullable(schema["not"], root))), F.lit("should not be valid under the schema that it must not have")))
        if "if" in schema:
            test = self._holds(path, value, kind, schema["if"], root)
            for name, when in (("then", test), ("else", ~test)):
                if name in schema:
                    out += [F.when(when, e) for e in self._conditional(path, value, kind, schema[name], root)]
        return out

    def _holds(self, path, value, kind, schema, root) -> Column:
        """Whether an "if" applies; a property that is null is null, not missing."""
        if not isinstance(kind, S.StructType) or isinstance(schema, bool):
            return F.size(self._all(self.errors(path, value, kind, schema, root))) == 0
        have, test = {f.name: f.dataType for f in kind}, F.lit(True)
        for name, sub in schema.get("properties", {}).items():
            allowed = sub.get("enum", [sub["const"]] if "const" in sub else None)
            if name not in have:
                test = test & F.lit(allowed is None or None in allowed)
            elif allowed is not None:
                test = test & F.coalesce(self._among(value[name], have[name], allowed), F.lit(None in allowed))
            else:
                test = test & self._holds(path, value[name], have[name], sub, root)
        rest = {k: v for k, v in schema.items() if k != "properties"}
        return test & (F.size(self._all(self.errors(path, value, kind, rest, root))) == 0) if rest else test

    def _conditional(self, path, value, kind, schema, root) -> list[Column]:
        """Errors of a branch, in which properties may be required to be null or not to be."""
        if not isinstance(kind, S.StructType) or isinstance(schema, bool):
            return self.errors(path, value, kind, schema, root)
        have, out = {f.name: f.dataType for f in kind}, self.errors(path, value, kind, {k: v for k, v in schema.items() if k != "properties"}, root)
        for name, sub in schema.get("properties", {}).items():
            if name not in have:
                continue
            at, part = F.concat(F.when(path == "", "").otherwise(F.concat(path, F.lit("."))), F.lit(name)), value[name]
            if sub.get("not") == {"type": "null"}:
                out.append(self._said(at, part.isNull(), F.lit("None should not be valid under {'type': 'null'}")))
            elif sub.get("type") == "null":
                out.append(self._said(at, part.isNotNull(), F.lit("is not of type 'null'")))
            else:
                out += self._conditional(at, part, have[name], sub, root)
        return out

    def _type(self, path, value, kind, schema) -> list[Column]:
        if "type" not in schema:
            return []
        types = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        if any(isinstance(kind, c) for t in types for c in _KINDS.get(t, ())):
            return []
        whole = "integer" in types and isinstance(kind, S.FractionalType)
        bad = value != F.floor(value) if whole else value.isNotNull()
        return [self._said(path, bad, F.concat(self._shown(value, kind), F.lit(f" is not of type {', '.join(map(repr, types))}")))]

    def _nullable(self, schema: dict | bool, root: dict) -> bool:
        if isinstance(schema, bool):
            return schema
        schema, root = self._resolved(schema, root)
        for name in ("oneOf", "anyOf"):
            if name in schema:
                return any(self._nullable(s, root) for s in schema[name])
        types = schema.get("type", [])
        if "enum" in schema and None not in schema["enum"] or "const" in schema and schema["const"] is not None:
            return False
        return not types or "null" in (types if isinstance(types, list) else [types])

    @staticmethod
    def _among(value: Column, kind: S.DataType, allowed: list) -> Column:
        fit = [x for x in allowed if x is not None and isinstance(x, bool) == isinstance(kind, S.BooleanType) and isinstance(x, str) == isinstance(kind, S.StringType)]
        return value.isin(*fit) if fit else F.lit(False)

    @staticmethod
    def _shown(value: Column, kind: S.DataType) -> Column:
        if isinstance(kind, S.StringType):
            return F.concat(F.lit("'"), value, F.lit("'"))
        return F.coalesce((F.to_json(value) if isinstance(kind, (S.StructType, S.ArrayType, S.MapType)) else value).cast("string"), F.lit("None"))

    @staticmethod
    def _said(path: Column, broken: Column, message: Column) -> Column:
        return F.when(F.coalesce(broken, F.lit(False)), F.array(F.concat(F.when(path == "", "(root)").otherwise(path), F.lit(": "), message)))

    @staticmethod
    def _all(errors: list[Column]) -> Column:
        none = F.array().cast("array<string>")
        return F.flatten(F.array(none, *[F.coalesce(e, none) for e in errors]))


def schema_errors(rows: DataFrame, schema: dict, store: dict[str, dict] | None = None) -> Column:
    """Messages, by path, of what each row breaks."""
    c = Compiler(schema, store)
    value = F.struct(*[F.col(f"`{n}`").alias(n) for n in rows.columns])
    return F.array_sort(c._all(c.errors(F.lit(""), value, rows.schema, schema)))


def validate_schema(rows: DataFrame, schema: dict, store: dict[str, dict] | None = None) -> DataFrame:
    """rows with errors and valid."""
    return rows.withColumn("errors", schema_errors(rows, schema, store)).withColumn("valid", F.size("errors") == 0)
