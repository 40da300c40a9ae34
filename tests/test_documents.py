import json

import pytest
from pyspark.sql import functions as F

from notewright.functions import documents

TEXTS = [
    '{"a": 1, "out": "x"}', '{"out": null, "b": {"out": "never"}}', '{"b": {"out": null, "c": {"out": "skipped"}}, "d": {"out": [1, {"k": "v"}]}}', '[{"n": []}, [[{"dir": {"p": "q"}}]]]', '{"z": {"z": {"z": {"dir": 1.50}}}, "a": {"out": 2}}',
    '{"s": "{\\"out\\": 1}", "t": ["[\\"out\\"]"]}', '{}', "[]", '"out"', "no json", "", None, '{"a": [{"b": 1}, {"out": true}, {"out": false}], "out": "last"}', '{"a": {"x": 1, "dir": null, "out": "cut"}, "out": "é\\"q"}',
]


def first(data, keys):
    """The search as one would write it over loaded documents."""
    values = data.items() if isinstance(data, dict) else ((None, v) for v in data) if isinstance(data, list) else ()
    for k, v in values:
        if k in keys:
            return v
        found = first(v, keys)
        if found is not None:
            return found
    return None


def loaded(t):
    try:
        return json.loads(t)
    except (TypeError, ValueError):
        return None


def test_first_key(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, j string")
    got = dict(df.select("i", documents.first_key(F.col("j"), ["out", "dir"])).collect())
    for i, t in enumerate(TEXTS):
        want = first(loaded(t), {"out", "dir"})
        if isinstance(want, str) or want is None:
            assert got[i] == want, t
        else:
            assert json.loads(got[i]) == want, t


def test_depth_is_no_silent_limit(spark):
    deep = '{"a":' * 6 + '{"k":1}' + "}" * 6
    df = spark.createDataFrame([(deep,)], "j string")
    assert df.select(documents.first_key(F.col("j"), ["k"], depth=7)).first()[0] == "1"
    for c in (documents.first_key(F.col("j"), ["k"], depth=6), documents.nodes(F.col("j"), depth=6)):
        with pytest.raises(Exception, match="deeper than 6 levels"):
            df.select(c).collect()


def test_contents(spark):
    rows = [("f", '{"a": 1, "b": [1, "x", null]}'), ("f", '{"a": null}'), ("f", "broken {"), ("g", '{"a": {"c": true}, "b": []}'), ("g", None)]
    df = spark.createDataFrame(rows, "file string, j string")
    got = {(r.file, r.path): (r.rows, r["values"], r.types) for r in documents.contents(df, "j", ["file"]).collect()}
    assert got == {
        ("f", "$"): (2, 2, ["object"]), ("f", "$.a"): (2, 2, ["null", "number"]), ("f", "$.b"): (1, 1, ["array"]), ("f", "$.b[]"): (1, 3, ["null", "number", "string"]),
        ("g", "$"): (1, 1, ["object"]), ("g", "$.a"): (1, 1, ["object"]), ("g", "$.a.c"): (1, 1, ["boolean"]), ("g", "$.b"): (1, 1, ["array"]),
    }
    shapes = {r.file: r for r in documents.shape(df, "j", ["file"]).collect()}
    assert (shapes["f"].parsed, shapes["f"].failed, shapes["g"].parsed) == (2, 1, 1)
    assert shapes["g"].schema == "OBJECT<a: OBJECT<c: BOOLEAN>, b: ARRAY<VOID>>"
    assert documents.contents(df.limit(0), "j").count() == 0
