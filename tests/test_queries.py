"""Every query of the library against its SQL in a second engine, and edges: sources, streams, removed folders."""

import json
import math
import shutil
import subprocess
import sys
import zipfile
from pathlib import Path

import duckdb
import pytest

from notewright.plans.catalog import QUERIES, SQL
from notewright.sources import tables

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return round(float(v), 6) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert rows
    if name in SQL:
        got = duck.execute(SQL[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == columns
        other = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in got.fetchall()), key=repr)
        assert rows == other


@needs_data
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_corpus_operators(tmp_path):
    """The rest imports and lists its queries when the corpus folders and the pipeline are gone."""
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flat_rules' in q and not [k for k in q if k.startswith('op') and k[2].isdigit()]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={"PATH": "/usr/bin:/bin"})


def test_csv_with_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('note_id,subject_id,hadm_id,note_type,note_seq,charttime,storetime,text\n1-RR-1,1,,RR,1,,,"two\nlines, ""quoted"""\n')
    r = tables.read_csv(spark, f"{tmp_path}/a.csv", tables.NOTE_SCHEMA).collect()
    assert len(r) == 1 and r[0].text == 'two\nlines, "quoted"'
    assert tables.read_text_rows(spark, f"{tmp_path}/a.csv").first().hadm_id == ""


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1, "v": "x"}\n\nnot json\n')
    assert tables.read_jsonl(spark, f"{tmp_path}/a.jsonl", "k int, v string", strict=False).count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_jsonl(spark, f"{tmp_path}/a.jsonl", "k int, v string").collect()
    for name, doc in (("list", [{"k": 1}]), ("rows", {"rows": [{"k": 1}]}), ("data", {"data": [{"k": 1}]}), ("mentions", {"mentions": [{"k": 1}]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
        assert tables.read_rows(spark, f"{tmp_path}/{name}.json", "k int").collect()[0].k == 1
    with pytest.raises(ValueError):
        tables.read_rows(spark, "a.xml", "k int")


def test_unique_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert tables.unique_by(df, "k").count() == 2
    with pytest.raises(Exception, match="repeated k"):
        tables.unique_by(df.union(df), "k").collect()
    with pytest.raises(Exception, match="empty v"):
        tables.unique_by(spark.createDataFrame([(1, "")], "k int, v string"), "v").collect()


def test_zip_and_splits(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("deep/er/p.csv", "subject_id,gender\n9,F\n")
        z.writestr("p.csv", "subject_id,gender\n1,M\n")
    df = tables.read_zip_member(spark, f"{tmp_path}/z.zip", "p.csv", str(tmp_path), "subject_id int, gender string", ["gender"])
    assert [r.gender for r in df.collect()] == ["M"]
    with pytest.raises(FileNotFoundError):
        tables.read_zip_member(spark, f"{tmp_path}/z.zip", "q.csv", str(tmp_path), "a int")
    for s in ("train", "val"):
        (tmp_path / f"{s}.jsonl").write_text('{"k": 1}\n')
    assert sorted(r.source_split for r in tables.read_split(spark, str(tmp_path), ["train", "val"], "k int").collect()) == ["train", "val"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, ["G1", "G2"], "train")], "k int, v string, passed_gates array<string>, split string")
    tables.write_jsonl(df, f"{tmp_path}/j")
    assert '"v":null' in "".join(f.read_text() for f in Path(f"{tmp_path}/j").glob("*.json"))
    tables.write_gates(df, f"{tmp_path}/g")
    assert sorted(r.gate for r in spark.read.parquet(f"{tmp_path}/g").collect()) == ["G1", "G2"]


def test_streams(spark, tmp_path):
    from notewright.operators.radiology import facts
    from notewright.streaming import notes as stream

    df = spark.createDataFrame([("1-RR-1", 1, "CT CHEST", "FINDINGS: 4 mm nodule.")], "note_id string, subject_id int, exam_name string, text string")
    df.write.parquet(f"{tmp_path}/n")
    q = stream.stream_radiology_facts(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/n")).writeStream.format("memory").queryName("facts_out").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select nodules from facts_out").collect() == facts(df).select("nodules").collect()
    ev = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' event_type, 1.0D value union all select timestamp'2024-01-01 00:20:00', 'a', 2.0D")
    assert [(r.n, r.total) for r in stream.event_windows(ev).collect()] == [(2, 3.0)]


@needs_data
@pytest.mark.parametrize("name", ["graph_vs_flat", "case_subsets", "mismatch_classes", "drift_profile"])
def test_notes_are_read_once(spark, name):
    """Mentions are cut before what is written, so no plan of what reads it has their pattern."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "granuloma" not in plan


@needs_data
def test_full_text_mentions_are_read_in_columns(spark):
    """Patterns of a mention are compiled code over a row's column, not a lambda's."""
    plan = QUERIES["full_text_variant"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "part\\s*[- ]?solid" in plan and not [x for x in plan.split("lambdafunction")[1:] if "partially" in x.split("explode")[0]]
