"""Readers and writers at the edges: CSV with line breaks in fields, JSON lines, envelopes, zipped members, keyed loads."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import archive

NOTE_SCHEMA = "note_id string, subject_id long, hadm_id long, note_type string, note_seq long, charttime string, storetime string, text string"
DETAIL_SCHEMA = "note_id string, subject_id long, field_name string, field_value string, field_ordinal long"
PATIENT_COLUMNS = ["subject_id", "gender", "anchor_age", "anchor_year", "anchor_year_group", "dod"]


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, *, rows: int | None = None, partitions: int | None = None) -> DataFrame:
    """CSV (gz too) whose quoted fields may hold line breaks. A gz file is one task to read: partitions deals it out afterwards."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.limit(rows) if rows is not None else df
    return df.repartition(partitions) if partitions else df


def read_text_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV as strings only, empty for missing."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.na.fill("")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, *, strict: bool = True) -> DataFrame:
    """JSON lines; strict fails on a malformed line, else it is dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_rows(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """By suffix: JSON lines, CSV, or a JSON document that is a list or holds one under rows, data or mentions."""
    suffix = Path(path).suffix
    if suffix == ".jsonl":
        return read_jsonl(spark, path, schema)
    if suffix == ".csv":
        return read_csv(spark, path, schema)
    if suffix != ".json":
        raise ValueError(f"no reader for {suffix or path}")
    fields = schema if isinstance(schema, str) else schema.simpleString()[7:-1].replace(":", " ")
    inner = f"array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in fields.split(','))}>>"
    text = spark.read.text(path, wholetext=True)
    bare = F.ltrim(F.col("value")).startswith("[")
    env = F.from_json("value", f"rows {inner}, data {inner}, mentions {inner}")
    rows = F.when(bare, F.from_json("value", inner)).otherwise(F.coalesce(env["rows"], env["data"], env["mentions"]))
    return text.select(F.explode(rows).alias("r")).select("r.*")


def read_discharge(spark: SparkSession, path: str, *, rows: int | None = None, partitions: int | None = None) -> DataFrame:
    """Discharge notes, whose text is in a column text or note_text; others are strings."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    name = "text" if "text" in df.columns else "note_text"
    df = df.withColumn("subject_id", F.col("subject_id").try_cast("long")).withColumnRenamed(name, "text")
    df = df.limit(rows) if rows is not None else df
    return df.repartition(partitions) if partitions else df


def read_document(spark: SparkSession, path: str) -> dict:
    """One JSON document (a manifest, a graph), wherever Spark can read it."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def read_results(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """variant, value: the JSON documents of a folder, a row each, by their names without prefix and suffix."""
    docs = spark.read.text(path, wholetext=True)
    return with_file_key(docs, rf"^{re.escape(prefix)}(.*)\.json$", ["variant"]).filter("variant is not null").select("variant", "value")


def required_rows(df: DataFrame, fields: list[str], **lineage: str) -> DataFrame:
    """df with columns of lineage. No rows at all are an error at once, a blank field is one when it is read."""
    if df.isEmpty():
        raise ValueError("no rows")
    ok = F.lit(True)
    for f in fields:
        blank = F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) == ""
        ok = ok & F.when(blank, F.raise_error(F.lit(f"blank {f}")).cast("boolean")).otherwise(True)
    return df.filter(ok).withColumns({k: F.lit(v) for k, v in lineage.items()})


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], *, force: bool = False) -> DataFrame:
    """What build makes, written to path the first time and read from there."""
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if force or not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def unique_by(df: DataFrame, key: str) -> DataFrame:
    """df, which fails when it is read if a key is empty or repeated."""
    n = df.groupBy(key).agg(F.count("*").alias("u_n"))
    bad = F.coalesce(F.col(key).cast("string"), F.lit("")) == ""
    j = df.join(n, key, "left").withColumn("u_ok", F.when(bad, F.raise_error(F.lit(f"empty {key}"))).when(F.col("u_n") > 1, F.raise_error(F.concat(F.lit(f"repeated {key}: "), F.col(key).cast("string")))).otherwise(True))
    return j.filter("u_ok").drop("u_n", "u_ok")


def with_file_key(df: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """df with columns cut from its files' names by the groups of pattern (null where a name does not match)."""
    file = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return df.select("*", *[F.nullif(F.regexp_extract(file, pattern, i + 1), F.lit("")).alias(n) for i, n in enumerate(names)])


def read_split(spark: SparkSession, folder: str, splits: list[str], schema: str | T.StructType) -> DataFrame:
    """folder/<split>.jsonl of every split, tagged with source_split."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json([f"{folder}/{s}.jsonl" for s in splits])
    return with_file_key(df, r"^(.*)\.jsonl$", ["source_split"])


def read_zip_member(spark: SparkSession, zip_path: str, name: str, to: str | None, schema: str | T.StructType, columns: list[str] | None = None) -> DataFrame:
    """The member of that file name with the shortest path, read on executors (see archive.py); nothing is unpacked, to is not used any more."""
    for path in archive.archives(zip_path):
        archive.parts_of(path, name, 0)
    df = archive.read_member(spark, zip_path, name, schema)
    return df.select(*columns) if columns else df


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line, null fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_document(spark: SparkSession, payload: dict, path: str) -> None:
    """One JSON document, indented, to wherever Spark can write."""
    spark.createDataFrame([(json.dumps(payload, ensure_ascii=False, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_csv_union(parts: list[DataFrame], path: str) -> None:
    """CSV of several tables, with the columns of all in the order in which they are first seen."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    write_csv(out, path)


def observed(df: DataFrame, write: Callable[[DataFrame], None], **metrics: Column) -> dict:
    """Writes df and returns metrics of what was written, gathered by the writing tasks that count in the end (one retried counts once); no row is read again."""
    seen = Observation()
    write(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]))
    return seen.get


def write_probabilities(df: DataFrame, path: str, *, split: str, source_path: str, truncated: bool = False) -> dict:
    """sample_id, probability, label of every row as JSON lines; returns the entry of a manifest, counted while writing."""
    out = df.select("sample_id", F.col("probability").cast("double").alias("probability"), "label", F.lit(split).alias("split"))
    p = F.col("probability")
    seen = observed(out, lambda x: write_jsonl(x, path), rows=F.count("*"), missing=F.count_if(p.isNull()), lowest=F.min(p), highest=F.max(p))
    return {"split": split, "path": path, "source_path": source_path, "truncated": truncated, **seen}


def write_gates(df: DataFrame, path: str) -> None:
    """A row to every gate that it passed, and by split: partitions gate/split."""
    df.withColumn("gate", F.explode("passed_gates")).write.mode("overwrite").partitionBy("gate", "split").parquet(path)
