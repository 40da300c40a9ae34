"""Derived tables that know what they were derived from, and manifests counted while writing."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import observed, write_document, write_jsonl

_FINGERPRINT = "_fingerprint"


def fingerprint(df: DataFrame) -> str:
    """Names a table's content by its plan and its input files (path, length, time of change), read from the plan and the file system, not from data.

    Numbers of expressions and plans are taken out, so that the same code over the same files gives the same name in another session."""
    spark = df.sparkSession
    plan = re.sub(r"#\d+L?|plan_id=\d+|\bid=\d+|@[0-9a-f]+", "", df._jdf.queryExecution().analyzed().toString())
    files = []
    for f in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        files.append([f, status.getLen(), status.getModificationTime()])
    return hashlib.sha256(json.dumps([plan, files, df.schema.jsonValue()]).encode()).hexdigest()


def _there(spark: SparkSession, path: str) -> str | None:
    """The fingerprint beside a table that was written whole."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_FINGERPRINT}")
    system = done.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(done) or not system.exists(mark):
        return None
    stream = system.open(mark)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def stored(df: DataFrame, path: str, *, salt: str = "", force: bool = False) -> DataFrame:
    """df, read from path if what lies there was made by the same plan of the same files, else written there first.

    salt names what a plan doesn't show: the code of a Python function, a model. The fingerprint is written last."""
    spark, name = df.sparkSession, hashlib.sha256(f"{fingerprint(df)}|{salt}".encode()).hexdigest()
    if force or _there(spark, path) != name:
        df.write.mode("overwrite").parquet(path)
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_FINGERPRINT}")
        stream = mark.getFileSystem(spark._jsc.hadoopConfiguration()).create(mark, True)
        stream.write(bytearray(name.encode()))
        stream.close()
    return spark.read.schema(df.schema).parquet(path)


def write_manifest(parts: dict[str, DataFrame], folder: str, *, label: str, write: Callable[[DataFrame, str], None] = write_jsonl, seed: int | None = None) -> dict:
    """Each part (a split, a task) to folder/<name>, and folder/manifest, which says of each its rows, distinct labels and bytes of text; one pass over each."""
    spark = next(iter(parts.values())).sparkSession
    entries = {}
    for name, df in parts.items():
        entries[name] = observed(df, lambda x, n=name: write(x, f"{folder}/{n}"), rows=F.count("*"), labelled=F.count(label), labels=F.array_sort(F.collect_set(F.col(label).cast("string"))))
    manifest = {"parts": entries, "rows": sum(e["rows"] for e in entries.values()), "seed": seed}
    write_document(spark, manifest, f"{folder}/manifest")
    return manifest
