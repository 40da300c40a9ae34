"""Making the package importable on executors, and the folder that they share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent
_WRITTEN: list[str] = []


def ship(spark: SparkSession) -> None:
    """Send the package to executors, unless their PYTHONPATH or working folder has it already."""
    top = ROOT.parent
    context = spark.sparkContext
    on_path = {Path(p or ".").resolve() for p in [*os.environ.get("PYTHONPATH", "").split(":"), "."]}
    if top in on_path or getattr(context, "_notewright", False):
        return
    path = Path(tempfile.mkdtemp(prefix="notewright-")) / "notewright.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in ROOT.rglob("*.py"):
            z.write(f, f.relative_to(top))
    context.addPyFile(str(path))
    context._notewright = True


def workdir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); a local one of this process only where that is unset and the master is local."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not hasattr(workdir, "own"):
        workdir.own = "file://" + tempfile.mkdtemp(prefix="notewright-")
        atexit.register(shutil.rmtree, workdir.own.removeprefix("file://"), ignore_errors=True)
    return workdir.own


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: computed once, and not lost with an executor."""
    path = f"{workdir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes what written() wrote in this process, and says how many tables; call it when all results that read them have been used."""
    gone = len(_WRITTEN)
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone
