"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a local one only where that is unset."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="notewright-")
        atexit.register(lambda: __import__("shutil").rmtree(own.removeprefix("file://"), ignore_errors=True))
    return own


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what materialise() wrote. Call only after every result that reads it has been consumed."""
    keep = []
    for owner, path in _WRITTEN:
        if owner is not spark:
            keep.append((owner, path))
            continue
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    _WRITTEN[:] = keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables under sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def refuse(df: DataFrame, *names: str) -> None:
    """Columns that an operator adds may not be there already, nor any that begins with nw_."""
    if taken := [c for c in df.columns if c.lower() in names or c.lower().startswith("nw_")]:
        raise ValueError(f"columns {taken} are taken")


def crc_remainder(col: Column, mod: int) -> Column:
    """crc32 of the value written as text, modulo mod (null: null)."""
    return F.crc32(col.cast("string").cast("binary")) % mod


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """Bytes of all texts; sizes blocks so that they stay equal as the input grows."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0


def block_of(key: Column, text: Column, blocks: int) -> Column:
    """An even block number for a document; a repeated key spreads by its text length."""
    return F.pmod(F.xxhash64(key, F.length(text)), F.lit(blocks)).cast("int")


def hot_keys(counts: DataFrame, key: str, n: str, rows: int, share: int = 256) -> list:
    """Keys that hold one in share of all rows, of which there are at most share: they are worth splitting over tasks."""
    return [r[0] for r in counts.filter(F.col(n) > max(rows // share, 100)).select(key).limit(share).collect()]


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: list, spread: Column, salts: int = 64) -> DataFrame:
    """Inner join on key, in which right has few rows a key: left's rows of a hot key are dealt to salts tasks by spread, right's are sent to each."""
    if not hot:
        return left.join(right, key)
    is_hot = F.coalesce(F.col(key).isin(*hot), F.lit(False))
    a = left.withColumn("nw_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    b = right.withColumn("nw_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return a.join(b, [key, "nw_salt"]).drop("nw_salt")
