"""A training corpus from raw documents: quality, lines, near-duplicates, benchmarks, mixture.

Each stage takes (spark, docs, sf_dir) and is written and read again before the next.
All but the last return the columns of documents; n_chars follows the text. Rows are
dropped only by a stage's own decision: null ids and null texts go through like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.llm.common import crc_remainder, materialise, table
from notewright.llm.decontaminate import decontaminate
from notewright.llm.line_dedup import line_dedup
from notewright.llm.mixing import mix_sources
from notewright.llm.near_dedup import near_duplicate_groups
from notewright.llm.quality import quality_scores, train_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as good."""
    model = train_quality(docs, table(spark, sf_dir, "labels"), crc_remainder(F.col("doc_id"), 5) != 0)
    return quality_scores(docs, model).filter("nw_predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates."""
    out = line_dedup(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("nw_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near-duplicates (a null id is the greatest); equal rows are one."""
    keyed = docs.withColumn("nw_hash", F.xxhash64("text"))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("nw_hash").alias("hash"))
    groups = near_duplicate_groups(keyed.withColumn("nw_row", row), id_col="nw_row", shingle=5, percent=80)
    kept = groups.filter("kept").select(F.col("doc_id.id").alias("nw_id"), F.col("doc_id.hash").alias("nw_kept")).distinct()
    left = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("nw_id")) & F.col("nw_hash").eqNullSafe(F.col("nw_kept")), "left_semi")
    return left.dropDuplicates(["doc_id", "nw_hash"]).select(*docs.columns)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("nw_matches") == 0).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their source's weight, in random order, with copy and shuffle_key."""
    return mix_sources(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmarks),
    ("mixing sources", mixture),
]

#: The classifier is fitted and groups are components: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
