"""The corpus queries with production parameters, and their SQL where SQL can say the same.

Each reads its whole table and gives its operator's edge cases as they are stated there: null and empty texts have a
row, rows that repeat a doc_id are rows of their own, other columns are not looked at, an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_tokens
from .ann import nearest_neighbours
from .common import crc_remainder, table
from .decontaminate import decontaminate
from .divergence import source_divergence
from .line_dedup import line_dedup
from .lm_score import lm_scores
from .mixing import mix_sources
from .near_dedup import near_duplicate_groups
from .packing import pack_examples
from .pii import pii_spans
from .quality import quality_scores, train_quality
from .secret_scan import secret_scan
from .sql import SQL  # noqa: F401
from .substring_dedup import substring_dedup


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file, the same on every machine of a cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.transform("nw_matches", lambda m: m["item_id"])
    best = F.array_max(F.transform("nw_matches", lambda m: m["similarity"]))
    return found.select("doc_id", (F.size("nw_matches") > 0).alias("contaminated"), ids.alias("item_ids"), F.round(best, 9).alias("similarity"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_remainder(F.col("doc_id"), 5) == 0
    scored = quality_scores(docs, train_quality(docs, labels, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("nw_score").alias("score"), F.col("nw_predicted").alias("predicted"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents"), digest=True).drop("all_spans")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents")).drop("found")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), window=35, digest=True)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("nw_lines").alias("n_lines"), F.col("nw_dropped").alias("n_dropped"), F.col("text").alias("kept_text"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    # words are spelled by three bytes, of which there are so few in any corpus that the model is the same kind at every size
    return lm_scores(table(spark, sf_dir, "documents"), crc_remainder(F.col("doc_id"), 7) == 2, order=3)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_examples(table(spark, sf_dir, "documents"), tokenizer=vocabulary("word_bpe_49k.json"), length=2048, digest=True)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"), byte_level=vocabulary("byte_bpe_50k.json"), pieces=vocabulary("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_lm_score": op5_lm_score,
    "op6_mixing": op6_mixing,
    "op7_decontaminate": op7_decontaminate,
    "op8_quality": op8_quality,
    "op9_pii": op9_pii,
    "op10_near_dedup": op10_near_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_packing": op12_packing,
    "op13_token_alignment": op13_token_alignment,
}