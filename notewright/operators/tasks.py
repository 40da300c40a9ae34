"""Tasks on mentions: their rows and label vectors, rule predictions, prediction records with where they are from, and abstentions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T
from .metrics import rate
from .reports import highest_probability

#: Labels by task, in the order in which they are counted.
DENSITIES = ("solid", "part_solid", "ground_glass", "calcified")
LOBES = ("RUL", "RML", "RLL", "LUL", "LLL", "lingula", "bilateral")


@dataclass(frozen=True)
class Task:
    """Field that holds a mention's label, all labels in order, the label of rows whose field says none of them, and the metric that fits are chosen by."""

    field: str
    labels: tuple[str, ...]
    default: str
    metric: str = "macro_f1"

    def label(self) -> Column:
        c = F.col(self.field)
        if self.labels == ("no_size", "has_size"):
            return F.when(F.coalesce(c.cast("boolean"), F.lit(False)), "has_size").otherwise("no_size")
        return F.when(c.isin(*self.labels), c).otherwise(self.default)

    def index(self, label: Column) -> Column:
        """Position of a label among the task's, from 0; null for others."""
        at = F.array_position(F.array(*[F.lit(x) for x in self.labels]), label)
        return F.when(at > 0, (at - 1).cast("int"))


TASKS = {
    "density": Task("density_label", (*DENSITIES, "unclear"), "unclear"),
    "size": Task("has_size", ("no_size", "has_size"), "no_size", "f1"),
    "location": Task("location_label", (*LOBES, "unclear", "no_location"), "no_location"),
    "density_stage1": Task("density_stage1_label", ("explicit_density", "unclear_or_no_evidence"), "unclear_or_no_evidence", "auprc"),
    "density_stage2": Task("density_stage2_label", DENSITIES, "solid"),
}
SPLITS = ("train", "val", "test")


def labelled(rows: DataFrame, task: str, *, text: str = "mention_text") -> DataFrame:
    """rows with input (the text field, else the mention, else empty), label and y, its position."""
    t = TASKS[task]
    given = F.nullif(F.col(text), F.lit(""))
    return rows.withColumns({"input": F.coalesce(given, F.col("mention_text"), F.lit("")), "label": t.label()}).withColumn("y", t.index(F.col("label")))


def task_splits(spark: SparkSession, folder: str, task: str, schema: str | S.StructType, *, text: str = "mention_text") -> DataFrame:
    """folder/<task>_<split>.jsonl of all three splits as one table with split, input, label and y; a malformed line or a missing split is an error."""
    read = None
    for name in SPLITS:
        one = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{folder}/{task}_{name}.jsonl").withColumn("split", F.lit(name))
        read = one if read is None else read.unionByName(one)
    return labelled(read, task, text=text)


def plain_density(c: Column) -> Column:
    """A density as it is written to its label, if it is one: case, blanks and hyphens do not matter."""
    t = F.translate(F.lower(T.strip(c)), "- ", "__")
    return F.when(t == "partsolid", "part_solid").when(t.isin("groundglass", "ggo"), "ground_glass").otherwise(t)


def rule_prediction(task: str, text: Column) -> Column:
    """What the patterns alone say of a mention, as a label of the task: density, size or location."""
    if task == "density":
        d = T.density(text)["value"]
        return F.when(d.isin(*TASKS[task].labels), d).otherwise("unclear")
    if task == "size":
        return F.when(T.size(text)["value"].isNotNull(), "has_size").otherwise("no_size")
    if task == "location":
        place = T.location(text)["value"]
        return F.when(place.isin(*TASKS[task].labels), place).when(place.isNull(), "no_location").otherwise("unclear")
    raise ValueError(f"no rules for {task}")


#: Columns that a prediction record carries over from its mention, if they are there.
CARRIED = ("subject_id", "mention_text", "source_split", "source_path", "anchor_file", "anchor_source_path", "alignment_key_used", "label_quality")


def _records(rows: DataFrame, task: str, model: str, own: dict[str, Column]) -> DataFrame:
    have = set(rows.columns)
    of = lambda c, other=None: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), other) if c in have and other is not None else F.col(c) if c in have else other if other is not None else F.lit(None).cast("string")
    return rows.select(
        of("case_id", F.col("noted_case_id") if "noted_case_id" in have else None).alias("case_id"), of("report_id", F.col("note_id")).alias("report_id"), "note_id", "sample_id", of("mention_id", F.col("sample_id")).alias("mention_id"),
        *[of(c).alias(c) for c in CARRIED], F.lit(task).alias("task"), F.lit(model).alias("model_tag"), *[c.alias(k) for k, c in own.items()],
    )


def with_case(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """rows with noted_case_id: the case of their note. cases: note_id, case_id, one row a note."""
    return rows.join(cases.select("note_id", F.col("case_id").alias("noted_case_id")), "note_id", "left")


def exported(rows: DataFrame, task: str, model: str, *, predictions: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """A prediction record for each mention of a task, with its source, what failed and whether a model has still to be run.

    predictions: sample_id, label, probability (and split, path) of a model; of several rows of a mention the one of highest probability. Without them, or for mentions that have none,
    the record is constructed from the mention's own label and says so. For size a label follows from the probability and threshold."""
    none = lambda t: F.lit(None).cast(t)
    if predictions is not None:
        rows = rows.join(highest_probability(predictions, "sample_id", "probability").select("sample_id", F.col("label").alias("m_label"), F.col("probability").alias("m_p")), "sample_id", "left")
    else:
        rows = rows.withColumn("m_label", none("string")).withColumn("m_p", none("double"))
    known = F.col("m_p").isNotNull()
    if task == "size":
        own = TASKS["size"].label()
        label = F.when(known, F.when(F.col("m_p") >= threshold, "has_size").otherwise("no_size")).otherwise(own)
        gold, source, failure = own, "constructed_fact_only_no_probability", "has_size_probability_missing_for_this_split"
    elif task == "location":
        gold = F.col("location_label")
        label = F.when(known, F.col("m_label")).otherwise(F.when(gold.isin(*LOBES), gold))
        source, failure = "constructed_fact_not_final_model", "final_location_per_sample_predictions_missing_or_model_dir_absent_locally"
    else:
        d = plain_density(F.col("density_label"))
        explicit = F.coalesce(d.isin(*DENSITIES), F.lit(False))
        stage1 = F.when(explicit, "explicit_density").otherwise("unclear_or_no_evidence")
        gold = stage1 if task == "density_stage1" else d
        label = F.when(known, F.col("m_label")).otherwise(stage1 if task == "density_stage1" else F.when(explicit, d))
        source, failure = "constructed_fact_not_final_model", f"final_{task}_per_sample_predictions_missing_or_model_dir_absent_locally"
    made = "final_model_probability_file" if task == "size" else "final_model"
    return _records(rows, task, model, {
        "predicted_label": label, "probability": F.col("m_p"), "confidence": F.col("m_p"), "gold_or_constructed_label": gold, "prediction_source_type": F.when(known, made).otherwise(source),
        "failure_reason": F.when(~known, failure), "model_export_required": ~known,
    })


def abstention_rows(records: DataFrame) -> DataFrame:
    """dimension (abstention_reason, missing_information), label, count, and its fractions of the abstentions and of all records; records are read once.

    records: abstention_reason (null, empty or None: no abstention) and missing_information, an array, of which an abstention may say several."""
    clean = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("None"))
    away = clean(F.col("abstention_reason")) != "None"
    cell = lambda d, c: F.struct(F.lit(d).alias("dimension"), c.alias("label"))
    cells = F.concat(F.array(cell("abstention_reason", clean(F.col("abstention_reason")))), F.transform(F.coalesce("missing_information", F.array().cast("array<string>")), lambda m: cell("missing_information", clean(m))))
    # what is counted of all records goes the same way, under a name of its own
    every = F.array(cell("all", F.when(away, "abstained").otherwise("answered")))
    counts = records.select(F.explode(F.when(away, F.concat(every, cells)).otherwise(every)).alias("x")).groupBy("x.dimension", "x.label").agg(F.count("*").alias("count"))
    totals = counts.agg(F.coalesce(F.sum(F.when(F.expr("dimension = 'all' AND label = 'abstained'"), F.col("count"))), F.lit(0)).alias("abstained"), F.coalesce(F.sum(F.when(F.col("dimension") == "all", F.col("count"))), F.lit(0)).alias("total"))
    part = lambda of: F.coalesce(F.try_divide(F.col("count").cast("double"), of), F.lit(0.0))
    return counts.filter("dimension <> 'all'").crossJoin(F.broadcast(totals)).select("dimension", "label", "count", part("abstained").alias("fraction_of_abstentions"), part("total").alias("fraction_of_total"))
