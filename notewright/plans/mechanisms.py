"""Queries of documents, files and archives: tables go out to the shared folder in a format and come back by its reader."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents, names
from ..functions import text as T
from ..operators import adapter, reports, running, sampling, tasks
from ..operators.repeats import by_text, dealt, exploded
from ..session import workdir
from ..sources import archive, store, tables
from . import evaluation
from . import sqltext as S
from .notes import LINES_SQL, lines, notes
from .queries import SQL, _candidates, _table, query


def _at(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{workdir(spark)}/{name}-{uuid.uuid4().hex}"


# documents

#: A document for each turn of a conversation, by the same text in any engine.
DOC = """concat('{"turn":', turn, ',"runs":[', CASE WHEN conv_id % 4 = 0 THEN '{"model_dir":null,"output_dir":"never"},' ELSE '' END, '{"name":"', role, '","args":{"z":', length(text),
 CASE WHEN turn % 2 = 0 THEN concat(',"output_dir":"run/', conv_id, '"') ELSE '' END, ',"a":[1,{"model_dir":', CASE WHEN turn % 3 = 0 THEN 'null' ELSE concat('{"path":"m', turn, '"}') END, '}]}}]', CASE WHEN conv_id % 5 = 0 THEN ',"model_dir":"top"' ELSE '' END, '}')"""
_KEYS = ("output_dir", "model_dir")
_IN = "('output_dir', 'model_dir')"


def _documents(spark, sf):
    return _table(spark, sf, "conversations").selectExpr("conv_id", "turn", "role", f"{DOC} AS doc")


@query(f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, conv_id, turn, {DOC}::JSON AS doc FROM conversations),
 n AS (SELECT id, []::BIGINT[] AS place, false AS hit, doc AS v FROM d UNION ALL SELECT n.id, list_append(place, e.rowid), e.key IN {_IN}, e.value FROM n, json_each(v) e
  WHERE NOT hit AND json_type(v) IN ('OBJECT', 'ARRAY') AND e.rowid <= coalesce((SELECT min(f.rowid) FROM json_each(v) f WHERE f.key IN {_IN}), 1000000)),
 h AS (SELECT id, arg_min(CASE json_type(v) WHEN 'VARCHAR' THEN v ->> '$' ELSE v::VARCHAR END, place) AS value FROM n WHERE hit AND json_type(v) <> 'NULL' GROUP BY id)
 SELECT conv_id, turn, value FROM d LEFT JOIN h USING (id)""")
def find_first_key(spark, sf):
    return _documents(spark, sf).select("conv_id", "turn", documents.first_key(F.col("doc"), _KEYS).alias("value"))


@query(f"""WITH d AS (SELECT row_number() OVER () AS id, role, {DOC} AS doc FROM conversations), n AS (SELECT d.id, role, regexp_replace(t.fullkey, '\\[[0-9]+\\]', '[]', 'g') AS path,
  CASE t.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS type FROM d, json_tree(doc) t)
 SELECT role, path, count(DISTINCT id) AS rows, count(*) AS "values", array_to_string(list_sort(list(DISTINCT type)), '|') AS types FROM n GROUP BY ALL""")
def document_contents(spark, sf):
    found = documents.contents(_documents(spark, sf), "doc", ["role"])
    return found.withColumn("types", F.array_join("types", "|"))


@query(f"""WITH {S.NOTES_CTE} SELECT note_id, {S.size('text')} AS size_mm, {S.density('text')} AS density, {S.location('text')} AS location FROM notes""")
def extractors_by_name(spark, sf):
    names.register(spark)
    return spark.sql("SELECT note_id, size_mm(text) AS size_mm, lung_density(text) AS density, lung_location(text) AS location FROM {n}", n=notes(spark, sf))


@query(f"WITH {S.MENTIONS} SELECT note_id, k::INT AS k, mention FROM mf")
def mentions_by_name(spark, sf):
    names.register(spark)
    found = notes(spark, sf).select("note_id", T.sections(F.col("text"))["findings"].alias("findings"))
    return spark.sql("SELECT note_id, m.k, m.mention FROM {n}, LATERAL nodule_mentions(findings) m", n=found)


# positions


@query(f"""WITH li AS ({LINES_SQL}), a AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS position, l_partkey FROM li), b AS (SELECT row_number() OVER (ORDER BY l_partkey, l_orderkey, l_linenumber) - 1 AS position, l_suppkey FROM li)
 SELECT position, l_partkey, l_suppkey FROM a JOIN b USING (position)""")
def positional_zip(spark, sf):
    """Two tables in the order of their files, one of 3 Parquet files and one of 7 of JSON lines, side by side."""
    li = lines(spark, sf)
    left, right = _at(spark, "left"), _at(spark, "right")
    li.repartitionByRange(3, "l_orderkey", "l_linenumber").sortWithinPartitions("l_orderkey", "l_linenumber").select("l_partkey").write.parquet(left)
    order = ["l_partkey", "l_orderkey", "l_linenumber"]
    tables.write_jsonl(li.repartitionByRange(7, *order).sortWithinPartitions(*order).select("l_suppkey"), right)
    a = running.with_position(spark.read.schema("l_partkey long").parquet(left))
    b = running.with_position(tables.read_jsonl(spark, right, "l_suppkey long"), by_row=False)
    return running.zipped(a, b)


# sources and sinks


@query("SELECT c_custkey AS subject_id, CASE c_custkey % 2 WHEN 0 THEN 'F' ELSE 'M' END AS gender, c_custkey % 90 AS anchor_age, CASE WHEN c_custkey % 7 > 0 THEN concat('a, \"b\" ', c_name) END AS name FROM customer")
def archive_members(spark, sf):
    """Written as archives, a member in each, and read from byte ranges of them."""
    k = F.col("c_custkey")
    path = _at(spark, "archives").removeprefix("file://")
    archive.write_member(_table(spark, sf, "customer").select(k.alias("subject_id"), F.when(k % 2 == 0, "F").otherwise("M").alias("gender"), (k % 90).alias("anchor_age"), F.when(k % 7 > 0, F.concat(F.lit('a, "b" '), "c_name")).alias("name")), path, "patients.csv")
    return archive.read_member(spark, path, "patients.csv", "subject_id long, gender string, anchor_age long, name string", range_bytes=100_000)


_ORDER = "o_orderkey AS k, o_custkey AS c, o_totalprice::DOUBLE AS price, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS status"


def _orders(spark, sf) -> DataFrame:
    return _table(spark, sf, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c", "CAST(o_totalprice AS DOUBLE) AS price", "CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS status")


@query(f"SELECT {_ORDER} FROM orders WHERE o_orderkey % 5 > 0")
def json_lines(spark, sf):
    """JSON lines with blank and malformed ones among them, which the lenient reader leaves out."""
    path = _at(spark, "lines")
    rows = _orders(spark, sf)
    broken = F.when(F.col("k") % 5 > 0, F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})).when(F.col("k") % 10 > 0, "").otherwise('{"k": 1, "c": ')
    rows.select(broken.alias("value")).write.text(path)
    return tables.read_jsonl(spark, path, "k long, c long, price double, status string", strict=False).filter("k IS NOT NULL")


@query(f"SELECT k, c, price, coalesce(status, '') AS status FROM (SELECT {_ORDER} FROM orders)")
def csv_rows(spark, sf):
    """CSV of all strings: what is missing is the empty string."""
    path = _at(spark, "csv")
    tables.write_csv(_orders(spark, sf), path)
    read = tables.read_text_rows(spark, path)
    return read.select(F.col("k").cast("long").alias("k"), F.col("c").cast("long").alias("c"), F.col("price").cast("double").alias("price"), "status")


@query(f"SELECT k, c, price, status, split FROM (SELECT {_ORDER}, CASE o_orderkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM orders)")
def split_files(spark, sf):
    """A file for each split, read as one table that says which."""
    path = _at(spark, "splits")
    rows = _orders(spark, sf)
    for i, name in enumerate(("train", "val", "test")):
        tables.write_jsonl(rows.filter(F.col("k") % 3 == i), f"{path}/{name}.jsonl")
    read = spark.read.schema("k long, c long, price double, status string").json([f"{path}/{s}.jsonl" for s in ("train", "val", "test")])
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return read.select("*", F.regexp_replace(folder, r"\.jsonl$", "").alias("split"))


@query("SELECT variant, any_value(o_orderkey) AS orders, any_value(total) AS total FROM (SELECT concat(o_orderpriority[1:1], o_orderstatus) AS variant, count(*) OVER w AS o_orderkey, round(sum(o_totalprice::DOUBLE) OVER w, 2) AS total FROM orders WINDOW w AS (PARTITION BY o_orderpriority[1:1], o_orderstatus)) GROUP BY variant")
def result_files(spark, sf):
    """One JSON document for each method and task, named by them, collected into a table by their names."""
    path = _at(spark, "results")
    g = _table(spark, sf, "orders").groupBy(F.concat(F.substring("o_orderpriority", 1, 1), "o_orderstatus").alias("variant")).agg(F.count("*").alias("orders"), F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("total"))
    g.select("variant", F.to_json(F.struct("orders", "total")).alias("value")).repartition("variant").write.partitionBy("variant").text(path)
    docs = spark.read.text(f"{path}/variant=*", wholetext=True)
    named = F.regexp_extract(F.col("_metadata.file_path"), r"variant=([^/]*)/", 1)
    one = docs.select(named.alias("variant"), F.explode(F.split("value", "\n")).alias("value")).filter("value <> ''")
    return one.select("variant", F.from_json("value", "orders long, total double").alias("r")).select("variant", "r.*")


@query("SELECT g AS gate, split, count(*) AS n, min(o_orderkey) AS first FROM (SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN 'train' ELSE 'test' END AS split, unnest(CASE o_orderkey % 3 WHEN 0 THEN ['G1', 'G2'] WHEN 1 THEN ['G1'] ELSE [] END) AS g FROM orders) GROUP BY ALL")
def gate_files(spark, sf):
    """A row to each gate that it passed; a gate's partition alone is read."""
    path = _at(spark, "gates")
    k = F.col("o_orderkey")
    rows = _table(spark, sf, "orders").select(k.alias("k"), F.when(k % 2 == 0, "train").otherwise("test").alias("split"), F.when(k % 3 == 0, F.array(F.lit("G1"), F.lit("G2"))).when(k % 3 == 1, F.array(F.lit("G1"))).otherwise(F.array().cast("array<string>")).alias("passed_gates"))
    tables.write_gates(rows, path)
    return spark.read.schema("k long, gate string, split string").parquet(path).groupBy("gate", "split").agg(F.count("*").alias("n"), F.min("k").alias("first"))


@query("SELECT 'train' AS part, count(*) AS rows, count(s) AS labelled, array_to_string(list_sort(list(DISTINCT s)), '|') AS labels FROM (SELECT CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS s FROM orders WHERE o_orderkey % 4 > 0) UNION ALL SELECT 'test', count(*), count(s), array_to_string(list_sort(list(DISTINCT s)), '|') FROM (SELECT CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS s FROM orders WHERE o_orderkey % 4 = 0)")
def manifest_counts(spark, sf):
    """A manifest counted while its parts are written, and read back as a document."""
    path, rows = _at(spark, "parts"), _orders(spark, sf)
    store.write_manifest({"train": rows.filter("k % 4 > 0"), "test": rows.filter("k % 4 = 0")}, path, label="status")
    doc = spark.read.text(f"{path}/manifest/part-*", wholetext=True)
    entry = "struct<rows:bigint,labelled:bigint,labels:array<string>>"
    parts = doc.select(F.explode(F.from_json("value", f"parts map<string,{entry}>")["parts"]).alias("part", "e"))
    return parts.select("part", "e.rows", "e.labelled", F.array_join("e.labels", "|").alias("labels"))


@query("SELECT CASE WHEN ps % 2 = 0 THEN 'low' ELSE 'high' END AS label, count(*) AS n, round(sum(p), 6) AS total FROM (SELECT l_suppkey AS ps, CASE WHEN l_partkey % 9 > 0 THEN (l_partkey % 100) / 100.0::DOUBLE END AS p FROM lineitem) GROUP BY 1")
def probability_files(spark, sf):
    """Probabilities as JSON lines with nulls kept, and read again strictly."""
    path = _at(spark, "probabilities")
    li = _table(spark, sf, "lineitem")
    rows = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("sample_id"), F.when(F.col("l_partkey") % 9 > 0, (F.col("l_partkey") % 100) / 100.0).alias("probability"), F.when(F.col("l_suppkey") % 2 == 0, "low").otherwise("high").alias("label"))
    entry = tables.write_probabilities(rows, path, split="all", source_path=f"{sf}/lineitem.parquet")
    read = tables.read_jsonl(spark, path, "sample_id string, probability double, label string, split string")
    return read.filter(F.lit(entry["rows"]) >= 0).groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("probability"), 6).alias("total"))


@query("SELECT o_custkey AS c, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1")
def stored_table(spark, sf):
    """Made and stored, then read through the store by its fingerprint, and checked to have one row a key."""
    path = _at(spark, "stored")
    made = lambda: _table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))
    store.stored(made(), path)
    return tables.unique_by(store.stored(made(), path), "c")


# orders and samples


@query(f"SELECT case_id, note_id, field, risk, alternatives FROM ({SQL['conflict_risks']}) x ORDER BY CASE risk WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, len(string_split(alternatives, '|')) DESC, case_id, note_id, field LIMIT 20")
def conflict_examples(spark, sf):
    """The twenty conflicts to look at first."""
    found = adapter.conflicts(_candidates(spark, sf).withColumnRenamed("density", "density_category"), ["size_mm", "density_category"])
    return reports.sorted_conflicts(found).limit(20).select("case_id", "note_id", "field", "risk", "alternatives")


@query("SELECT o_orderkey AS k FROM orders ORDER BY md5(concat('42|', o_orderkey::VARCHAR)), o_orderkey LIMIT 100")
def sampled_rows(spark, sf):
    return sampling.sampled(_table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), "k", 100)


_RATES = ("positive_rate", *[f"{k}_rate" for k in evaluation._DRIFT_KEYS])
_APART = " + ".join([*[f"abs(p.{c} - t.{c})" for c in _RATES], *[f"abs(p.{c} - t.{c}) / greatest(abs(t.{c}), 1)" for c in ("chars_mean", "tokens_mean")]])


@query(f"WITH p AS ({SQL['drift_profile']}) SELECT p.split, round({_APART}, 5) AS distance FROM p, (SELECT * FROM p WHERE split = 'train') t")
def drift_distances(spark, sf):
    return reports.drift_distance(evaluation.drift_profile(spark, sf), "split", "train").select("split", F.round("distance", 5).alias("distance"))


# tasks


_TASK_ROWS = """tr AS (SELECT concat('n', o_custkey) AS note_id, concat('n', o_custkey, '__', o_orderkey) AS sample_id, o_orderkey AS k, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS mention_text,
 CASE o_orderkey % 7 WHEN 0 THEN 'Part-Solid' WHEN 1 THEN ' solid ' WHEN 2 THEN 'ggo' WHEN 3 THEN 'calcified' WHEN 4 THEN 'unclear' WHEN 5 THEN 'solid' END AS density_label, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS has_size,
 CASE o_orderkey % 5 WHEN 0 THEN 'RUL' WHEN 1 THEN 'apex' WHEN 2 THEN 'unclear' WHEN 3 THEN 'lingula' END AS location_label FROM {orders})"""


def _task_rows(spark, sf):
    return spark.sql(f"WITH {_TASK_ROWS} SELECT * FROM tr", orders=_table(spark, sf, "orders"))


_TASK_SQL = _TASK_ROWS.format(orders="orders")


@query(f"""WITH {_TASK_SQL}, l AS (SELECT sample_id, mention_text, CASE WHEN density_label IN ('solid', 'calcified') THEN density_label ELSE 'unclear' END AS density, CASE WHEN has_size THEN 'has_size' ELSE 'no_size' END AS size,
  CASE WHEN location_label IN ('RUL', 'lingula', 'unclear') THEN location_label ELSE 'no_location' END AS location FROM tr)
 SELECT sample_id, coalesce(mention_text, '') AS input, density, CASE density WHEN 'solid' THEN 0 WHEN 'calcified' THEN 3 ELSE 4 END AS density_y, size, CASE size WHEN 'has_size' THEN 1 ELSE 0 END AS size_y, location, CASE location WHEN 'RUL' THEN 0 WHEN 'lingula' THEN 5 WHEN 'unclear' THEN 7 ELSE 8 END AS location_y FROM l""")
def task_labels(spark, sf):
    """Label vectors of three tasks, read from a file for each split."""
    path, rows = _at(spark, "tasks"), _task_rows(spark, sf)
    out = None
    for task in ("density", "size", "location"):
        for i, split in enumerate(tasks.SPLITS):
            tables.write_jsonl(rows.filter(F.col("k") % 3 == i), f"{path}/{task}_{split}.jsonl")
        read = tasks.task_splits(spark, path, task, "sample_id string, mention_text string, density_label string, has_size boolean, location_label string")
        one = read.select("sample_id", "input", F.col("label").alias(task), F.col("y").alias(f"{task}_y"))
        out = one if out is None else out.join(one.drop("input"), "sample_id")
    return out


@query(f"""WITH {_TASK_SQL}, p AS (SELECT k, (k % 100) / 100.0::DOUBLE AS p FROM tr WHERE k % 2 = 0), x AS (SELECT tr.*, p.p, CASE k % 7 WHEN 0 THEN 'part_solid' WHEN 1 THEN 'solid' WHEN 2 THEN 'ground_glass' WHEN 3 THEN 'calcified' WHEN 4 THEN 'unclear' WHEN 5 THEN 'solid' END AS d FROM tr LEFT JOIN p USING (k))
 SELECT sample_id, 'size' AS task, CASE WHEN p IS NOT NULL AND p >= 0.4 OR p IS NULL AND coalesce(has_size, false) THEN 'has_size' ELSE 'no_size' END AS predicted_label, CASE WHEN coalesce(has_size, false) THEN 'has_size' ELSE 'no_size' END AS gold_or_constructed_label, CASE WHEN p IS NULL THEN 'constructed_fact_only_no_probability' ELSE 'final_model_probability_file' END AS prediction_source_type, p IS NULL AS model_export_required, p AS probability FROM x
 UNION ALL SELECT sample_id, 'density_stage1', CASE WHEN d <> 'unclear' THEN 'explicit_density' ELSE 'unclear_or_no_evidence' END, CASE WHEN d <> 'unclear' THEN 'explicit_density' ELSE 'unclear_or_no_evidence' END, 'constructed_fact_not_final_model', true, NULL FROM x
 UNION ALL SELECT sample_id, 'density_stage2', nullif(d, 'unclear'), d, 'constructed_fact_not_final_model', true, NULL FROM x
 UNION ALL SELECT sample_id, 'location', CASE WHEN location_label IN ('RUL', 'lingula') THEN location_label END, location_label, 'constructed_fact_not_final_model', true, NULL FROM x""")
def exported_predictions(spark, sf):
    rows = _task_rows(spark, sf)
    p = rows.filter("k % 2 = 0").select("sample_id", F.lit(None).cast("string").alias("label"), ((F.col("k") % 100) / 100.0).alias("probability"))
    lower = p.withColumn("probability", F.col("probability") - 1)  # another row of the same mention, of less probability
    out = tasks.exported(rows, "size", "m1", predictions=p.union(lower), threshold=0.4)
    for task in ("density_stage1", "density_stage2", "location"):
        out = out.unionByName(tasks.exported(rows, task, "m1"))
    return out.select("sample_id", "task", "predicted_label", "gold_or_constructed_label", "prediction_source_type", "model_export_required", "probability")


@query(f"""WITH {S.MENTIONS} SELECT note_id, k::INT AS k, coalesce(CASE WHEN {S.density('mention')} IN ('solid', 'part_solid', 'ground_glass', 'calcified') THEN {S.density('mention')} END, 'unclear') AS density, CASE WHEN {S.size('mention')} IS NULL THEN 'no_size' ELSE 'has_size' END AS size, coalesce({S.location('mention')}, 'no_location') AS location FROM mf""")
def rule_predictions(spark, sf):
    s = by_text(notes(spark, sf).select("note_id", "text"), "text").select("keys", T.sections(F.col("text"))["findings"].alias("f"))
    s = exploded(s, T.mentions(F.col("f")), "m", ["keys"], "k")
    return dealt(s.select("keys", (F.col("k") + 1).alias("k"), *[tasks.rule_prediction(t, F.col("m")).alias(t) for t in ("density", "size", "location")]))


@query("""WITH r AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'missing_size' WHEN 1 THEN 'None' WHEN 2 THEN '' ELSE 'missing_density' END AS reason, CASE o_orderkey % 3 WHEN 0 THEN ['size', 'density'] WHEN 1 THEN [''] END AS missing FROM orders),
 t AS (SELECT count(*) FILTER (WHERE reason NOT IN ('None', '')) AS a, count(*) AS n FROM r), c AS (SELECT 'abstention_reason' AS dimension, reason AS label FROM r WHERE reason NOT IN ('None', '') UNION ALL SELECT 'missing_information', coalesce(nullif(m, ''), 'None') FROM (SELECT unnest(missing) AS m FROM r WHERE reason NOT IN ('None', '')))
 SELECT dimension, label, count(*) AS count, round(count(*) / any_value(a), 9) AS fraction_of_abstentions, round(count(*) / any_value(n), 9) AS fraction_of_total FROM c, t GROUP BY ALL""")
def abstention_table(spark, sf):
    k = F.col("o_orderkey")
    none = F.lit(None).cast("array<string>")
    rows = _table(spark, sf, "orders").select(
        F.when(k % 4 == 0, "missing_size").when(k % 4 == 1, "None").when(k % 4 == 2, "").otherwise("missing_density").alias("abstention_reason"),
        F.when(k % 3 == 0, F.array(F.lit("size"), F.lit("density"))).when(k % 3 == 1, F.array(F.lit(""))).otherwise(none).alias("missing_information"),
    )
    out = tasks.abstention_rows(rows)
    return out.select("dimension", "label", "count", F.round("fraction_of_abstentions", 9).alias("fraction_of_abstentions"), F.round("fraction_of_total", 9).alias("fraction_of_total"))
