"""Clinical notes derived from the order tables by the same SQL in Spark and elsewhere.

{lineitem}, {part} and {orders} stand for the tables; nothing is random, so any engine makes the same notes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One row for each order line number; the rest of a repeated one is not of interest here. Flags are one character: as numbers they are aggregated by hash.
LINES = """SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity, min(l_discount) AS l_discount,
 chr(min(ascii(l_returnflag))) AS l_returnflag, chr(min(ascii(l_linestatus))) AS l_linestatus FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""
EXAM = """CASE l_linenumber % 6 WHEN 0 THEN 'CT HEAD W/O CONTRAST' WHEN 1 THEN 'CT CHEST W/CONTRAST' WHEN 2 THEN 'CT LOW DOSE LUNG SCREENING'
 WHEN 3 THEN 'CTA CHEST' WHEN 4 THEN 'CHEST CT W/O CONTRAST' ELSE 'MR ABDOMEN AND PELVIS' END"""
SIZE = """CASE (l_orderkey + l_linenumber) % 9 WHEN 0 THEN '' WHEN 1 THEN concat(p_size, ' mm ') WHEN 2 THEN concat(p_size % 4, '.', l_linenumber, ' cm ')
 WHEN 3 THEN concat(p_size, ' x ', l_linenumber + 2, ' mm ') WHEN 4 THEN concat(p_size, '-', p_size + 2, ' mm ') WHEN 5 THEN concat(p_size, ' x 3 x 2 mm ')
 WHEN 6 THEN concat(p_size, 'mm ') WHEN 7 THEN concat(p_size % 3, ' x 2 cm ') ELSE 'tiny ' END"""
DENSITY = """CASE p_partkey % 8 WHEN 0 THEN 'solid ' WHEN 1 THEN 'part-solid ' WHEN 2 THEN 'ground-glass ' WHEN 3 THEN 'calcified ' WHEN 4 THEN 'non-calcified '
 WHEN 5 THEN 'subsolid ' WHEN 6 THEN 'hazy ' ELSE '' END"""
LOBE = """CASE p_partkey % 9 WHEN 0 THEN 'right upper lobe' WHEN 1 THEN 'RML' WHEN 2 THEN 'right lower lobe' WHEN 3 THEN 'left upper lobe and right lower lobe' WHEN 4 THEN 'LLL'
 WHEN 5 THEN 'lingula' WHEN 6 THEN 'right lung' WHEN 7 THEN 'both lungs' ELSE 'chest' END"""
CHANGE = """CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'It is stable for two years. ' WHEN 'NF' THEN 'This is new. ' WHEN 'NO' THEN 'It has increased in size. '
 WHEN 'RF' THEN 'It has decreased. ' ELSE '' END"""
NOTES = f"""SELECT concat(o_custkey, '-RR-', l_orderkey * 10 + l_linenumber) AS note_id, o_custkey AS subject_id, l_orderkey * 10 + l_linenumber AS ordinal, {EXAM} AS exam,
 CASE WHEN (l_orderkey * 10 + l_linenumber) % 11 = 0 THEN concat('EXAMINATION: CT', chr(10), 'FINDINGS: No nodules identified.', chr(10), 'IMPRESSION: Normal.')
 ELSE concat('EXAMINATION: CT', chr(10), 'INDICATION: cough', chr(10), CASE WHEN l_orderkey % 4 = 0 THEN concat('COMPARISON :', chr(10)) ELSE '' END,
  'FINDINGS: There is a ', {SIZE}, {DENSITY}, 'nodule in the ', {LOBE}, '. ', {CHANGE},
  CASE l_orderkey % 5 WHEN 0 THEN 'Pleural effusion. A 5 mm new opacity in the left lower lobe. ' WHEN 1 THEN 'Part-solid lesion with solid component measuring 7 mm. '
   WHEN 2 THEN 'No evidence of solid mass. ' ELSE '' END, chr(10),
  'IMPRESSION: ', CASE l_orderkey % 3 WHEN 0 THEN 'Lung-RADS category: 2. Solid nodule.' WHEN 1 THEN 'Follow-up CT in 6 months.' ELSE '' END, chr(10),
  CASE l_orderkey % 7 WHEN 0 THEN 'RECOMMENDATION(S): Follow-up CT is suggested.' ELSE '' END) END AS text
 FROM ({LINES}) li JOIN {{part}} ON l_partkey = p_partkey JOIN {{orders}} ON l_orderkey = o_orderkey"""
DETAILS = """SELECT note_id, 'exam_name' AS field_name, exam AS field_value, ordinal * 10 AS ordinal FROM ({notes}) a
 UNION ALL SELECT note_id, 'EXAM_NAME', 'CHEST CT ADDED', ordinal * 10 + 1 FROM ({notes}) b WHERE ordinal % 13 < 4
 UNION ALL SELECT note_id, 'technique', 'CT CHEST', ordinal * 10 + 2 FROM ({notes}) c"""
DISCHARGE = """SELECT o_custkey AS subject_id, concat(o_custkey, '-DS-', o_orderkey) AS note_id, o_orderkey AS ordinal,
 concat('Admission Date: 1', chr(10), CASE WHEN o_orderkey % 12 = 11 THEN '' ELSE concat('Social History: ', CASE o_orderkey % 10 WHEN 0 THEN '___'
  WHEN 1 THEN concat('Current smoker, ', o_custkey % 50, ' pack-year history') WHEN 2 THEN concat('Former smoker, ', o_custkey % 60, ' pack years, quit ', o_custkey % 30, ' years ago')
  WHEN 3 THEN 'Denies tobacco use' WHEN 4 THEN concat('Smokes ', o_custkey % 3, ' ppd x ', o_custkey % 40, ' years') WHEN 5 THEN 'PPD placed, read at 0mm'
  WHEN 6 THEN 'Social history significant for tobacco' WHEN 7 THEN 'Never smoked' WHEN 8 THEN 'Lives alone' ELSE 'Tobacco: former, stopped smoking in 1999' END) END, chr(10),
  'Family History: none', chr(10), CASE o_orderkey % 4 WHEN 0 THEN 'HPI: former smoker with 40 pack-year history.' ELSE 'HPI: fever.' END) AS text FROM {orders}"""

#: The same as SQL for views of these names.
VIEWS = {"lineitem": "lineitem", "part": "part", "orders": "orders"}
LINES_SQL = LINES.format(**VIEWS)
NOTES_SQL = NOTES.format(**VIEWS)
DETAILS_SQL = DETAILS.format(notes=NOTES_SQL)
DISCHARGE_SQL = DISCHARGE.format(**VIEWS)


def _spread(spark: SparkSession, sf_dir: str, name: str, columns: list[str], key: str) -> DataFrame:
    """A table's columns dealt to as many tasks as the session has cores or shuffle partitions, before texts are made of
    them: a note is few bytes and much work, so partitions that adaptive execution would merge by their bytes are kept
    apart. What is grouped or joined by key afterwards needs no exchange of its own."""
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns).repartition(n, key)


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"], "l_orderkey")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LINES, lineitem=_lineitem(spark, sf_dir))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "orders")}
    return spark.sql(NOTES, lineitem=_lineitem(spark, sf_dir), **others)


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DETAILS in one pass over the notes."""
    row = lambda name, value, k, test=None: F.when(F.lit(True) if test is None else test, F.struct(F.lit(name).alias("field_name"), value.alias("field_value"), (F.col("ordinal") * 10 + k).alias("ordinal")))
    rows = F.array_compact(F.array(row("exam_name", F.col("exam"), 0), row("EXAM_NAME", F.lit("CHEST CT ADDED"), 1, F.col("ordinal") % 13 < 4), row("technique", F.lit("CT CHEST"), 2)))
    return notes(spark, sf_dir).select("note_id", F.inline(rows))


def discharge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DISCHARGE, orders=_spread(spark, sf_dir, "orders", ["o_custkey", "o_orderkey"], "o_orderkey"))
