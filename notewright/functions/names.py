"""The extractors as SQL functions, for use by name.

    register(spark)
    spark.sql("SELECT note_id, size_mm(text), lung_density(text) FROM notes")
    spark.sql("SELECT n.note_id, m.* FROM notes n, LATERAL nodule_mentions(n.text) m")

Each is a temporary SQL function whose body is the column builder's own expression, so Catalyst puts it in place and plans the
same as for the builder: pruned, pushed down and compiled alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import cues
from . import text as T

#: name -> (what it returns, builder over one text).
SCALARS: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "size_mm": ("DOUBLE", lambda t: T.size(t)["value"]),
    "size_span": ("STRING", lambda t: T.size(t)["span"]),
    "lung_density": ("STRING", lambda t: T.density(t)["value"]),
    "lung_location": ("STRING", lambda t: T.location(t)["value"]),
    "change_of": ("STRING", lambda t: T.change(t)["value"]),
    "lung_rads": ("STRING", T.lung_rads),
    "followup_cue": ("STRING", T.cue),
    "modality_of": ("STRING", T.modality),
    "body_site_of": ("STRING", T.body_site),
    "social_history": ("STRING", T.social_history),
    "smoking_status": ("STRING", lambda t: T.smoking_status(t)["value"]),
    "pack_years": ("DOUBLE", lambda t: T.pack_years(t)["value"]),
    "quit_years": ("DOUBLE", lambda t: T.quit_years(t)["value"]),
    "has_nodule": ("BOOLEAN", T.negation_aware_mention),
    "is_yes": ("BOOLEAN", cues.as_flag),
    "plain_number": ("DOUBLE", cues.as_number),
}


#: A column's text writes operators as calls; as names of functions they are in quotes. Literals are passed over.
_OPERATOR = re.compile(r"('(?:[^'\\]|\\.)*')|(?<![\w`.])(and|or|not|<=>|<=|>=|!=|[!=<>+\-*/%])\(", re.S)


def sql_of(column: Column) -> str:
    """A column expression as SQL text."""
    return _OPERATOR.sub(lambda m: m[1] or f"`{m[2]}`(", column._jc.node().sql())


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Makes temporary functions of all SCALARS and the table function nodule_mentions(text) (k, mention); returns their names."""
    made = []
    for name, (kind, build) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(report STRING) RETURNS {kind} RETURN {sql_of(build(F.col('report')))}")
        made.append(prefix + name)
    rows = sql_of(T.mentions(F.col("report")))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}nodule_mentions(report STRING) RETURNS TABLE(k INT, mention STRING) RETURN SELECT pos + 1, col FROM posexplode({rows})")
    return [*made, f"{prefix}nodule_mentions"]
