"""Feature steps of text classifiers that pyspark.ml lacks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@F.arrow_udf(VectorUDT())
def _damped(v: pa.Array) -> pa.Array:
    """1 + ln of every stored count of a batch of vectors at once; what is absent or zero stays so."""
    values = v.field("values")
    flat = values.flatten().to_numpy(zero_copy_only=False)
    damped = np.where(flat > 0, 1 + np.log(np.where(flat > 0, flat, 1)), 0.0)
    offsets = np.append(0, np.cumsum(np.diff(values.offsets.to_numpy()) * np.asarray(values.is_valid()))).astype(np.int32)
    mask = np.asarray(values.is_null())
    lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(mask, False)), pa.array(damped), type=values.type)
    fields = {f.name: v.field(f.name) for f in v.type} | {"values": lists, "type": v.field("type").fill_null(0)}
    return pa.StructArray.from_arrays(list(fields.values()), fields=list(v.type), mask=v.is_null())


class DampedCounts(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Maps a vector of counts to 1 + ln of each count above zero; saved and loaded with its pipeline."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None):  # noqa: N803
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), _damped(F.col(self.getInputCol())))
