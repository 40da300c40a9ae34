"""Structured Streaming twins: the same stateless facts over a stream of notes, windowed counts over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.radiology import facts
from ..operators.smoking import smoking_facts


def stream_radiology_facts(notes: DataFrame) -> DataFrame:
    """facts() is a projection, so it holds for a stream as it is."""
    return facts(notes)


def stream_smoking_facts(notes: DataFrame) -> DataFrame:
    return smoking_facts(notes)


def first_notes(notes: DataFrame, time: str, late: str = "1 day") -> DataFrame:
    """Each note once, though it may arrive again within the time that state is kept."""
    return notes.withWatermark(time, late).dropDuplicatesWithinWatermark(["note_id"])


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their sum by type and tumbling window; late ones up to the watermark count."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
