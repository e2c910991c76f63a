"""Transcript tables derived from the driver's Parquet tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timecode import clock


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, seg_idx, start_ms, end_ms, speaker, text: turns laid end to end, by length, with gaps."""
    turns = table(spark, sf_dir, "conversations")
    length = (500 + 60 * F.length("text")).cast("long")
    gap = ((F.col("turn") % 3) * 400).cast("long")
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(length + gap).over(order)
    return turns.select(
        F.col("conv_id").cast("long").alias("media_id"), F.col("turn").cast("long").alias("seg_idx"), (end - length).alias("start_ms"), end.alias("end_ms"), F.col("role").alias("speaker"), "text"
    )


def clocked(rows: DataFrame) -> DataFrame:
    """start and end as clock strings in place of milliseconds."""
    return rows.select("media_id", "seg_idx", clock(F.col("start_ms")).alias("start"), clock(F.col("end_ms")).alias("end"), "speaker", "text")


def silence_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, ord, line: events as the lines of a silence detector."""
    line = F.when(F.col("event_type") == "click", F.concat(F.lit("silence_start: "), F.col("event_id"))).when(
        F.col("event_type") == "error", F.concat(F.lit("silence_end: "), F.col("event_id"), F.lit(" | silence_duration: 1"))
    ).otherwise(F.concat(F.lit("frame "), F.col("event_id")))
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("media_id"), F.col("event_id").cast("long").alias("ord"), line.alias("line"))
