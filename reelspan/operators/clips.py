"""Clips: their normal form, file names and cutting plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clip_filename
from ..functions.timecode import lenient_ms


def normalised(clips: DataFrame) -> DataFrame:
    """``segments`` of every clip: its own if it has any list, even an empty one, else its start and end as the only one."""
    one = F.array(F.struct(F.col("start").alias("start"), F.col("end").alias("end")))
    return clips.withColumn("segments", F.coalesce("segments", one)).drop("start", "end")


def export_plan(clips: DataFrame) -> DataFrame:
    """media_id, clip_idx, filename, mode (single for one range, else concat), title, reason, and metadata as JSON."""
    filename = clip_filename(F.col("clip_idx"), F.col("title"))
    return clips.select(
        "media_id", "clip_idx", filename.alias("filename"), F.when(F.size("segments") == 1, "single").otherwise("concat").alias("mode"),
        F.to_json(F.struct("title", "reason", "segments")).alias("metadata"), "segments",
    )


def best_clips(clips: DataFrame, count: int = 3, min_seconds: int = 10, max_seconds: int = 120) -> DataFrame:
    """An extension: the first ``count`` clips of each media whose total length is within bounds, which the original only asks for."""
    length = F.aggregate("segments", F.lit(0).cast("long"), lambda a, s: a + lenient_ms(s["end"]) - lenient_ms(s["start"]))
    fits = clips.withColumn("length_ms", length).where(F.col("length_ms").between(min_seconds * 1000, max_seconds * 1000))
    nth = F.row_number().over(Window.partitionBy("media_id").orderBy("clip_idx"))
    return fits.withColumn("rank", nth.cast("long")).where(F.col("rank") <= count)
