"""Whole documents per media, as one text row each, and their writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import transcript_line
from ..functions.timecode import subtitle_clock


def joined(rows: DataFrame, piece: Column, separator: str, out: str = "content", order: str = "seg_idx") -> DataFrame:
    """media_id and its pieces in order; a transcript is read whole by players anyway, so a media is one row."""
    gathered = rows.select("media_id", F.struct(F.col(order).alias("o"), piece.alias("p")).alias("s")).groupBy("media_id").agg(F.array_sort(F.collect_list("s")).alias("all"))
    return gathered.select("media_id", F.array_join(F.transform("all", lambda s: s["p"]), separator).alias(out))


def _numbered(segments: DataFrame) -> DataFrame:
    return segments.withColumn("n", F.row_number().over(Window.partitionBy("media_id").orderBy("seg_idx")).cast("long"))


def srt(segments: DataFrame) -> DataFrame:
    """Of (media_id, seg_idx, start, end, speaker, text), times as clock strings."""
    times = F.concat(subtitle_clock(F.col("start"), ","), F.lit(" --> "), subtitle_clock(F.col("end"), ","))
    block = F.concat(F.col("n").cast("string"), F.lit("\n"), times, F.lit("\n"), F.col("speaker"), F.lit(": "), F.col("text"), F.lit("\n"))
    return joined(_numbered(segments), block, "\n")


def vtt(segments: DataFrame) -> DataFrame:
    times = F.concat(subtitle_clock(F.col("start"), "."), F.lit(" --> "), subtitle_clock(F.col("end"), "."))
    body = joined(segments, F.concat(times, F.lit("\n<v "), F.col("speaker"), F.lit(">"), F.col("text")), "\n\n")
    return body.select("media_id", F.concat(F.lit("WEBVTT\n\n"), "content").alias("content"))


def txt(segments: DataFrame) -> DataFrame:
    return joined(segments, F.concat(F.lit("["), F.col("start"), F.lit(" - "), F.col("end"), F.lit("] "), F.col("speaker"), F.lit(": "), F.col("text")), "\n")


def prompt_lines(segments: DataFrame) -> DataFrame:
    return joined(segments, transcript_line(F.col("start"), F.col("end"), F.col("speaker"), F.col("text")), "\n", "transcript")


def saved_transcript(segments: DataFrame, context: Column | None = None) -> DataFrame:
    """media_id and the JSON document {segments, context}; media without segments are not saved."""
    listed = segments.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", F.struct("start", "end", "speaker", "text").alias("s")))).alias("all"))
    rows = F.transform("all", lambda x: x["s"])
    return listed.select("media_id", F.to_json(F.struct(rows.alias("segments"), (F.lit("") if context is None else context).alias("context"))).alias("content"))


def filter_graph(ranges: DataFrame, order: str = "seg_idx") -> DataFrame:
    """The renderer's graph that cuts and joins all (start, end) of a media in one pass."""
    n = (F.row_number().over(Window.partitionBy("media_id").orderBy(order)) - 1).cast("string")
    at = ranges.withColumn("n", n)
    span = F.concat(F.lit("start="), F.col("start"), F.lit(":end="), F.col("end"))
    piece = F.concat(F.lit("[0:v]trim="), span, F.lit(",setpts=PTS-STARTPTS[v"), F.col("n"), F.lit("];[0:a]atrim="), span, F.lit(",asetpts=PTS-STARTPTS[a"), F.col("n"), F.lit("];"))
    cuts = joined(at, piece, "", "cuts", order).join(joined(at, F.concat(F.lit("[v"), F.col("n"), F.lit("][a"), F.col("n"), F.lit("]")), "", "inputs", order), "media_id")
    total = ranges.groupBy("media_id").agg(F.count("*").cast("string").alias("total"))
    return cuts.join(total, "media_id").select("media_id", F.concat("cuts", "inputs", F.lit("concat=n="), "total", F.lit(":v=1:a=1[v][a]")).alias("graph"))


def audio_filter_graph(ranges: DataFrame) -> DataFrame:
    """The graph that keeps the (pos, start_ms, end_ms) of a media's sound; times in seconds."""
    second = lambda c: F.regexp_replace(F.regexp_replace((F.col(c) / 1000).cast("decimal(20,3)").cast("string"), "0+$", ""), r"\.$", "")
    n = F.col("pos").cast("string")
    piece = F.concat(F.lit("[0:a]atrim=start="), second("start_ms"), F.lit(":end="), second("end_ms"), F.lit(",asetpts=PTS-STARTPTS[a"), n, F.lit("];"))
    cuts = joined(ranges, piece, "", "cuts", "pos").join(joined(ranges, F.concat(F.lit("[a"), n, F.lit("]")), "", "inputs", "pos"), "media_id")
    total = ranges.groupBy("media_id").agg(F.count("*").cast("string").alias("total"))
    return cuts.join(total, "media_id").select("media_id", F.concat("cuts", "inputs", F.lit("concat=n="), "total", F.lit(":v=0:a=1[outa]")).alias("graph"))


def edit_list(segments: DataFrame) -> DataFrame:
    """The cut that would be made: every range in order, with its place on the new timeline."""
    before = Window.partitionBy("media_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    return segments.select("media_id", "seg_idx", "start_ms", "end_ms", F.coalesce(F.sum(F.col("end_ms") - F.col("start_ms")).over(before), F.lit(0)).cast("long").alias("record_ms"))


def write_documents(documents: DataFrame, path: str) -> None:
    """(media_id, content) as text, a folder per media, over what is there."""
    documents.select("media_id", F.col("content").alias("value")).write.mode("overwrite").partitionBy("media_id").text(path, lineSep="\n")
