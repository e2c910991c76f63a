"""Interval algebra on media timelines: silences, what is left without them, and times mapped between timelines.

Tables are keyed by media_id and times are whole milliseconds, so every window and join is partitioned by the media.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: What the silence detector writes before a time, and how it writes the time.
STARTS, ENDS, SECONDS = "silence_start: ", "silence_end: ", r"(\d+(\.\d+)?)"
#: A segment longer than this is a mistake in the data, not speech.
LONGEST_MS = 10 * 86_400_000


def _ms(number: Column) -> Column:
    return F.round(number.try_cast("decimal(30,9)") * 1000).cast("long")


def silence_marks(log: DataFrame) -> DataFrame:
    """media_id, ord, kind (S or E) and value of the marker lines of (media_id, ord, line); a start is never read as an end."""
    start = F.regexp_extract("line", STARTS + SECONDS, 1)
    end = F.regexp_extract("line", ENDS + SECONDS, 1)
    kind = F.when(start != "", "S").when(end != "", "E")
    return log.select("media_id", "ord", kind.alias("kind"), _ms(F.when(start != "", start).otherwise(end)).alias("value")).where("kind is not null and value is not null")


def silence_intervals(log: DataFrame) -> DataFrame:
    """media_id, ord, start_ms, end_ms, duration_ms: an end right after a start among the markers; ord is the end's."""
    order = Window.partitionBy("media_id").orderBy("ord")
    marks = silence_marks(log).select("*", F.lag("kind").over(order).alias("last_kind"), F.lag("value").over(order).alias("start_ms"))
    return marks.where("kind = 'E' and last_kind = 'S'").select("media_id", "ord", "start_ms", F.col("value").alias("end_ms"), (F.col("value") - F.col("start_ms")).alias("duration_ms"))


def keep_ranges(silences: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """What the silences of each media leave: media_id, pos, start_ms, end_ms.

    In the order of ord, a range runs from the end of the silence before (not from the largest end so far) to the next start, if it
    has a length; the last one runs to the media's duration, or for an hour where (media_id, duration_ms) has none.
    """
    order = Window.partitionBy("media_id").orderBy("ord")
    between = silences.select("media_id", "ord", F.lag("end_ms", 1, 0).over(order).alias("start_ms"), F.col("start_ms").alias("end_ms"))
    last = silences.groupBy("media_id").agg(F.max_by("end_ms", "ord").alias("start_ms"), F.max("ord").alias("ord"))
    known = last.join(durations, "media_id", "left") if durations is not None else last.withColumn("duration_ms", F.lit(None).cast("long"))
    tail = known.select("media_id", F.col("ord"), "start_ms", F.coalesce("duration_ms", F.col("start_ms") + 3_600_000).alias("end_ms"))
    ranges = between.withColumn("tail", F.lit(0)).unionByName(tail.withColumn("tail", F.lit(1))).where("end_ms > start_ms")
    pos = F.row_number().over(Window.partitionBy("media_id").orderBy("ord", "tail")) - 1
    return ranges.select("media_id", pos.cast("long").alias("pos"), "start_ms", "end_ms")


def offset_map(ranges: DataFrame, order: str = "pos") -> DataFrame:
    """(media_id, min_time, offset): where each kept range begins on the shortened timeline and how far it was moved."""
    before = Window.partitionBy("media_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    at = ranges.select("media_id", "start_ms", F.coalesce(F.sum(F.col("end_ms") - F.col("start_ms")).over(before), F.lit(0)).cast("long").alias("min_time"))
    return at.select("media_id", "min_time", (F.col("start_ms") - F.col("min_time")).alias("offset"))


def silence_removal(log: DataFrame, media: DataFrame, min_ms: int = 10_000) -> DataFrame:
    """Offset maps for all of (media_id, duration_ms): media without silences of ``min_ms`` keep their timeline, (0, 0).

    A media that is silent throughout has no range and no offset.
    """
    silences = silence_intervals(log).where(F.col("duration_ms") >= min_ms)
    cut = offset_map(keep_ranges(silences, media.select("media_id", "duration_ms")))
    same = media.select("media_id").join(silences.select("media_id").distinct(), "media_id", "left_anti")
    return cut.unionByName(same.select("media_id", F.lit(0).cast("long").alias("min_time"), F.lit(0).cast("long").alias("offset")))


def _last_step(rows: DataFrame, offsets: DataFrame, time: str, out: str, strict: bool = False) -> DataFrame:
    """``rows`` with ``out``: their time plus the offset of the last step at or before it (or before it only), 0 if none.

    Steps and rows go through one sort together, so a media with very many of either is no more work than its rows. All columns
    of ``rows`` are carried in a struct, so names cannot clash.
    """
    kind = F.lit(0 if strict else 2)
    own = rows.select("media_id", F.col(time).alias("t"), F.struct("*").alias("row"), F.lit(None).cast("long").alias("offset"), kind.alias("kind"))
    steps = offsets.select("media_id", F.col("min_time").alias("t"), F.lit(None).cast(own.schema["row"].dataType).alias("row"), "offset", F.lit(1).alias("kind"))
    so_far = Window.partitionBy("media_id").orderBy("t", "kind", "offset").rowsBetween(Window.unboundedPreceding, 0)
    moved = own.unionByName(steps).withColumn("step", F.last("offset", ignorenulls=True).over(so_far)).where("kind <> 1")
    return moved.select("row.*", (F.col("t") + F.coalesce("step", F.lit(0))).alias(out))


def remap(segments: DataFrame, offsets: DataFrame, end_exclusive: bool = False) -> DataFrame:
    """Segments with new_start_ms and new_end_ms: each time plus the offset of the last step at or before it, 0 if none.

    With ``end_exclusive`` an end that is exactly on a step stays in the range before it. A null time stays null.
    """
    return _last_step(_last_step(segments, offsets, "start_ms", "new_start_ms"), offsets, "end_ms", "new_end_ms", end_exclusive)


def remap_by_window(points: DataFrame, offsets: DataFrame) -> DataFrame:
    """(media_id, pid, t) with new_t, by one sort of points and steps together; steps go before points of the same time."""
    both = offsets.select("media_id", F.lit(None).cast("long").alias("pid"), F.col("min_time").alias("t"), "offset", F.lit(0).alias("kind")).unionByName(
        points.select("media_id", "pid", "t", F.lit(None).cast("long").alias("offset"), F.lit(1).alias("kind"))
    )
    so_far = Window.partitionBy("media_id").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("step", F.last("offset", ignorenulls=True).over(so_far)).where("kind = 1").select("media_id", "pid", "t", (F.col("t") + F.coalesce("step", F.lit(0))).alias("new_t"))


def locate(points: DataFrame, segments: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """(media_id, pid, t) with seg_idx of the first segment that holds t (start <= t < end), else next_start, else stop.

    stop says that t is past the end of the last segment. Segments are met by media and time bucket, so that a long media does not
    pair all its points with all its segments; the next start comes from one sort of starts and points. A segment of more than ten
    days is an error: one false end would fill millions of buckets.
    """
    sane = F.when(F.col("end_ms") - F.col("start_ms") > LONGEST_MS, F.raise_error(F.concat(F.lit("segment too long in media "), F.col("media_id").cast("string"))).cast("boolean")).otherwise(F.col("end_ms") > F.col("start_ms"))
    spans = segments.where(sane).select(
        "media_id", "seg_idx", "start_ms", "end_ms", F.explode(F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor((F.col("end_ms") - 1) / bucket_ms))).alias("bucket")
    )
    at = points.withColumn("bucket", F.floor(F.col("t") / bucket_ms))
    inside = at.alias("p").join(spans.alias("s"), (F.col("p.media_id") == F.col("s.media_id")) & (F.col("p.bucket") == F.col("s.bucket")) & (F.col("t") >= F.col("start_ms")) & (F.col("t") < F.col("end_ms"))).groupBy(
        F.col("p.media_id").alias("media_id"), "pid"
    ).agg(F.min("seg_idx").alias("seg_idx"))
    both = segments.select("media_id", F.lit(None).cast("long").alias("pid"), F.col("start_ms").alias("t"), F.col("start_ms").alias("start"), F.lit(1).alias("kind")).unionByName(
        points.select("media_id", "pid", "t", F.lit(None).cast("long").alias("start"), F.lit(0).alias("kind"))
    )
    # from the end: starts of the same time come after a point, for only later ones are next
    later = Window.partitionBy("media_id").orderBy(F.desc("t"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    ahead = both.withColumn("next_start", F.last("start", ignorenulls=True).over(later)).where("kind = 0").select("media_id", "pid", "t", "next_start")
    ends = segments.groupBy("media_id").agg(F.max_by("end_ms", "seg_idx").alias("last_end"))
    found = ahead.join(inside, ["media_id", "pid"], "left").join(ends, "media_id", "left")
    out = F.col("seg_idx").isNull()
    return found.select("media_id", "pid", "t", "seg_idx", F.when(out, F.col("next_start")).alias("next_start"), F.coalesce(out & F.col("next_start").isNull() & (F.col("t") > F.col("last_end")), F.lit(False)).alias("stop"))
