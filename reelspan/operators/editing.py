"""Edits of transcripts. Position is identity, so every edit that takes rows away numbers the rest anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["media_id", "seg_idx"]


def renumbered(segments: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("media_id").orderBy("seg_idx")) - 1
    return segments.withColumn("seg_idx", place.cast("long"))


def speakers(segments: DataFrame) -> DataFrame:
    """Distinct speakers of each media; order by both columns for a sorted list (by bytes of UTF-8)."""
    return segments.select("media_id", "speaker").distinct()


def speaker_list(segments: DataFrame) -> DataFrame:
    """media_id and its distinct speakers as one sorted list (by bytes of UTF-8); a null speaker is left out."""
    return speakers(segments).groupBy("media_id").agg(F.array_sort(F.collect_list("speaker")).alias("speakers"))


def rename_speaker(segments: DataFrame, old: str, new: str) -> DataFrame:
    """``new`` for ``old``, exactly matched; nothing changes if the trimmed new name is empty or the same."""
    name = new.strip()
    if not name or name == old:
        return segments
    return segments.withColumn("speaker", F.when(F.col("speaker") == old, name).otherwise(F.col("speaker")))


def merges_speakers(segments: DataFrame, new: str) -> DataFrame:
    """Media in which a speaker of that name exists already, so that a rename would merge two."""
    return segments.select("media_id").distinct().join(segments.where(F.col("speaker") == new.strip()).select("media_id"), "media_id", "left_semi")


def delete_segments(segments: DataFrame, selected: DataFrame) -> DataFrame:
    """Without the (media_id, seg_idx) of ``selected``."""
    return renumbered(segments.join(selected.select(*KEY), KEY, "left_anti"))


def save_edits(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows of ``edits`` in place of those with their key; keys that do not exist are ignored."""
    fields = [c for c in segments.columns if c not in KEY]
    new = edits.select(*KEY, F.struct(*fields).alias("edit"))
    return segments.join(new, KEY, "left").select(*KEY, *(F.when(F.col("edit").isNotNull(), F.col(f"edit.{c}")).otherwise(F.col(c)).alias(c) for c in fields))


def _merged(grouped: DataFrame) -> DataFrame:
    """Rows that share (media_id, grp) as one: first start and speaker, last end, texts joined by a space."""
    by = grouped.groupBy("media_id", "grp").agg(
        F.min_by("start_ms", "seg_idx").alias("start_ms"), F.max_by("end_ms", "seg_idx").alias("end_ms"), F.min_by("speaker", "seg_idx").alias("speaker"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda s: s["text"]), " ").alias("text"),
    )
    return renumbered(by.withColumnRenamed("grp", "seg_idx")).select(*KEY, "start_ms", "end_ms", "speaker", "text")


def merge_down(segments: DataFrame, index: int) -> DataFrame:
    """Row ``index`` of each media and the one after it as one; a last row stays."""
    return _merged(segments.withColumn("grp", F.when(F.col("seg_idx") == index + 1, index).otherwise(F.col("seg_idx"))))


def merge_selected(segments: DataFrame, selected: DataFrame) -> DataFrame:
    """The selected rows of each media as one at the place of the first; rows between them stay after it; fewer than two stay."""
    picked = selected.select(*KEY).distinct().withColumn("picked", F.lit(True))
    chosen = selected.select(*KEY).distinct().groupBy("media_id").agg(F.min("seg_idx").alias("first"), F.count("*").alias("n"))
    marked = segments.join(picked, KEY, "left").join(chosen, "media_id", "left")
    grp = F.when(F.col("picked") & (F.col("n") >= 2), F.col("first")).otherwise(F.col("seg_idx"))
    return _merged(marked.withColumn("grp", grp))


def language_view(segments: DataFrame, translations: DataFrame, language: str) -> DataFrame:
    """The rows of that translation for media that have any, the original rows for all others (and for ``Original``)."""
    if language == "Original":
        return segments
    there = translations.where(F.col("language") == language).select(*segments.columns)
    return there.unionByName(segments.join(there.select("media_id").distinct(), "media_id", "left_anti"))


def untranslated(segments: DataFrame, translations: DataFrame, language: str) -> DataFrame:
    """Rows of media without a translation to that language: what is left to do."""
    return segments.join(translations.where(F.col("language") == language).select("media_id").distinct(), "media_id", "left_anti")
