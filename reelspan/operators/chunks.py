"""Ordered chunks, overlapping windows, channel downmix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunked(rows: DataFrame, key: str, order: str, size: int = 20) -> DataFrame:
    """Adds pos, the 0-based place within ``key``, and chunk, ``size`` places each."""
    pos = (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("long")
    return rows.withColumn("pos", pos).withColumn("chunk", F.floor(F.col("pos") / size).cast("long"))


def sample_windows(lengths: DataFrame, n: str = "n_samples", size: int = 480_000, overlap: int = 48_000) -> DataFrame:
    """One row per window of each row: window, start_sample, end_sample. The first that reaches the end is the last; none for no samples."""
    hop = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.col(n) - size) / hop)) * hop
    starts = F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(hop).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    opened = lengths.select("*", F.posexplode(starts).alias("window", "start_sample"))
    return opened.withColumn("window", F.col("window").cast("long")).withColumn("end_sample", F.least(F.col("start_sample") + size, F.col(n)))


def features_first(frames: Column) -> Column:
    """An array of frames, each an array of features, turned into an array of features over time; all frames have as many as the first."""
    n = F.coalesce(F.size(F.get(frames, F.lit(0))), F.lit(0))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda f: F.transform(frames, lambda x: F.get(x, f)))).otherwise(F.slice(frames, 1, 0))


def downmix(frames: DataFrame, samples: str = "samples", channels: str = "channels") -> DataFrame:
    """Interleaved samples (an array) to ``mono``: the mean of each frame's channels; an unfinished frame is dropped."""
    n = F.floor(F.size(samples) / F.col(channels)).cast("int")
    frame = lambda i: F.slice(F.col(samples), i * F.col(channels) + 1, F.col(channels))
    mean = lambda i: F.aggregate(frame(i), F.lit(0.0), lambda a, x: a + x, lambda a: a / F.col(channels))
    return frames.withColumn("mono", F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), mean)).otherwise(F.array().cast("array<double>")))
