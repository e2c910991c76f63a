"""Reading media, text, saved transcripts, vocabularies, tool logs and audio."""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MEDIA_EXTENSIONS, base64_of, saved_context, saved_segments

#: Settings before any are stored.
DEFAULT_SETTINGS = {"baseUrl": "https://generativelanguage.googleapis.com", "apiKey": "", "model": "gemini-2.0-flash", "glossary": ""}


def media_files(spark: SparkSession, path: str) -> DataFrame:
    """path and size of media files, by extension; contents are not read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(MEDIA_EXTENSIONS) + "}").load(path)
    return listed.select("path", F.col("length").alias("size"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def base64_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", base64_of(F.col("content")).alias("base64"))


def transcripts(documents: DataFrame) -> DataFrame:
    """(media_id, content) of saved transcripts to media_id, context and segments; unreadable ones count as none."""
    return documents.select("media_id", saved_context(F.col("content")).alias("context"), F.coalesce(saved_segments(F.col("content")), F.array().cast("array<struct<start:string,end:string,speaker:string,text:string>>")).alias("segments"))


def segments_of_transcripts(documents: DataFrame) -> DataFrame:
    opened = transcripts(documents).select("media_id", F.posexplode("segments").alias("seg_idx", "s"))
    return opened.select("media_id", F.col("seg_idx").cast("long").alias("seg_idx"), "s.start", "s.end", "s.speaker", "s.text")


def vocabulary(lines: DataFrame) -> DataFrame:
    """(vocab_id, line_no, line) to vocab_id, token_id, token: "token id" lines, shorter ones skipped, the last of an id wins.

    An id that is no whole number fails the job.
    """
    fields = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    rows = lines.select("vocab_id", "line_no", fields.alias("f")).where(F.size("f") >= 2).select("vocab_id", "line_no", F.col("f")[0].alias("token"), F.col("f")[1].cast("long").alias("token_id"))
    return rows.groupBy("vocab_id", "token_id").agg(F.max_by("token", "line_no").alias("token"))


def vocabulary_facts(lines: DataFrame) -> DataFrame:
    """vocab_size and blank_id (the last ``<blk>`` or ``<blank>`` line's; null if there is none, which callers treat as an error)."""
    fields = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    rows = lines.select("vocab_id", "line_no", fields.alias("f")).where(F.size("f") >= 2).select("vocab_id", "line_no", F.col("f")[0].alias("token"), F.col("f")[1].cast("long").alias("token_id"))
    return rows.groupBy("vocab_id").agg(F.count_distinct("token_id").alias("vocab_size"), F.max_by("token_id", F.when(F.col("token").isin("<blk>", "<blank>"), F.col("line_no"))).alias("blank_id"))


def media_durations(log: DataFrame) -> DataFrame:
    """(media_id, ord, line) to duration_ms from the first ``Duration: HH:MM:SS.cc`` of each media; a part that is no number is 0."""
    part = lambda i: F.coalesce(F.regexp_extract("line", r"Duration: (\d+):(\d+):(\d+(?:\.\d+)?)", i).try_cast("decimal(20,6)"), F.lit(0))
    ms = ((part(1) * 3600 + part(2) * 60 + part(3)) * 1000).cast("long")
    return log.where(F.rlike("line", F.lit(r"Duration: \d+:\d+:\d+"))).groupBy("media_id").agg(F.min_by(ms, "ord").alias("duration_ms"))


def required_vocabulary_facts(lines: DataFrame) -> DataFrame:
    """``vocabulary_facts``; a vocabulary without a blank fails the job."""
    missing = F.raise_error(F.concat(F.lit("no blank token in vocabulary "), F.col("vocab_id").cast("string"))).cast("long")
    return vocabulary_facts(lines).withColumn("blank_id", F.coalesce("blank_id", missing))


def required_media_durations(log: DataFrame) -> DataFrame:
    """``media_durations``; a media whose log names no duration fails the job."""
    all_media = log.select("media_id").distinct()
    missing = F.raise_error(F.concat(F.lit("no duration in the log of media "), F.col("media_id").cast("string"))).cast("long")
    return all_media.join(media_durations(log), "media_id", "left").withColumn("duration_ms", F.coalesce("duration_ms", missing))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(media_id, ord, line) of captured tool logs, a file per media; media_id is a hash of the path."""
    whole = text_files(spark, path)
    return whole.select(F.xxhash64("path").alias("media_id"), F.posexplode(F.split("content", "\r?\n")).alias("ord", "line")).withColumn("ord", F.col("ord").cast("long"))


def settings(stored: str | None) -> dict[str, str]:
    """The defaults, overlaid by stored JSON; the defaults alone if that is missing or unreadable."""
    try:
        return DEFAULT_SETTINGS | (json.loads(stored) if stored else {})
    except (ValueError, TypeError):
        return dict(DEFAULT_SETTINGS)


def settings_of(stored: Column) -> dict[str, Column]:
    """The same for a column of stored JSON, by name of the setting; a value that is no string keeps the default."""
    found = F.from_json(stored, "map<string,string>")
    return {name: F.coalesce(F.try_element_at(found, F.lit(name)), F.lit(default)) for name, default in DEFAULT_SETTINGS.items()}


def filter_bank(rate: int, to: int, taps: int) -> tuple[np.ndarray, int, int]:
    """Weights of the input samples around an output sample, for every place that one can have between two input samples.

    Output sample n stands at n * step / phases of the input; a row has 2 * taps weights of a windowed sinc that is cut off below
    both rates' halves.
    """
    phases = to // math.gcd(rate, to)
    step = rate // math.gcd(rate, to)
    cut = min(1.0, to / rate)
    distance = (np.arange(phases) * step % phases / phases)[:, None] - np.arange(-taps + 1, taps + 1)
    return cut * np.sinc(cut * distance) * (0.5 + 0.5 * np.cos(np.pi * np.clip(distance / taps, -1, 1))), step, phases


def resampled_blocks(read: Callable[[int, int], np.ndarray], n: int, rate: int, to: int, taps: int = 32, block: int = 1 << 14) -> Iterator[np.ndarray]:
    """``n`` mono samples at another rate, a block of output at a time; ``read`` gives a range of the input."""
    total = -(-n * to // rate)
    if rate == to:
        for a in range(0, n, block):
            yield read(a, min(n, a + block)).astype(np.float32)
        return
    bank, step, phases = filter_bank(rate, to, taps)
    for first in range(0, total, block):
        at = np.arange(first, min(total, first + block), dtype=np.int64)
        near = at * step // phases
        low, high = int(near[0]) - taps + 1, int(near[-1]) + taps + 1
        inside = np.zeros(high - low)
        a, b = max(low, 0), min(high, n)
        if b > a:
            inside[a - low : b - low] = read(a, b)
        around = np.lib.stride_tricks.sliding_window_view(inside, 2 * taps)[near - near[0]]
        yield np.einsum("ij,ij->i", around, bank[at % phases]).astype(np.float32)


def resampled(x: np.ndarray, rate: int, to: int, taps: int = 32) -> np.ndarray:
    """Mono samples at another rate."""
    found = list(resampled_blocks(lambda a, b: x[a:b], len(x), rate, to, taps))
    return np.concatenate(found) if found else np.zeros(0, np.float32)


class Pcm:
    """Sound to read by ranges: ``rate``, number of frames ``n``, and the mean of the channels as numbers from -1 to 1."""

    def __init__(self, rate: int, n: int, mono: Callable[[int, int], np.ndarray]):
        self.rate, self.n, self.mono = rate, n, mono


def wav(content: memoryview) -> Pcm:
    """A RIFF WAV file of whole-number PCM (8, 16, 24 or 32 bits) or 32 or 64 bit floats, read in place."""
    if bytes(content[:4]) != b"RIFF" or bytes(content[8:12]) != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, data = 12, None, None
    while at + 8 <= len(content) and data is None:
        name, (size,) = bytes(content[at : at + 4]), struct.unpack_from("<I", content, at + 4)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", content, at + 8)
            if kind == 0xFFFE:  # extensible: the kind begins the subformat
                (kind,) = struct.unpack_from("<H", content, at + 32)
            form = kind, channels, rate, bits
        elif name == b"data":
            data = content[at + 8 : min(len(content), at + 8 + size)]
        at += 8 + size + size % 2
    if form is None or data is None:
        raise ValueError("a WAV file without format or data")
    kind, channels, rate, bits = form
    width = bits // 8
    if (kind, bits) not in {(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)}:
        raise ValueError(f"WAV format {kind} with {bits} bits is not supported")

    def mono(a: int, b: int) -> np.ndarray:
        raw = np.frombuffer(data[a * width * channels : b * width * channels], np.uint8)
        if kind == 3:
            x = raw.view(f"<f{width}").astype(np.float64)
        elif width == 1:
            x = raw / 128.0 - 1
        elif width == 3:
            padded = np.zeros((len(raw) // 3, 4), np.uint8)
            padded[:, 1:] = raw.reshape(-1, 3)
            x = padded.ravel().view("<i4") / 2.0**31
        else:
            x = raw.view(f"<i{width}") / 2.0 ** (bits - 1)
        return x.reshape(-1, channels).mean(1)

    return Pcm(rate, len(data) // (width * channels), mono)


def audio_blocks(media: DataFrame, rate: int = 16000, decoder: Callable[[memoryview], Pcm] = wav, block: int = 1 << 18) -> DataFrame:
    """(path, content) to path, first_sample and samples: mono at ``rate``, in blocks of ``block`` samples, so no file is held decoded.

    ``decoder`` turns a file's bytes into sound that is read by ranges; the one here reads WAV. Other codecs need one of their own.
    A file without frames has no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                sound, first, held, size = decoder(memoryview(content.as_buffer())), 0, [], 0
                for some in resampled_blocks(sound.mono, sound.n, sound.rate, rate):
                    held.append(some)
                    size += len(some)
                    while size >= block:
                        flat = np.concatenate(held)
                        yield _audio_row(path, first, flat[:block])
                        first, held, size = first + block, [flat[block:]], size - block
                if size:
                    yield _audio_row(path, first, np.concatenate(held))

    return media.select("path", "content").mapInArrow(read, "path string, first_sample long, samples array<float>")


def _audio_row(path: str, first: int, samples: np.ndarray) -> pa.RecordBatch:
    listed = pa.ListArray.from_arrays(pa.array([0, len(samples)], pa.int32()), pa.array(samples, pa.float32()))
    return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([first], pa.int64()), listed], ["path", "first_sample", "samples"])


def load_audio(media: DataFrame, rate: int = 16000, decoder: Callable[[memoryview], Pcm] = wav) -> DataFrame:
    """(path, content) to path and samples, whole: mono, the mean of the channels, at ``rate``; see ``audio_blocks`` for long files."""
    blocks = audio_blocks(media, rate, decoder).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("first_sample", "samples"))).alias("all"))
    found = blocks.select("path", F.flatten(F.transform("all", lambda b: b["samples"])).alias("samples"))
    return media.select("path").join(found, "path", "left").select("path", F.coalesce("samples", F.array().cast("array<float>")).alias("samples"))
