"""The boundary to models: the dataflow around them, with the model itself passed in.

Every operator takes a client, a plain function that runs on the executors. The stand-ins here need no network and always
give the same answer, so that pipelines can be tested whole; real clients have the same signatures.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bracketed, segments_of
from .chunks import chunked, sample_windows

#: Fixed value: what stands for a reply without text.
NO_TEXT = "No text response"
#: The segment that a prompt shows as an example.
EXAMPLE = {"start": "00:00", "end": "00:05", "speaker": "Speaker 1", "text": "A sentence as it was said."}


def example_reply() -> str:
    """A reply of the form that is asked for, as a prompt shows it: a JSON array of one segment, without spaces."""
    return json.dumps([EXAMPLE], separators=(",", ":"), ensure_ascii=False)


def analysis_prompt(glossary: str, speaker_count: int | None, remove_fillers: bool) -> str:
    """Instructions for a transcription, with the clauses that apply."""
    parts = ["Transcribe the recording as a JSON array of objects with the fields start, end, speaker and text; times as MM:SS.", f"For example: {example_reply()}"]
    if speaker_count:
        parts.append(f"There are {speaker_count} speakers.")
    if glossary:
        parts.append(f"Spell these terms as given: {glossary}")
    if remove_fillers:
        parts.append("Leave out filler words.")
    return "\n".join(parts)


def translation_prompt(language: str, context: str) -> str:
    return f"Translate the text fields of this JSON array to {language}; change nothing else." + (f"\nContext: {context}" if context else "")


def clip_prompt(count: int, min_seconds: int, max_seconds: int, topic: str | None, splicing: bool) -> str:
    parts = [f"Name the {count} most interesting clips of {min_seconds} to {max_seconds} seconds as a JSON array of objects with segments, title and reason."]
    if topic:
        parts.append(f"Only clips about: {topic}")
    parts.append("A clip may join several ranges." if splicing else "A clip is one range.")
    return "\n".join(parts)


def offline_analysis(media_id: int, prompt: str) -> str:
    return "Here it is:\n" + json.dumps([{"start": "00:00", "end": f"00:{media_id % 50 + 1:02d}", "speaker": "Speaker 1", "text": f"media {media_id}"}]) + "\nDone."


def offline_translation(rows: list[dict], prompt: str) -> str:
    return json.dumps([r | {"text": "~ " + r["text"]} for r in rows])


def offline_clips(transcript: str, prompt: str) -> str:
    lines = transcript.split("\n")
    start, end = lines[0][1:].split("]")[0].split("-")
    return json.dumps([{"segments": [{"start": start, "end": end}], "title": f"Clip of {len(lines)} lines", "reason": "first"}])


def analyse(media: DataFrame, client: Callable[[int, str], str | None] = offline_analysis, glossary: str = "", speaker_count: int | None = None, remove_fillers: bool = False) -> DataFrame:
    """(media_id) to its segments: one request per media; a missing reply reads as 'No text response', which has no segments."""
    prompt = analysis_prompt(glossary, speaker_count, remove_fillers)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"media_id": pdf["media_id"], "reply": [client(int(m), prompt) or NO_TEXT for m in pdf["media_id"]]})

    replies = media.select("media_id").mapInPandas(ask, "media_id long, reply string")
    opened = replies.select("media_id", F.posexplode(segments_of(bracketed(F.col("reply")))).alias("seg_idx", "s"))
    return opened.select("media_id", F.col("seg_idx").cast("long").alias("seg_idx"), "s.start", "s.end", "s.speaker", "s.text")


def translate(segments: DataFrame, language: str, client: Callable[[list[dict], str], str] = offline_translation, context: str = "", size: int = 20) -> DataFrame:
    """(media_id, seg_idx, start, end, speaker, text) with the text translated, in requests of ``size`` rows.

    A reply that is no complete list of segments fails the job, as any failed chunk fails the whole. Keys and times are the
    input's: a reply with more rows than asked for loses them, one with fewer leaves the last texts null.
    """
    prompt = translation_prompt(language, context)

    def texts(rows: list[dict]) -> list[str | None]:
        reply = client(rows, prompt)
        start, end = reply.find("["), reply.rfind("]")
        got = json.loads(reply[start : end + 1] if 0 <= start <= end else reply)
        if any(not isinstance(g, dict) or not {"start", "end", "speaker", "text"} <= set(g) for g in got):
            raise ValueError("a reply lacks fields of a segment")
        return [g["text"] for g in got][: len(rows)] + [None] * (len(rows) - len(got))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for media, rows in zip(batch.column("media_id").to_pylist(), batch.column("rows").to_pylist()):
                said = texts([{c: r[c] for c in ("start", "end", "speaker", "text")} for r in rows])
                kept = [pa.array([r[c] for r in rows], t) for c, t in (("seg_idx", pa.int64()), ("start", pa.string()), ("end", pa.string()), ("speaker", pa.string()))]
                yield pa.RecordBatch.from_arrays([pa.array([media] * len(rows), pa.int64()), *kept, pa.array(said, pa.string())], ["media_id", "seg_idx", "start", "end", "speaker", "text"])

    # one row a request, gathered in the JVM, so that Python sees batches and not a call for each small group
    requests = chunked(segments, "media_id", "seg_idx", size).groupBy("media_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "start", "end", "speaker", "text"))).alias("rows"))
    return requests.select(F.col("media_id").cast("long").alias("media_id"), "rows").mapInArrow(ask, "media_id long, seg_idx long, start string, end string, speaker string, text string")


def suggest_clips(transcripts: DataFrame, client: Callable[[str, str], str] = offline_clips, count: int = 3, min_seconds: int = 10, max_seconds: int = 120, topic: str | None = None, splicing: bool = False) -> DataFrame:
    """(media_id, transcript) to clips: media_id, clip_idx, segments, title, reason, in the model's order."""
    prompt = clip_prompt(count, min_seconds, max_seconds, topic, splicing)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"media_id": pdf["media_id"], "reply": [client(t, prompt) for t in pdf["transcript"]]})

    kind = "array<struct<segments:array<struct<start:string,end:string>>,title:string,reason:string,start:string,end:string>>"
    replies = transcripts.select("media_id", "transcript").mapInPandas(ask, "media_id long, reply string")
    clips = replies.select("media_id", F.posexplode(F.from_json(bracketed(F.col("reply")), kind)).alias("clip_idx", "c"))
    own = F.coalesce("c.segments", F.array(F.struct(F.col("c.start").alias("start"), F.col("c.end").alias("end"))))
    return clips.select("media_id", F.col("clip_idx").cast("long").alias("clip_idx"), own.alias("segments"), "c.title", "c.reason")


def greedy_tokens(step: Callable[[int, int], tuple[int, int]], frames: int, blank: int, most_a_frame: int = 10, most: int = 4096) -> list[int]:
    """Token ids of one stream. ``step`` gives the best token and duration bin for a frame and the last token.

    A blank goes on one frame. A token is taken and its duration goes on (0 as 1); after ten tokens without a blank the next
    goes on one frame only, and the count of tokens, which a duration does not reset, starts again.
    """
    out: list[int] = []
    frame = taken = 0
    while frame < frames and len(out) < most:
        token, bins = step(frame, out[-1] if out else blank)
        if token == blank:
            frame, taken = frame + 1, 0
            continue
        out.append(token)
        taken += 1
        if taken >= most_a_frame:
            frame, taken = frame + 1, 0
        else:
            frame += max(1, bins)
    return out


def decode_streams(streams: DataFrame, step: Callable[[int, int, int], tuple[int, int]], blank: int) -> DataFrame:
    """(stream_id, n_frames) with token_ids; ``step`` also gets the stream's id. Streams are independent, so each is one row's work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = [greedy_tokens(lambda f, t, s=int(s): step(s, f, t), int(n), blank) for s, n in zip(pdf["stream_id"], pdf["n_frames"])]
            yield pd.DataFrame({"stream_id": pdf["stream_id"], "token_ids": [np.array(i, np.int64) for i in ids]})

    return streams.select("stream_id", "n_frames").mapInPandas(run, "stream_id long, token_ids array<long>")


def offline_speech(media_id: int, start_sample: int, end_sample: int) -> tuple[float, float, str]:
    return 0.0, (end_sample - start_sample) / 16000, f"media {media_id} from {start_sample}"


def local_transcript(lengths: DataFrame, client: Callable[[int, int, int], tuple[float, float, str]] = offline_speech, rate: int = 16000) -> DataFrame:
    """(media_id, n_samples) to one segment per window, times moved by the window's start, speaker Local; overlaps stay doubled."""
    windows = sample_windows(lengths)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [client(int(m), int(a), int(b)) for m, a, b in zip(pdf["media_id"], pdf["start_sample"], pdf["end_sample"])]
            at = [int(a) * 1000 // rate for a in pdf["start_sample"]]
            yield pd.DataFrame({
                "media_id": pdf["media_id"], "seg_idx": pdf["window"], "start_ms": [t + int(g[0] * 1000 + 0.5) for t, g in zip(at, got)],
                "end_ms": [t + int(g[1] * 1000 + 0.5) for t, g in zip(at, got)], "speaker": "Local", "text": [g[2] for g in got],
            })

    return windows.select("media_id", "window", "start_sample", "end_sample").mapInPandas(run, "media_id long, seg_idx long, start_ms long, end_ms long, speaker string, text string")
