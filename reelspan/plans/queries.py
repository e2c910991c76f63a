"""The transcript queries: one per operator, over the driver's tables."""

from __future__ import annotations

import io
import uuid
import wave

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions import timecode as tc
from ..operators import chunks, clips, editing, intervals, models
from ..sinks import text as sinks
from ..sources import files, tables
from ..sources.shared import shared_dir
from ..streaming import silence as streamed
from . import sql

S, D = SparkSession, DataFrame
READY: dict = {}


def query(f):
    READY[f.__name__] = f
    return f


def _spelled(rows: D, *columns: str) -> D:
    """Whole numbers that may be null as strings: tools that compare results turn such columns into floats, each in its own way."""
    return rows.withColumns({c: F.col(c).cast("string") for c in columns})


def _selected(spark: S, d: str) -> D:
    return tables.segments(spark, d).where((F.col("seg_idx") % 3 != 1) & (F.col("seg_idx") <= 4)).select("media_id", "seg_idx")


def _translations(spark: S, d: str) -> D:
    return tables.segments(spark, d).where("media_id % 2 = 0").withColumn("text", F.concat(F.lit("~ "), "text")).withColumn("language", F.lit("Spanish"))


def _ranges(spark: S, d: str) -> D:
    return tables.segments(spark, d).where("seg_idx % 3 <> 1").withColumnRenamed("seg_idx", "pos")


def _silences(spark: S, d: str) -> D:
    return intervals.silence_intervals(tables.silence_log(spark, d))


def _media(spark: S, d: str) -> D:
    """Users with a duration: the last event's id, a thousand ms each, plus five seconds; every fifth has none."""
    return tables.table(spark, d, "events").groupBy(F.col("user_id").cast("long").alias("media_id")).agg((F.max("event_id") * 1000 + 5000).cast("long").alias("duration_ms")).withColumn(
        "duration_ms", F.when(F.col("media_id") % 5 != 0, F.col("duration_ms"))
    )


def _points(spark: S, d: str, step: int) -> D:
    return tables.segments(spark, d).select("media_id", F.col("seg_idx").alias("pid"), (F.col("seg_idx") * step).alias("t"))


def _clips(spark: S, d: str) -> D:
    """A clip per customer nation and key: without ranges, with one of its own, with two, or with an empty list."""
    c = tables.table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("media_id"), F.col("c_custkey").cast("long").alias("clip_idx"), F.col("c_name").alias("name"))
    at = lambda k: tc.clock((F.col("clip_idx") % 900 + k) * 1000)
    span = lambda a, b: F.struct(at(a).alias("start"), at(b).alias("end"))
    case = F.col("clip_idx") % 4
    none = F.lit(None).cast("array<struct<start:string,end:string>>")
    listed = F.when(case == 1, F.array(span(0, 30))).when(case == 2, F.array(span(0, 20), span(40, 55))).when(case == 3, F.array().cast("array<struct<start:string,end:string>>")).otherwise(none)
    return c.select("media_id", "clip_idx", F.concat("name", F.lit(" / é! "), F.col("clip_idx") % 7).alias("title"), F.lit("why").alias("reason"), listed.alias("segments"), at(0).alias("start"), at(15).alias("end"))


@query
def segments(spark: S, d: str) -> D:
    return tables.segments(spark, d)


@query
def distinct_speakers(spark: S, d: str) -> D:
    return editing.speakers(tables.segments(spark, d))


@query
def speaker_lists(spark: S, d: str) -> D:
    return editing.speaker_list(tables.segments(spark, d)).select("media_id", F.array_join("speakers", ",").alias("speakers"))


@query
def rename_speaker(spark: S, d: str) -> D:
    return editing.rename_speaker(tables.segments(spark, d), "user", " Host ").select("media_id", "seg_idx", "speaker")


@query
def speaker_exists(spark: S, d: str) -> D:
    return editing.merges_speakers(tables.segments(spark, d), "assistant")


@query
def delete_selected(spark: S, d: str) -> D:
    return editing.delete_segments(tables.segments(spark, d), _selected(spark, d))


@query
def save_edit(spark: S, d: str) -> D:
    seg = tables.segments(spark, d)
    return editing.save_edits(seg, seg.where("seg_idx = 1").withColumn("text", F.concat(F.lit("edited "), "text")).withColumn("end_ms", F.col("end_ms") + 7))


@query
def merge_down(spark: S, d: str) -> D:
    return editing.merge_down(tables.segments(spark, d), 1)


@query
def merge_selected(spark: S, d: str) -> D:
    return editing.merge_selected(tables.segments(spark, d), _selected(spark, d))


@query
def language_view(spark: S, d: str) -> D:
    return editing.language_view(tables.segments(spark, d), _translations(spark, d), "Spanish")


@query
def translation_pending(spark: S, d: str) -> D:
    return editing.untranslated(tables.segments(spark, d), _translations(spark, d), "Spanish").select("media_id", "seg_idx", "text")


@query
def silence_pairs(spark: S, d: str) -> D:
    return _silences(spark, d)


@query
def silence_totals(spark: S, d: str) -> D:
    return _silences(spark, d).groupBy("media_id").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("silent_ms"))


@query
def keep_ranges(spark: S, d: str) -> D:
    return intervals.keep_ranges(_silences(spark, d), _media(spark, d))


@query
def offset_map(spark: S, d: str) -> D:
    return intervals.offset_map(_ranges(spark, d))


@query
def silence_removal(spark: S, d: str) -> D:
    return intervals.silence_removal(tables.silence_log(spark, d), _media(spark, d), 2_000_000)


@query
def timeline_remap(spark: S, d: str) -> D:
    return intervals.remap(tables.segments(spark, d), intervals.offset_map(_ranges(spark, d))).select("media_id", "seg_idx", "new_start_ms", "new_end_ms")


@query
def timeline_remap_exclusive(spark: S, d: str) -> D:
    """Ends on a step, made so: the segments are the kept ranges on the short timeline."""
    steps = intervals.offset_map(_ranges(spark, d))
    short = sinks.edit_list(_ranges(spark, d).withColumnRenamed("pos", "seg_idx")).select("media_id", "seg_idx", F.col("record_ms").alias("start_ms"), (F.col("record_ms") + F.col("end_ms") - F.col("start_ms")).alias("end_ms"))
    return intervals.remap(short, steps, end_exclusive=True).select("media_id", "seg_idx", "new_start_ms", "new_end_ms")


@query
def remap_points(spark: S, d: str) -> D:
    return intervals.remap_by_window(_points(spark, d, 1500), intervals.offset_map(_ranges(spark, d)))


@query
def point_lookup(spark: S, d: str) -> D:
    return _spelled(intervals.locate(_points(spark, d, 2500), _ranges(spark, d).withColumnRenamed("pos", "seg_idx")), "seg_idx", "next_start")


@query
def clock_format(spark: S, d: str) -> D:
    e = tables.table(spark, d, "events").select(F.col("event_id").cast("long").alias("event_id"), (F.col("event_id") * 7919).cast("long").alias("ms"))
    return e.select("event_id", tc.clock(F.col("ms")).alias("clock"), tc.minutes_clock(F.col("ms")).alias("minutes"))


_SHAPES = ["' 00:0' || (x % 10) || ':' || (x % 95)", "(x % 90) || ':' || (x % 70) || '.' || (x % 1200)", "'.' || x", "x || ':' || x || ':' || x || ':1'", "'00:0' || (x % 6) || ':0' || (x % 10) || '500'", "'-' || x || ':00'", "(x % 7) || ',5'", "'1:' || (x % 5) || ':' || (x % 60) || '.5'", "''", "'+' || x"]


@query
def parse_timestamp(spark: S, d: str) -> D:
    e = tables.table(spark, d, "events").selectExpr("cast(event_id as bigint) AS x").selectExpr("x", "case x % 10 " + " ".join(f"when {i} then {s}" for i, s in enumerate(_SHAPES)) + " end AS ts")
    return _spelled(e.select(F.col("x").alias("event_id"), "ts", tc.strict_ms(F.col("ts")).alias("strict_ms"), tc.lenient_ms(F.col("ts")).alias("lenient_ms")), "strict_ms", "lenient_ms")


@query
def subtitle_clocks(spark: S, d: str) -> D:
    e = tables.table(spark, d, "events").selectExpr("cast(event_id as bigint) AS x").selectExpr("x", "case x % 10 " + " ".join(f"when {i} then {s}" for i, s in enumerate(_SHAPES)) + " end AS ts")
    return e.select(F.col("x").alias("event_id"), tc.subtitle_clock(F.col("ts"), ",").alias("srt"), tc.subtitle_clock(F.col("ts"), ".").alias("vtt"))


@query
def subtitle_srt(spark: S, d: str) -> D:
    return sinks.srt(tables.clocked(tables.segments(spark, d)))


@query
def subtitle_vtt(spark: S, d: str) -> D:
    return sinks.vtt(tables.clocked(tables.segments(spark, d)))


@query
def subtitle_txt(spark: S, d: str) -> D:
    return sinks.txt(tables.clocked(tables.segments(spark, d)))


@query
def transcript_lines(spark: S, d: str) -> D:
    return sinks.prompt_lines(tables.clocked(tables.segments(spark, d)))


@query
def filter_graph(spark: S, d: str) -> D:
    return sinks.filter_graph(tables.clocked(tables.segments(spark, d)))


@query
def audio_filter_graph(spark: S, d: str) -> D:
    return sinks.audio_filter_graph(intervals.keep_ranges(_silences(spark, d), _media(spark, d)))


@query
def edit_list(spark: S, d: str) -> D:
    return sinks.edit_list(tables.segments(spark, d))


@query
def paths(spark: S, d: str) -> D:
    """Paths made of supplier names; every third has no extension, every fourth a dot in its folder."""
    p = tables.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.concat(F.when(F.col("s_suppkey") % 4 == 0, "/a.b/").otherwise("/ab/"), F.col("s_name"), F.when(F.col("s_suppkey") % 3 == 0, "").when(F.col("s_suppkey") % 3 == 1, ".mp4").otherwise(".tar.Gz")).alias("path"))
    return p.select(
        "id", fx.is_media(F.col("path")).alias("is_media"), fx.subtitle_path(F.col("path"), F.when(F.col("id") % 2 == 0, "French").otherwise("Original"), "srt").alias("subtitle"),
        fx.cut_path(F.col("path")).alias("cut"), fx.clips_dir(F.col("path")).alias("clips"), fx.audio_path(F.col("path")).alias("audio"), fx.nosilence_path(F.col("path")).alias("nosilence"),
    )


@query
def clip_filenames(spark: S, d: str) -> D:
    docs = tables.table(spark, d, "documents")
    return docs.select("doc_id", fx.clip_filename(F.col("doc_id"), F.col("text")).alias("filename"))


@query
def clip_normalise(spark: S, d: str) -> D:
    n = clips.normalised(_clips(spark, d))
    return n.select("media_id", "clip_idx", F.size("segments").cast("long").alias("n_ranges"), F.get("segments", F.lit(0))["start"].alias("start"), F.get("segments", F.size("segments") - 1)["end"].alias("end"))


@query
def clip_plan(spark: S, d: str) -> D:
    plan = clips.export_plan(clips.normalised(_clips(spark, d)))
    meta = lambda k: F.get_json_object("metadata", k)
    return plan.select("media_id", "clip_idx", "filename", "mode", meta("$.title").alias("title"), meta("$.segments[0].end").alias("first_end"))


@query
def best_clips(spark: S, d: str) -> D:
    return clips.best_clips(clips.normalised(_clips(spark, d)), 3, 10, 32).select("media_id", "clip_idx", "rank", "length_ms")


def _replies(spark: S, d: str) -> D:
    """A reply per turn: prose around an array, no array, brackets the wrong way round, a missing field, no JSON."""
    t = F.regexp_replace("text", r'["\\\[\]\p{Cntrl}]', " ")
    row = F.concat(F.lit('[{"start": "00:01", "end": "00:0'), (F.col("turn") + 2).cast("string"), F.lit('", "speaker": "A", "text": "'), t, F.lit('"}'))
    two = F.concat(row, F.lit(', {"start": "00:03", "end": "00:04", "speaker": "B"'), F.when(F.col("turn") % 5 == 3, "").otherwise(', "text": "b"'), F.lit("}]"))
    case = F.col("turn") % 5
    reply = F.when(case == 1, t).when(case == 2, F.concat(F.lit("] "), t, F.lit(" ["))).when(case == 4, F.concat(F.lit("["), t, F.lit("]"))).otherwise(F.concat(F.lit("Sure:\n"), two, F.lit("\nDone")))
    return tables.table(spark, d, "conversations").select(F.col("conv_id").cast("long").alias("media_id"), F.col("turn").cast("long").alias("turn"), reply.alias("reply"))


@query
def json_extract(spark: S, d: str) -> D:
    found = fx.bracketed(F.col("reply"))
    r = _replies(spark, d).withColumn("json", found).withColumn("rows", fx.segments_of(found)).withColumn("strict", fx.segments_of(found, strict=True))
    return _spelled(r.select(
        "media_id", "turn", F.col("json").isNotNull().alias("bracketed"), F.when(F.col("rows").isNotNull(), F.size("rows")).alias("n_rows"), F.col("strict").isNotNull().alias("complete"),
        F.get("rows", F.lit(0))["end"].alias("first_end"),
    ), "n_rows")


@query
def saved_transcripts(spark: S, d: str) -> D:
    """Written as JSON and read back, one half as the bare array."""
    saved = sinks.saved_transcript(tables.clocked(tables.segments(spark, d)), F.concat(F.lit("about "), F.col("media_id")))
    bare = F.regexp_extract("content", r'(?s)^\{"segments":(\[.*\]),"context"', 1)
    documents = saved.withColumn("content", F.when(F.col("media_id") % 2 == 0, bare).otherwise(F.col("content")))
    return files.segments_of_transcripts(documents).join(files.transcripts(documents).select("media_id", "context"), "media_id")


@query
def chunk20(spark: S, d: str) -> D:
    return chunks.chunked(tables.table(spark, d, "documents").select("lang", F.col("doc_id").cast("long").alias("doc_id")), "lang", "doc_id")


@query
def audio_windows(spark: S, d: str) -> D:
    docs = tables.table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("n_chars") * 1000).cast("long").alias("n_samples"))
    return chunks.sample_windows(docs)


@query
def downmix(spark: S, d: str) -> D:
    frames = tables.table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: ((F.col("o_orderkey") * (i + 3)) % 17).cast("double")).alias("samples"), F.lit(2).alias("channels"))
    mixed = chunks.downmix(frames)
    return mixed.select("id", F.posexplode("mono").alias("frame", "value")).withColumn("frame", F.col("frame").cast("long"))


@query
def word_jaccard(spark: S, d: str) -> D:
    t = tables.table(spark, d, "conversations")
    a, b = (t.where(F.col("turn") == i).select("conv_id", F.col("text").alias(f"t{i}")) for i in (0, 1))
    return a.join(b, "conv_id").select(F.col("conv_id").cast("long").alias("conv_id"), fx.word_jaccard(F.col("t0"), F.col("t1")).alias("similarity"))


@query
def argmax(spark: S, d: str) -> D:
    x = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.when((F.col("o_orderkey") + i) % 11 == 0, F.lit(float("nan"))).otherwise(((F.col("o_orderkey") * (i * 5 + 2)) % 13).cast("double")))
    values = F.when(F.col("o_orderkey") % 32 == 1, F.array().cast("array<double>")).otherwise(x)
    best = fx.argmax(values)
    return tables.table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("id"), best["index"].alias("index"), F.when(best["value"] > float("-inf"), best["value"]).alias("value"))


def _tokens(spark: S, d: str) -> D:
    token = F.when(F.col("l_linenumber") % 5 == 4, "<unk>").when(F.col("l_partkey") % 3 == 0, F.concat(F.lit(" W"), (F.col("l_partkey") % 40).cast("string"))).otherwise(F.concat(F.lit("w"), (F.col("l_partkey") % 40).cast("string")))
    lines = tables.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("stream_id"), "l_linenumber", token.alias("t"))
    return lines.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "t"))).alias("all")).select("stream_id", F.transform("all", lambda x: x["t"]).alias("tokens"))


@query
def detokenise(spark: S, d: str) -> D:
    return _tokens(spark, d).select("stream_id", fx.words_of_tokens(F.col("tokens")).alias("text"))


def _vocabulary_lines(spark: S, d: str) -> D:
    line = F.when(F.col("p_partkey") % 50 == 7, F.concat(F.lit("<blk>  "), F.col("p_partkey") % 300)).when(F.col("p_partkey") % 9 == 0, "short").otherwise(F.concat(F.regexp_replace("p_name", r"\s", "_"), F.lit("\t"), F.col("p_partkey") % 300, F.lit(" ")))
    return tables.table(spark, d, "part").select((F.col("p_partkey") % 4).cast("long").alias("vocab_id"), F.col("p_partkey").cast("long").alias("line_no"), line.alias("line"))


@query
def vocabulary(spark: S, d: str) -> D:
    return files.vocabulary(_vocabulary_lines(spark, d))


@query
def vocabulary_facts(spark: S, d: str) -> D:
    return _spelled(files.vocabulary_facts(_vocabulary_lines(spark, d)), "blank_id")


@query
def token_lookup(spark: S, d: str) -> D:
    ids = tables.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("stream_id"), F.col("l_linenumber").cast("long").alias("pos"), (F.col("l_partkey") % 4).cast("long").alias("vocab_id"), (F.col("l_partkey") % 300).cast("long").alias("token_id"))
    return ids.join(files.vocabulary(_vocabulary_lines(spark, d)), ["vocab_id", "token_id"])


@query
def media_durations(spark: S, d: str) -> D:
    x = F.col("event_id")
    line = F.when(x % 3 == 0, F.concat(F.lit("  Duration: 0"), (x % 9).cast("string"), F.lit(":"), (x % 60).cast("string"), F.lit(":"), (x % 59).cast("string"), F.lit(".25, start"))).otherwise("other")
    return files.media_durations(tables.table(spark, d, "events").select(F.col("user_id").cast("long").alias("media_id"), x.cast("long").alias("ord"), line.alias("line")))


@query
def base_urls(spark: S, d: str) -> D:
    url = F.concat(F.when(F.col("n_nationkey") % 3 == 0, " https://").when(F.col("n_nationkey") % 3 == 1, "http://").otherwise(""), F.lower("n_name"), F.when(F.col("n_nationkey") % 2 == 0, "." + fx.KEYED_HOST + "// ").otherwise("/x"))
    n = tables.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), url.alias("url"))
    return n.select("id", fx.normal_base_url(F.col("url")).alias("url"), fx.keyed_provider(F.col("url")).alias("keyed"))


@query
def model_listing(spark: S, d: str) -> D:
    k = F.col("n_nationkey")
    listing = F.when(k % 4 == 0, F.concat(F.lit('{"models": [{"name": "models/'), F.col("n_name"), F.lit('"}, {"name": ""}, {}]}'))).when(k % 4 == 1, F.concat(F.lit('{"data": [{"id": "'), F.col("n_name"), F.lit('"}, {"id": "b"}]}'))).when(k % 4 == 2, '{"models": []}').otherwise("oops")
    n = tables.table(spark, d, "nation").select(k.cast("long").alias("id"), listing.alias("listing"))
    return n.select("id", F.array_join(fx.model_names(F.col("listing"), F.col("id") % 3 == 0), ",").alias("models"))


@query
def base64_text(spark: S, d: str) -> D:
    return tables.table(spark, d, "documents").select("doc_id", fx.base64_of(F.encode("text", "UTF-8")).alias("base64"))


@query
def media_sizes(spark: S, d: str) -> D:
    return tables.table(spark, d, "documents").select("doc_id", F.round(fx.megabytes(F.col("n_chars") * 1024) * 100).cast("long").alias("hundredths"))


@query
def without_fillers(spark: S, d: str) -> D:
    spoken = F.concat(F.lit("Um, "), F.regexp_replace("text", "[^ -~]", "x"), F.lit(" uh... hmm so ERM yes"))
    return tables.table(spark, d, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), fx.without_fillers(spoken).alias("text"))


@query
def transcript_counts(spark: S, d: str) -> D:
    return tables.segments(spark, d).groupBy("media_id").agg(F.count("*").alias("n_segments"), F.count_distinct("speaker").alias("n_speakers"), F.max("end_ms").alias("length_ms"))


@query
def translate(spark: S, d: str) -> D:
    return models.translate(tables.clocked(tables.segments(spark, d)), "Spanish")


@query
def analyse(spark: S, d: str) -> D:
    return models.analyse(tables.segments(spark, d).select("media_id").distinct())


@query
def suggest_clips(spark: S, d: str) -> D:
    got = models.suggest_clips(sinks.prompt_lines(tables.clocked(tables.segments(spark, d))))
    return got.select("media_id", "clip_idx", F.to_json("segments").alias("ranges"), "title", "reason")


def _step(stream: int, frame: int, last: int) -> tuple[int, int]:
    return (stream * 7 + frame * 5 + last) % 6, (stream + frame) % 4


@query
def greedy_decode(spark: S, d: str) -> D:
    streams = tables.table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("stream_id"), (F.col("c_custkey") % 200).cast("long").alias("n_frames"))
    return models.decode_streams(streams, _step, 0).select("stream_id", F.array_join(F.col("token_ids").cast("array<string>"), " ").alias("tokens"))


@query
def local_transcript(spark: S, d: str) -> D:
    docs = tables.table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("media_id"), (F.col("n_chars") * 1000).cast("long").alias("n_samples"))
    return models.local_transcript(docs)


@query
def feature_transpose(spark: S, d: str) -> D:
    key = F.col("o_orderkey")
    frames = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda t: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda f: (key * (t + 2) + f) % 19))
    turned = tables.table(spark, d, "orders").select(key.cast("long").alias("id"), chunks.features_first(frames).alias("features"))
    return turned.select("id", F.to_json("features").alias("features"))


@query
def languages(spark: S, d: str) -> D:
    return tables.table(spark, d, "nation").select(F.explode(F.array(*map(F.lit, fx.LANGUAGES))).alias("language")).distinct()


@query
def settings(spark: S, d: str) -> D:
    """Stored settings of four kinds: none, some, not JSON, with names that are not known."""
    k = F.col("n_nationkey")
    stored = F.when(k % 4 == 0, F.concat(F.lit('{"model": "m'), k.cast("string"), F.lit('", "glossary": "a, b"}'))).when(k % 4 == 1, "{oops").when(k % 4 == 2, '{"apiKey": "k", "other": "x"}')
    return tables.table(spark, d, "nation").select(k.cast("long").alias("id"), *(c.alias(name) for name, c in files.settings_of(stored).items()))


def _scratch(spark: S, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _written(spark: S, d: str, path: str) -> None:
    """Every nation's comment as a text file of its own."""
    sinks.write_documents(tables.table(spark, d, "nation").select(F.col("n_nationkey").alias("media_id"), F.concat("n_name", F.lit("\n"), "n_regionkey").alias("content")), path)


@query
def text_documents(spark: S, d: str) -> D:
    """Written as files and read back whole."""
    _written(spark, d, path := _scratch(spark, "texts"))
    return files.text_files(spark, path + "/*").select(F.regexp_extract("path", r"media_id=(\d+)", 1).cast("long").alias("media_id"), "content")


@query
def tool_logs(spark: S, d: str) -> D:
    """Written as files and read back by lines; a media is known by the hash of its path, so only lines are compared."""
    _written(spark, d, path := _scratch(spark, "logs"))
    return files.log_lines(spark, path + "/*").groupBy("ord", "line").agg(F.count_distinct("media_id").alias("n"))


@query
def audio(spark: S, d: str) -> D:
    """Stereo WAV files made of the nations' keys, decoded: 16 bits for even keys, 24 for odd ones."""

    def made(batches):
        for batch in batches:
            keys = batch.column("n_nationkey").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(map(str, keys)), pa.array([_wav(int(k)) for k in keys], pa.binary())], ["path", "content"])

    media = tables.table(spark, d, "nation").select("n_nationkey").mapInArrow(made, "path string, content binary")
    heard = files.load_audio(media).select(F.col("path").cast("long").alias("id"), F.posexplode("samples").alias("sample", "value"))
    return heard.select("id", F.col("sample").cast("long").alias("sample"), F.round(F.col("value") * 65536).cast("long").alias("value"))


def _wav(key: int) -> bytes:
    out, width = io.BytesIO(), 2 + key % 2
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(width)
        w.setframerate(16000)
        w.writeframes(b"".join(((key * 131 + i * 17) % 2000 - 1000 << 8 * (width - 2)).to_bytes(width, "little", signed=True) for i in range(2 * (50 + key))))
    return out.getvalue()


@query
def silence_stream(spark: S, d: str) -> D:
    """Silence pairs as a stream finds them in the lines of the log, read to its end."""
    source, out, at = (_scratch(spark, name) for name in ("log", "pairs", "progress"))
    tables.silence_log(spark, d).write.parquet(source)
    lines = spark.readStream.schema("media_id long, ord long, line string").parquet(source)
    run = streamed.silence_stream(lines).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("media_id long, ord long, start_ms long, end_ms long, duration_ms long").parquet(out)


QUERIES = dict(READY)
ORACLES = sql.ORACLES
