"""Files in and out, the model boundary and the stream."""

import io
import json
import struct
import tracemalloc
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspan.operators import models
from reelspan.sinks import text as sinks
from reelspan.sources import files
from reelspan.streaming.silence import silence_stream


def test_media_and_text_files(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(b"123")
    (tmp_path / "b.txt").write_text("x\ny")
    assert [r["size"] for r in files.media_files(spark, str(tmp_path)).collect()] == [3]
    assert files.text_files(spark, str(tmp_path / "b.txt")).first()["content"] == "x\ny"
    assert files.base64_files(spark, str(tmp_path / "a.mp4")).first()["base64"] == "MTIz"
    assert files.log_lines(spark, str(tmp_path / "b.txt")).count() == 2


def test_transcripts(spark):
    docs = spark.createDataFrame([(1, '[{"start":"0","end":"1","speaker":"A","text":"t"}]'), (2, '{"segments":[],"context":"c"}'), (3, "oops")], "media_id long, content string")
    got = {r["media_id"]: (len(r["segments"]), r["context"]) for r in files.transcripts(docs).collect()}
    assert got == {1: (1, None), 2: (0, "c"), 3: (0, None)}


def test_vocabulary(spark):
    lines = ["a 0", "b\t1  x", "short", "", "<blk> 2", "c 1", "<blank> 3"]
    v = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "vocab_id long, line_no long, line string")
    assert {r["token_id"]: r["token"] for r in files.vocabulary(v).collect()} == {0: "a", 1: "c", 2: "<blk>", 3: "<blank>"}
    facts = files.vocabulary_facts(v).first()
    assert (facts["vocab_size"], facts["blank_id"]) == (4, 3)
    with pytest.raises(Exception):
        files.vocabulary(spark.createDataFrame([(1, 0, "a x")], "vocab_id long, line_no long, line string")).collect()


def test_durations_and_settings(spark):
    log = spark.createDataFrame([(1, 0, "x"), (1, 1, " Duration: 01:02:03.45, start"), (1, 2, "Duration: 00:00:01.00")], "media_id long, ord long, line string")
    assert files.media_durations(log).first()["duration_ms"] == 3723450
    assert files.settings('{"model":"m"}')["model"] == "m" and files.settings("oops") == files.DEFAULT_SETTINGS == files.settings(None)


def test_audio(spark):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        tone = (np.sin(np.arange(8000) * 2 * np.pi * 440 / 8000) * 20000).astype("<i2")
        w.writeframes(np.stack([tone, tone], 1).tobytes())
    got = np.array(files.load_audio(spark.createDataFrame([("x", bytearray(out.getvalue()))], "path string, content binary")).first()["samples"])
    want = np.sin(np.arange(16000) * 2 * np.pi * 440 / 16000) * 20000 / 32768
    assert len(got) == 16000 and np.abs(got - want)[200:-200].max() < 0.01


def made_wav(kind, bits, channels, rate, data):
    head = struct.pack("<HHIIHH", kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVE" + b"junk" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(data)) + data


@pytest.mark.parametrize("kind, bits", [(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)])
def test_wav_of_all_widths(kind, bits):
    want = np.array([[0.5, -0.25], [0.0, 0.75], [-1.0, -0.5]])
    if kind == 3:
        data = want.astype(f"<f{bits // 8}").tobytes()
    else:
        whole = np.round(want * 2 ** (bits - 1)).astype(int).ravel().tolist()
        data = bytes(128 + x for x in whole) if bits == 8 else b"".join(x.to_bytes(bits // 8, "little", signed=True) for x in whole)
    sound = files.wav(memoryview(made_wav(kind, bits, 2, 16000, data)))
    assert (sound.rate, sound.n) == (16000, 3) and np.allclose(sound.mono(0, 3), want.mean(1), atol=1e-6) and np.allclose(sound.mono(1, 2), want.mean(1)[1:2], atol=1e-6)


def test_odd_audio(spark):
    with pytest.raises(ValueError):
        files.wav(memoryview(b"no sound at all"))
    media = spark.createDataFrame([("none", bytearray(made_wav(1, 16, 1, 16000, b""))), ("own", bytearray(b"abc"))], "path string, content binary")
    assert [r["samples"] for r in files.load_audio(media.where("path = 'none'")).collect()] == [[]]
    own = files.load_audio(media.where("path = 'own'"), decoder=lambda content: files.Pcm(16000, len(content), lambda a, b: np.frombuffer(content[a:b], np.uint8) / 256.0))
    assert own.first()["samples"] == [x / 256 for x in b"abc"]


def test_audio_blocks(spark):
    x = (np.sin(np.arange(50000) / 9) * 30000).astype("<i2")
    media = spark.createDataFrame([("x", bytearray(made_wav(1, 16, 1, 44100, x.tobytes())))], "path string, content binary")
    blocks = files.audio_blocks(media, block=4000).orderBy("first_sample").collect()
    assert [r["first_sample"] for r in blocks] == list(range(0, 18141, 4000)) and {len(r["samples"]) for r in blocks[:-1]} == {4000}
    whole = files.load_audio(media).first()["samples"]
    assert [v for r in blocks for v in r["samples"]] == whole and len(whole) == -(-50000 * 160 // 441)
    at = np.arange(len(whole)) * 44100 / 16000
    assert np.abs(np.array(whole) - np.sin(at / 9) * 30000 / 32768)[100:-100].max() < 0.01


def test_resampling_takes_little_memory():
    tracemalloc.start()
    n = 44100 * 120
    assert sum(len(b) for b in files.resampled_blocks(lambda a, b: np.ones(b - a), n, 44100, 16000)) == -(-n * 160 // 441)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6


def test_what_is_missing_can_be_an_error(spark):
    v = spark.createDataFrame([(1, 0, "<blk> 2"), (2, 0, "a 1")], "vocab_id long, line_no long, line string")
    assert files.required_vocabulary_facts(v.where("vocab_id = 1")).first()["blank_id"] == 2
    with pytest.raises(Exception, match="no blank token in vocabulary 2"):
        files.required_vocabulary_facts(v).collect()
    log = spark.createDataFrame([(1, 0, "Duration: 00:00:01.00"), (7, 0, "x")], "media_id long, ord long, line string")
    assert files.required_media_durations(log.where("media_id = 1")).first()["duration_ms"] == 1000
    with pytest.raises(Exception, match="no duration in the log of media 7"):
        files.required_media_durations(log).collect()


def test_settings_column(spark):
    rows = [('{"model": "m", "apiKey": null}',), ("oops",), (None,)]
    got = spark.createDataFrame(rows, "stored string").select(*(c.alias(n) for n, c in files.settings_of(F.col("stored")).items())).collect()
    assert [r.asDict() for r in got] == [files.DEFAULT_SETTINGS | {"model": "m"}, files.DEFAULT_SETTINGS, files.DEFAULT_SETTINGS]


def test_example_reply_is_a_reply():
    assert json.loads(models.example_reply()) == [models.EXAMPLE] and models.example_reply() in models.analysis_prompt("", None, False)


ROWS = [(1, 0, "00:01.000", "00:02.500", "A", "hi"), (1, 1, "01:00:03.000", "01:00:04.000", "B", "ho")]
KIND = "media_id long, seg_idx long, start string, end string, speaker string, text string"


def test_documents(spark, tmp_path):
    seg = spark.createDataFrame(ROWS, KIND)
    assert sinks.srt(seg).first()["content"] == "1\n00:00:01,000 --> 00:00:02,500\nA: hi\n\n2\n01:00:03,000 --> 01:00:04,000\nB: ho\n"
    assert sinks.vtt(seg).first()["content"] == "WEBVTT\n\n00:00:01.000 --> 00:00:02.500\n<v A>hi\n\n01:00:03.000 --> 01:00:04.000\n<v B>ho"
    assert sinks.txt(seg).first()["content"] == "[00:01.000 - 00:02.500] A: hi\n[01:00:03.000 - 01:00:04.000] B: ho"
    saved = json.loads(sinks.saved_transcript(seg, F.lit("c")).first()["content"])
    assert saved["context"] == "c" and [s["text"] for s in saved["segments"]] == ["hi", "ho"]
    graph = sinks.filter_graph(seg.select("media_id", "seg_idx", "start", "end").limit(1)).first()["graph"]
    assert graph == "[0:v]trim=start=00:01.000:end=00:02.500,setpts=PTS-STARTPTS[v0];[0:a]atrim=start=00:01.000:end=00:02.500,asetpts=PTS-STARTPTS[a0];[v0][a0]concat=n=1:v=1:a=1[v][a]"
    ranges = spark.createDataFrame([(1, 0, 0, 1500)], "media_id long, pos long, start_ms long, end_ms long")
    assert sinks.audio_filter_graph(ranges).first()["graph"] == "[0:a]atrim=start=0:end=1.5,asetpts=PTS-STARTPTS[a0];[a0]concat=n=1:v=0:a=1[outa]"
    sinks.write_documents(sinks.txt(seg), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out"), wholetext=True).first()["value"].startswith("[00:01.000")


def test_models(spark):
    seg = spark.createDataFrame([(1, i, "0", "1", "A", f"t{i}") for i in range(45)], KIND)
    got = models.translate(seg, "Spanish").orderBy("seg_idx").collect()
    assert [r["text"] for r in got] == [f"~ t{i}" for i in range(45)]
    short = models.translate(seg, "Spanish", client=lambda rows, prompt: json.dumps(rows[:-1])).where("text is null")
    assert sorted(r["seg_idx"] for r in short.collect()) == [19, 39, 44]
    with pytest.raises(Exception):
        models.translate(seg, "Spanish", client=lambda rows, prompt: '[{"text":"x"}]').collect()
    assert models.analyse(spark.range(2).withColumnRenamed("id", "media_id"), client=lambda m, p: None).count() == 0
    assert models.analyse(spark.range(2).withColumnRenamed("id", "media_id")).count() == 2
    prompt = models.analysis_prompt("Foo", 2, True)
    assert "Foo" in prompt and "2 speakers" in prompt and "filler" in prompt and "filler" not in models.analysis_prompt("", None, False)


def test_greedy_tokens():
    # ten tokens in a row go on one frame whatever their duration says
    assert models.greedy_tokens(lambda f, t: (5, 0), 3, 0) == [5, 5, 5]
    assert models.greedy_tokens(lambda f, t: (0, 9), 3, 0) == []
    assert models.greedy_tokens(lambda f, t: (f + 1, 2), 5, 0) == [1, 3, 5]
    seen = []
    models.greedy_tokens(lambda f, t: (seen.append(f), (1, 4))[1], 60, 0)
    assert seen[:12] == [0, 4, 8, 12, 16, 20, 24, 28, 32, 36, 37, 41]
    assert len(models.greedy_tokens(lambda f, t: (1, 1), 10**6, 0)) == 4096


def test_local_transcript(spark):
    got = models.local_transcript(spark.createDataFrame([(7, 500000)], "media_id long, n_samples long")).orderBy("seg_idx").collect()
    assert [(r["start_ms"], r["end_ms"], r["speaker"]) for r in got] == [(0, 30000, "Local"), (27000, 31250, "Local")]


def test_silence_stream(spark, tmp_path):
    lines = [(1, 0, "silence_start: 1"), (1, 1, "x"), (1, 2, "silence_end: 3"), (2, 3, "silence_end: 9"), (2, 4, "silence_start: 4")]
    more = [(2, 5, "silence_end: 5")]
    kind = "media_id long, ord long, line string"
    spark.createDataFrame(lines, kind).coalesce(1).write.parquet(str(tmp_path / "in/a"))
    source = spark.readStream.schema(kind).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = silence_stream(source).writeStream.format("memory").queryName("pairs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    spark.createDataFrame(more, kind).coalesce(1).write.parquet(str(tmp_path / "in/b"))
    q.processAllAvailable()
    q.stop()
    assert sorted((r["media_id"], r["start_ms"], r["end_ms"]) for r in spark.table("pairs").collect()) == [(1, 1000, 3000), (2, 4000, 5000)]
