"""Text, path, JSON and array functions."""

import base64

import pytest
from pyspark.sql import functions as F

from reelspan.functions import text as fx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# Cases that must come out as given.
@pytest.mark.parametrize("index, label, name", [(0, None, "clip_001.mp4"), (1, "My Clip", "clip_002_MyClip.mp4"), (2, "a/b\\c!", "clip_003_abc.mp4"), (999, "é_-x", "clip_1000_é_-x.mp4"), (3, "!?", "clip_004.mp4")])
def test_clip_filename(spark, index, label, name):
    assert one(spark, fx.clip_filename(F.lit(index), F.lit(label).cast("string"))) == name


@pytest.mark.parametrize("reply, found", [('ok [{"a":[1]}] end', '[{"a":[1]}]'), ("] [", None), ("none", None), ("[a\nb]", "[a\nb]")])
def test_bracketed(spark, reply, found):
    assert one(spark, fx.bracketed(F.lit(reply))) == found


def test_segments_of(spark):
    good = '[{"start":"1","end":"2","speaker":"A","text":"t"}]'
    lacking = '[{"start":"1","end":"2","speaker":"A"}]'
    assert len(one(spark, fx.segments_of(F.lit(good), strict=True))) == 1
    assert one(spark, fx.segments_of(F.lit(lacking), strict=True)) is None
    assert len(one(spark, fx.segments_of(F.lit(lacking)))) == 1
    assert one(spark, fx.segments_of(F.lit("[oops"))) is None


def test_saved_shapes(spark):
    rows = '[{"start":"1","end":"2","speaker":"A","text":"t"}]'
    assert len(one(spark, fx.saved_segments(F.lit("  " + rows)))) == 1
    both = '{"segments":' + rows + ',"context":"c"}'
    assert len(one(spark, fx.saved_segments(F.lit(both)))) == 1 and one(spark, fx.saved_context(F.lit(both))) == "c"
    assert one(spark, fx.saved_segments(F.lit('{"context":"c"}'))) is None
    assert one(spark, fx.saved_segments(F.lit("oops"))) is None


# Cases that must come out as given.
@pytest.mark.parametrize("values, index, value", [([0.1, 0.5, 0.2, 0.9, 0.3], 3, 0.9), ([1.0, 1.0], 0, 1.0), ([float("nan"), 2.0], 1, 2.0), ([], 0, float("-inf")), ([float("nan")], 0, float("-inf"))])
def test_argmax(spark, values, index, value):
    got = spark.createDataFrame([(values,)], "v array<double>").select(fx.argmax(F.col("v")).alias("x")).first()["x"]
    assert (got["index"], got["value"]) == (index, value)


@pytest.mark.parametrize("a, b, s", [("a b", "B a", 1.0), ("a b", "b c", 1 / 3), ("", " ", 1.0), ("a", "", 0.0)])
def test_jaccard(spark, a, b, s):
    assert one(spark, fx.word_jaccard(F.lit(a), F.lit(b))) == pytest.approx(s)


def test_words_of_tokens(spark):
    say = lambda *t: spark.createDataFrame([(list(t),)], "t array<string>").select(fx.words_of_tokens(F.col("t"))).first()[0]
    assert say(" hel", "lo", " wor", "<unk>", "ld", None, "<blk>") == "hello world"
    assert say("x", " y") == "x y" and say() == "" and say(" ", " ", "a") == "a"


def test_paths_and_urls(spark):
    assert one(spark, fx.cut_path(F.lit("/a.b/c.mp4"))) == "/a.b/c_cut.mp4"
    assert one(spark, fx.cut_path(F.lit("/a.b/c"))) == "/a.b/c_cut"
    assert one(spark, fx.clips_dir(F.lit("/x/y.tar.gz"))) == "/x/y.tar_clips"
    assert one(spark, fx.subtitle_path(F.lit("v.mp4"), F.lit("French"), "vtt")) == "v.French.vtt"
    assert one(spark, fx.subtitle_path(F.lit("v.mp4"), F.lit("Original"), "srt")) == "v.srt"
    assert one(spark, fx.is_media(F.lit("a.m4a"))) and not one(spark, fx.is_media(F.lit("a.txt")))
    assert one(spark, fx.normal_base_url(F.lit(" api.x// "))) == "https://api.x"
    assert one(spark, fx.normal_base_url(F.lit("http://y/"))) == "http://y"
    assert one(spark, fx.megabytes(F.lit(1572864))) == 1.5


def test_base64_has_no_line_breaks(spark):
    raw = bytes(range(200))
    assert spark.createDataFrame([(bytearray(raw),)], "b binary").select(fx.base64_of(F.col("b"))).first()[0] == base64.b64encode(raw).decode()


def test_model_names(spark):
    assert one(spark, fx.model_names(F.lit('{"models":[{"name":"models/a"},{"name":""},{}]}'), F.lit(True))) == ["a"]
    assert one(spark, fx.model_names(F.lit('{"data":[{"id":"b"}]}'), F.lit(False))) == ["b"]
    assert one(spark, fx.model_names(F.lit("oops"), F.lit(False))) == fx.FALLBACK_MODELS[False]


def test_audio_paths(spark):
    from reelspan.functions import text as fx
    from pyspark.sql import functions as F

    paths = ["/a.b/c.mp4", "/a.b/c", "/a/.hidden", "c.tar.gz", "/x/y."]
    got = [tuple(spark.range(1).select(f(F.lit(p))).first()[0] for f in (fx.audio_path, fx.nosilence_path)) for p in paths]
    assert [g[0] for g in got] == ["/a.b/c.ogg", "/a.b/c.ogg", "/a/.hidden.ogg", "c.tar.ogg", "/x/y.ogg"]
    assert [g[1] for g in got] == [g[0].removesuffix(".ogg") + "_nosilence.ogg" for g in got]


def test_features_first(spark):
    from pyspark.sql import functions as F
    from reelspan.operators.chunks import features_first

    df = spark.createDataFrame([([[1, 2, 3], [4, 5, 6]],), ([],), (None,), ([[]],)], "x array<array<int>>")
    assert [r[0] for r in df.select(features_first(F.col("x"))).collect()] == [[[1, 4], [2, 5], [3, 6]], [], None, []]
