"""Edits of a small transcript, against lists edited in Python."""

import pytest

from reelspan.operators import chunks, clips, editing

SCHEMA = "media_id long, seg_idx long, start_ms long, end_ms long, speaker string, text string"
ROWS = [(1, i, 10 * i, 10 * i + 5, "AB"[i % 2], f"t{i}") for i in range(5)]


@pytest.fixture
def seg(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def pick(spark, *indices):
    return spark.createDataFrame([(1, i) for i in indices], "media_id long, seg_idx long")


def test_delete(spark, seg):
    assert [(r[1], r[5]) for r in rows(editing.delete_segments(seg, pick(spark, 1, 3, 99)).select(*seg.columns))] == [(0, "t0"), (1, "t2"), (2, "t4")]


def test_merge_down(seg):
    assert [(r[1], r[2], r[3], r[4], r[5]) for r in rows(editing.merge_down(seg, 1))] == [(0, 0, 5, "A", "t0"), (1, 10, 25, "B", "t1 t2"), (2, 30, 35, "B", "t3"), (3, 40, 45, "A", "t4")]
    assert rows(editing.merge_down(seg, 4)) == ROWS


def test_merge_selected(spark, seg):
    assert [(r[1], r[2], r[3], r[5]) for r in rows(editing.merge_selected(seg, pick(spark, 0, 2, 4)))] == [(0, 0, 45, "t0 t2 t4"), (1, 10, 15, "t1"), (2, 30, 35, "t3")]
    assert rows(editing.merge_selected(seg, pick(spark, 3))) == ROWS


def test_rename(seg):
    assert {r[4] for r in rows(editing.rename_speaker(seg, "A", " C "))} == {"B", "C"}
    assert rows(editing.rename_speaker(seg, "A", "  ")) == ROWS
    assert editing.merges_speakers(seg, " B ").count() == 1 and editing.merges_speakers(seg, "Z").count() == 0


def test_edit(spark, seg):
    new = spark.createDataFrame([(1, 2, 1, 2, "X", None), (1, 77, 0, 0, "Y", "y")], SCHEMA)
    got = rows(editing.save_edits(seg, new).where("seg_idx = 2"))
    assert got == [(1, 2, 1, 2, "X", None)] and editing.save_edits(seg, new).count() == 5


def test_language_view_falls_back_by_media(spark, seg):
    both = seg.unionByName(spark.createDataFrame([(2, 0, 0, 1, "A", "o")], SCHEMA))
    tr = spark.createDataFrame([(1, 0, 0, 5, "A", "hola", "Spanish")], SCHEMA + ", language string")
    assert sorted(r[5] for r in rows(editing.language_view(both, tr, "Spanish"))) == ["hola", "o"]
    assert editing.language_view(both, tr, "Original").count() == 6
    assert editing.untranslated(both, tr, "Spanish").count() == 1


def test_chunks_and_windows(spark):
    many = spark.createDataFrame([("a", i) for i in range(41)], "k string, i long")
    assert chunks.chunked(many, "k", "i").groupBy("chunk").count().orderBy("chunk").collect()[-1]["count"] == 1

    def fold(n):
        out, pos = [], 0
        while pos < n:
            end = min(pos + 480000, n)
            out.append((pos, end))
            if end == n:
                break
            pos += 432000
        return out

    for n in (0, 1, 480000, 480001, 912000, 912001, 5000000):
        got = chunks.sample_windows(spark.createDataFrame([(n,)], "n_samples long")).orderBy("window")
        assert [(r["start_sample"], r["end_sample"]) for r in got.collect()] == fold(n)
    mono = chunks.downmix(spark.createDataFrame([([1.0, 3.0, 5.0, 7.0, 9.0], 2), ([], 2)], "samples array<double>, channels int"))
    assert [r["mono"] for r in mono.collect()] == [[2.0, 6.0], []]


def test_clips(spark):
    kind = "media_id long, clip_idx long, title string, reason string, segments array<struct<start:string,end:string>>, start string, end string"
    c = spark.createDataFrame([(1, 0, "A b", None, None, "00:00", "00:15"), (1, 1, None, "r", [("0:10", "0:20"), ("1:00", "1:10")], None, None), (1, 2, "x", "r", [], None, None)], kind)
    plan = {r["clip_idx"]: r for r in clips.export_plan(clips.normalised(c)).collect()}
    assert [plan[i]["mode"] for i in range(3)] == ["single", "concat", "concat"]
    assert plan[0]["filename"] == "clip_001_Ab.mp4" and '"segments":[{"start":"00:00","end":"00:15"}]' in plan[0]["metadata"]
    assert [(r["clip_idx"], r["length_ms"]) for r in clips.best_clips(clips.normalised(c), 1).collect()] == [(0, 15000)]
