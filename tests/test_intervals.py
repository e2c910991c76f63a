"""Interval algebra against plain folds, and the cases that the driver's tables lack."""

import random

from pyspark.sql import functions as F

from reelspan.operators import intervals as iv


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_pairing(spark):
    lines = [
        "silence_end: 1", "silence_start: 2.5", "silence_start: 3", "noise", "silence_end: 4.25 | silence_duration: 1.25", "silence_end: 5", "silence_start: -1", "silence_end: 6", "silence_start: 7e1",
        "silence_end: 9", "silence_start: 10",
    ]
    log = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "media_id long, ord long, line string")
    # a negative start is not read, so its end has none; an exponent is cut to its mantissa
    assert rows(iv.silence_intervals(log), "start_ms", "end_ms", "duration_ms") == [(3000, 4250, 1250), (7000, 9000, 2000)]


def keep(spark, silences, duration):
    s = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(silences)], "media_id long, ord long, start_ms long, end_ms long")
    d = spark.createDataFrame([(1, duration)], "media_id long, duration_ms long")
    return iv.keep_ranges(s, d)


def test_keep_ranges(spark):
    assert rows(keep(spark, [(10, 20), (30, 40)], 50), "pos", "start_ms", "end_ms") == [(0, 0, 10), (1, 20, 30), (2, 40, 50)]
    # the end before counts, not the largest: a nested silence brings back what is after it
    assert rows(keep(spark, [(10, 90), (20, 30), (50, 60)], 100), "start_ms", "end_ms") == [(0, 10), (30, 50), (60, 100)]
    assert rows(keep(spark, [(0, 50)], 50), "pos") == []
    assert rows(keep(spark, [(0, 50)], None), "start_ms", "end_ms") == [(50, 3600050)]


def test_removal_of_nothing_and_of_all(spark):
    log = spark.createDataFrame([(1, 0, "silence_start: 0"), (1, 1, "silence_end: 60")], "media_id long, ord long, line string")
    media = spark.createDataFrame([(1, 60000), (2, 60000)], "media_id long, duration_ms long")
    assert rows(iv.silence_removal(log, media), "media_id", "min_time", "offset") == [(2, 0, 0)]


def test_remap_steps(spark):
    steps = spark.createDataFrame([(1, 0, 0), (1, 10000, 10000)], "media_id long, min_time long, offset long")
    seg = spark.createDataFrame([(1, 0, 5000, 9999), (1, 1, 10000, 12000), (1, 2, 0, 10000), (2, 0, 3, 4)], "media_id long, seg_idx long, start_ms long, end_ms long")
    assert rows(iv.remap(seg, steps), "media_id", "seg_idx", "new_start_ms", "new_end_ms") == [(1, 0, 5000, 9999), (1, 1, 20000, 22000), (1, 2, 0, 20000), (2, 0, 3, 4)]
    assert rows(iv.remap(seg, steps, end_exclusive=True).where("seg_idx = 2"), "new_end_ms") == [(10000,)]


def test_remaps_agree_with_a_fold(spark):
    rnd = random.Random(3)
    steps = [(m, t, rnd.randrange(-50, 50)) for m in range(4) for t in sorted(rnd.sample(range(100), 6))]
    points = [(m, i, rnd.randrange(-5, 110)) for m in range(5) for i in range(60)]

    def fold(m, t):
        out = 0
        for k, a, o in steps:
            if k == m and a <= t:
                out = o
        return t + out

    sd = spark.createDataFrame(steps, "media_id long, min_time long, offset long")
    pd = spark.createDataFrame(points, "media_id long, pid long, t long")
    want = sorted((m, i, fold(m, t)) for m, i, t in points)
    assert rows(iv.remap_by_window(pd, sd), "media_id", "pid", "new_t") == want
    seg = pd.select("media_id", F.col("pid").alias("seg_idx"), F.col("t").alias("start_ms"), F.col("t").alias("end_ms"))
    assert rows(iv.remap(seg, sd), "media_id", "seg_idx", "new_start_ms") == want


def test_locate(spark):
    seg = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 20, 20), (1, 2, 20, 30), (1, 3, 25, 130000)], "media_id long, seg_idx long, start_ms long, end_ms long")
    pts = spark.createDataFrame([(1, i, t) for i, t in enumerate([0, 10, 20, 27, 100000, 130000, 130001])] + [(9, 0, 5)], "media_id long, pid long, t long")
    got = rows(iv.locate(pts, seg).fillna(-1), "media_id", "pid", "seg_idx", "next_start", "stop")
    assert got == [(1, 0, 0, -1, False), (1, 1, -1, 20, False), (1, 2, 2, -1, False), (1, 3, 2, -1, False), (1, 4, 3, -1, False), (1, 5, -1, -1, False), (1, 6, -1, -1, True), (9, 0, -1, -1, False)]


def test_remap_against_a_plain_search(spark):
    rnd = random.Random(12)
    steps = [(m, t, rnd.randrange(1000)) for m in (1, 2) for t in sorted(rnd.sample(range(0, 5000, 10), 40))]
    seg = [(m, i, a, a + rnd.randrange(0, 300)) for m in (1, 2, 3) for i, a in enumerate(rnd.choices(range(0, 6000, 10), k=60))] + [(1, 60, None, 5), (1, 60, None, 5)]
    df = spark.createDataFrame([(*s, "x", 1, 2) for s in seg], "media_id long, seg_idx long, start_ms long, end_ms long, t string, offset long, kind int")
    for strict in (False, True):
        def at(m, t, before):
            past = [o for k, x, o in steps if k == m and (x < t if before else x <= t)] if t is not None else []
            return None if t is None else t + (past[-1] if past else 0)

        got = iv.remap(df, spark.createDataFrame(steps, "media_id long, min_time long, offset long"), strict)
        assert got.columns == [*df.columns, "new_start_ms", "new_end_ms"]
        key = lambda r: tuple(-1 if x is None else x for x in r)
        assert sorted([(r["media_id"], r["seg_idx"], r["start_ms"], r["new_start_ms"], r["new_end_ms"]) for r in got.collect()], key=key) == sorted([(m, i, a, at(m, a, False), at(m, b, strict)) for m, i, a, b in seg], key=key)


def test_a_false_end_is_an_error(spark):
    import pytest

    seg = spark.createDataFrame([(1, 0, 0, 10**15)], "media_id long, seg_idx long, start_ms long, end_ms long")
    with pytest.raises(Exception, match="segment too long in media 1"):
        iv.locate(spark.createDataFrame([(1, 0, 5)], "media_id long, pid long, t long"), seg).collect()
