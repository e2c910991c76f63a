"""Shards and mixes, checked by their laws and against plain versions."""

import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from reelspan.llm import mixing
from reelspan.llm.mixing import mix, source_targets
from reelspan.llm.sharding import byte_shards

from .conftest import brute_words


def test_shards(docs, rows):
    got = byte_shards(docs, 4).collect()
    assert sorted(r["doc_id"] for r in got) == [r[0] for r in rows]
    texts = {r[0]: r[1] for r in rows}
    of_text, slots, sizes = defaultdict(set), defaultdict(list), defaultdict(int)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        of_text[raw].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total, longest = sum(sizes.values()), max(len((t or "").encode()) for t in texts.values())
    assert all(abs(sizes[k] - total / 4) <= longest + total / 1024 for k in range(4))
    # copies of light texts share a shard
    assert all(len(s) == 1 for raw, s in of_text.items() if len(raw) * 5 < total / 1024)


def test_shards_of_many_copies_stay_balanced(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("some text "), "id")).alias("text"))
    got = byte_shards(df, 16).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    mean = sum(r["b"] for r in got) / 16
    assert len(got) == 16 and all(abs(r["b"] - mean) < 0.01 * mean + 40 and r["m"] == r["n"] - 1 for r in got)


def test_shards_edges(spark, nothing):
    assert byte_shards(nothing).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    assert sorted(r["slot"] for r in byte_shards(twice, 1).collect()) == [0, 1, 2]


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total, spill = sum(w[s] for s in open_), 0.0
        for s in list(open_):
            target[s] += left * w[s] / total
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                spill += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
        left = spill
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 5, "c": 300}, {"a": 1, "b": 1, "c": 1}, {"z": 7}, {"a": 0, "b": 90}])
def test_targets(spark, sizes):
    got = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    assert {r["source"]: pytest.approx(r["target"]) for r in got.collect()} == plain_targets(sizes)


def test_mix(docs, rows):
    got = mix(docs).collect()
    size = {r[0]: len(brute_words(r[1])) for r in rows}
    source = {r[0]: r[3] for r in rows}
    total = defaultdict(int)
    for i, s in source.items():
        total[s] += size[i]
    want, taken = plain_targets(dict(total)), defaultdict(int)
    assert sorted(r["doc_id"] for r in got) == sorted(size)
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[s]) and r["target"] == pytest.approx(want[s]) and 0 <= r["copies"] <= 3
        taken[s] += r["copies"] * r["size"]
    for s in total:  # whole copies only: half of the source's largest document may be left over
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + max(size[i] for i in size if source[i] == s) / 2 + 5
    again = {(r["doc_id"], r["copies"]) for r in mix(docs.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in got}


def test_tilts_meet_the_constraint_in_the_exponential_family(spark):
    cells = spark.createDataFrame([("a", s, 3) for s in (1, 5, 20, 200)] + [("b", s, 2) for s in (4, 9)], "source string, size long, n long")
    want = {"a": 1500.0, "b": 11.0}
    targets = spark.createDataFrame([("a", 678, want["a"]), ("b", 26, want["b"])], "source string, source_size long, target double")
    import math

    for r in mixing.tilts(cells, targets).collect():
        mine = [(c["size"], c["n"]) for c in cells.collect() if c["source"] == r["source"]]
        assert sum(n * s * min(3, math.exp(r["tilt"] * s / r["scale"])) for s, n in mine) == pytest.approx(want[r["source"]], rel=1e-7)


def test_mix_edges(spark, nothing):
    assert mix(nothing).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert {r["doc_id"]: (r["size"], r["target"], r["copies"]) for r in mix(blank).collect()} == {1: (0, 0.0, 1), 2: (0, 0.0, 1)}
    same = spark.createDataFrame([(i, "a b c", "s") for i in range(500)] + [(1, "a b c", "s")], "doc_id long, text string, source string")
    assert mix(same).agg(F.sum(F.col("copies") * F.col("size"))).first()[0] == 1503


@pytest.mark.parametrize("cells", [None, 8192])
def test_shards_against_a_plain_order(spark, cells):
    """Groups of one to three equal texts, none of them heavy: shards and slots are those of one sorted list."""
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.repeat(F.lit("ab"), (F.col("id") % 1700 % 3).cast("int")), F.col("id") % 1700).alias("text"))
    plain = [(r["h"] % 2**64, r["doc_id"], len(r["text"]) + 1) for r in df.select("*", F.xxhash64("text").alias("h")).collect()]
    total, groups = sum(s for *_, s in plain), defaultdict(list)
    for h, i, s in sorted(plain):
        groups[h].append((i, s))
    at, want, slots = 0, {}, defaultdict(int)
    for own in groups.values():
        weight = sum(s for _, s in own)
        shard = min(6, (2 * at + weight) * 7 // (2 * total))
        for i, _ in own:
            want[i] = (shard, slots[shard])
            slots[shard] += 1
        at += weight
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in byte_shards(df.repartition(3), 7, cells=cells).collect()} == want


def test_shard_query(spark, rows, tmp_path):
    from reelspan.llm.queries import op1_sharding

    spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r.asDict() for r in op1_sharding(spark, str(tmp_path)).collect()}
    for i, text, *_ in rows:
        raw = (text or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"], got[i]["law"], got[i]["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    slots = defaultdict(list)
    for r in got.values():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) and 0 <= k < 16 for k, s in slots.items())


def test_mix_query(spark, rows, tmp_path):
    from reelspan.llm.queries import op9_mixing

    spark.createDataFrame([(r[0], r[1], r[3]) for r in rows], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    size, source = {r[0]: len(brute_words(r[1])) for r in rows}, {r[0]: r[3] for r in rows}
    total, longest = defaultdict(int), defaultdict(int)
    for i, s in source.items():
        total[s] += size[i]
        longest[s] = max(longest[s], size[i])
    want, taken = plain_targets(dict(total)), defaultdict(int)
    for r in op9_mixing(spark, str(tmp_path)).collect():
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[s]) and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + longest[s] / 2 + 5 for s in total)


def test_mix_carries_columns_and_shares_among_equal_rows(spark):
    import corpus_pipeline as cp

    rows = [(1, "a b c", "en", "s", 5)] * 4 + [(1, "other words here", "en", "s", 16)] * 2 + [(None, "no id at all", None, "s", 12)] * 2 + [(7, "x y " * 30, "en", "t", 120)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    wanted = defaultdict(int)
    for r in mix(docs.withColumn("k", F.col("text")), carry=("k",)).collect():
        wanted[r["doc_id"], r["k"], r["source"]] += r["copies"]
    got = defaultdict(int)
    for r in cp.mixing_stage(spark, docs, "").collect():
        got[r["doc_id"], r["text"], r["source"]] += 1
    assert dict(got) == {k: n for k, n in wanted.items() if n}
