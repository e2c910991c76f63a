"""Quality on held-out labels and against a plain model, license notices, and the whole pipeline."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspan.llm import licenses, quality
from reelspan.llm.licenses import NOTICES, Scanner, license_notices

from .conftest import brute_words

DATA = "/root/testdata/sf0.001"


def plain_model(texts):
    """Interpolated modified Kneser-Ney on byte trigrams with rare bytes as one symbol; log probability of (a, b, c)."""
    three = Counter()
    for t in texts:
        raw = b"\n\n" + t.encode()
        three.update(zip(raw, raw[1:], raw[2:]))
    single = Counter()
    for g, n in three.items():
        single[g[2]] += n
    common = {b for b, _ in sorted(single.items(), key=lambda x: (-x[1], x[0]))[:127]}
    name = lambda b: b if b in common else -1
    c3 = Counter()
    for g, n in three.items():
        c3[tuple(map(name, g))] += n
    c2 = Counter((b, c) for _, b, c in c3)
    c1 = Counter(c for _, c in c2)

    def discounts(counts):
        t = [sum(n == i for n in counts.values()) for i in range(1, 5)]
        y = t[0] / (t[0] + 2 * t[1]) if t[0] + 2 * t[1] else 0
        d = [1 - 2 * y * t[1] / t[0] if t[0] else 0, 2 - 3 * y * t[2] / t[1] if t[1] else 0, 3 - 4 * y * t[3] / t[2] if t[2] else 0]
        return [x if t[0] and 0 < x < i else i / 2 for i, x in enumerate(d, 1)]

    def layer(counts):
        d = discounts(counts)
        off = {g: min(d[min(n, 3) - 1], n) for g, n in counts.items()}
        total, free = defaultdict(float), defaultdict(float)
        for g, n in counts.items():
            total[g[:-1]] += n
            free[g[:-1]] += off[g]
        return off, total, free

    l3, l2, all1 = layer(c3), layer(c2), sum(c1.values())

    def logp(a, b, c):
        a, b, c = map(name, (a, b, c))
        p = (max(c1[c] - 0.5, 0) + 0.5 * len(c1) / 1 * 1 / 128) / all1 if c in c1 else 0.5 * len(c1) / all1 / 128
        for counts, (off, total, free), g in ((c2, l2, (b, c)), (c3, l3, (a, b, c))):
            if g[:-1] in total:
                p = (counts[g] - off.get(g, 0) + free[g[:-1]] * p) / total[g[:-1]]
        return math.log(p)

    return logp


def test_perplexities_of_a_plain_model(spark, docs, rows):
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] % 2], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    mine = {}
    for lang in ("en", "fr", ""):
        mine[lang] = plain_model([r[1] for r in rows if r[0] % 2 and r[1] and (r[2] == lang or lang == "")])
    for i, text, lang, *_ in rows:
        raw = b"\n\n" + (text or "").encode()
        if len(raw) == 2:
            assert got[i]["perplexity"] is None and got[i]["accepted"]
            continue
        logp = mine[lang or ""]
        want = math.exp(-sum(logp(*raw[k - 2 : k + 1]) for k in range(2, len(raw))) / (len(raw) - 2))
        assert got[i]["perplexity"] == pytest.approx(want, rel=1e-4)
        assert got[i]["accepted"] == (got[i]["perplexity"] <= got[i]["threshold"])


def test_quality_of_labelled_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA[:-5]}0.01/{t}.parquet") for t in ("documents", "labels"))
    # fitted on one half, judged on the other
    half = labels.where("doc_id % 2 = 0")
    done = quality.quality(docs, half).join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy("quality").agg(F.avg(F.col("accepted").cast("int")).alias("a")).collect()
    share = {r["quality"]: r["a"] for r in done}
    assert share[1] > 0.97 and share[0] < 0.4


def test_quality_edges(spark, docs, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality(docs, none).where("not accepted").count() == 0
    some = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (None, 1, None), (4, None, None)], "doc_id long, quality int, toxic int")
    assert quality.quality(nothing, some).count() == 0
    assert quality.accepted_documents(docs, some).columns == docs.columns


def test_accepted_documents_are_those_of_the_query(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    want = {r["doc_id"] for r in quality.quality(docs, labels).where("accepted").collect()}
    assert {r["doc_id"] for r in quality.accepted_documents(docs, labels).collect()} == want


ONE = 1 << 20


def plain_words(text):
    found = [w.strip(".,;:!?()[]{}<>\"'*#/-") for w in re.findall("[^ \t\n\x0b\f\r]+", text or "")]
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in found if w]


class PlainScan:
    """Edit distances in words of all notices to all spans of a text, by one table for all notices side by side."""

    def __init__(self):
        self.notices = [plain_words(t) for _, t in NOTICES]
        self.sizes = np.array([len(n) for n in self.notices])
        self.longest = self.sizes.max()
        self.equal = {w: np.array([[k < len(n) and n[k] == w for k in range(self.longest)] for n in self.notices]) for w in {x for n in self.notices for x in n}}

    def __call__(self, text):
        """(start, end, differing words, licenses that fit as well) of the notices, by the documented rule."""
        words, rows, step = plain_words(text), np.arange(len(self.sizes)), np.arange(self.longest + 1) * ONE
        none = np.zeros((len(self.sizes), self.longest), bool)
        key = np.broadcast_to(step, (len(self.sizes), self.longest + 1)).copy()
        spans = []
        for end, w in enumerate(words, 1):
            x = np.empty_like(key)
            x[:, 0] = -end
            x[:, 1:] = np.minimum(key[:, :-1] + ONE * ~self.equal.get(w, none), key[:, 1:] + ONE)
            key = np.minimum.accumulate(x - step, 1) + step
            at = key[rows, self.sizes]
            d = -(-at // ONE)
            spans += [(2 * int(d[i]) - len(self.notices[i]), int(d[i]), int(d[i] * ONE - at[i]), end, i) for i in np.flatnonzero(5 * d <= self.sizes).tolist()]
        out = []
        for worth, d, a, b, i in sorted(spans):
            if not any(a < y and x < b for x, y, *_ in out):
                out.append((a, b, d, {NOTICES[k][0] for v, e, x, y, k in spans if (v, e) == (worth, d) and x < b and a < y}))
        return sorted(out, key=lambda f: f[:2])


def test_notices_against_all_comparisons(spark):
    docs = spark.read.parquet(f"{DATA[:-5]}0.01/documents.parquet")
    got = {r["doc_id"]: [(n["license"], n["n_differences"]) for n in r["notices"]] for r in license_notices(docs).collect()}
    plain, n = PlainScan(), 0
    for r in docs.where("doc_id % 16 = 1 or lower(text) like '%licen%' or lower(text) like '%rights%'").collect():
        want = plain(r["text"])
        assert len(want) == len(got[r["doc_id"]]) and all(name in names and x == d for (name, x), (_, _, d, names) in zip(got[r["doc_id"]], want)), r["doc_id"]
        n += len(want)
    assert n > 20


def test_hidden_notices_against_all_comparisons():
    """Notices with edits, wrapped anywhere, inside other text, none of which need hold a telling word."""
    rnd, plain, s, n = random.Random(6), PlainScan(), Scanner(NOTICES), 0
    for _ in range(60):
        words = "the of and to in or as is for this that any be not with from by on all".split() + ["zebra", "house,", "(river)", "--"]
        text = [rnd.choice(words) for _ in range(rnd.randrange(60))]
        for _ in range(rnd.randrange(1, 4)):
            notice = rnd.choice(NOTICES)[1].split()
            for _ in range(rnd.randrange(0, 1 + len(notice) // 5)):
                k = rnd.randrange(len(notice))
                notice[k : k + 1] = rnd.choice([[], ["changed"], [notice[k], "more"]])
            text += [w.upper() if rnd.random() < 0.2 else w for w in notice] + [rnd.choice(words) for _ in range(rnd.randrange(30))]
        text = "".join(w + rnd.choice([" ", " ", " ", "\n", "\t", "\n\n"]) for w in text)
        lines = [k for k, line in enumerate(text.split("\n")) for _ in plain_words(line)]
        want, got = plain(text), s.scan(text)
        assert [(f[0], f[0] + f[1] - 1, f[5]) for f in got] == [(lines[a], lines[b - 1], d) for a, b, d, _ in want] and all(f[2] in w[3] for f, w in zip(got, want))
        n += len(got)
    assert n > 50


def test_license_query(spark, tmp_path):
    from reelspan.llm.queries import op6_licenses

    texts = [None, "", "x\n" + NOTICES[4][1] + "\n\n" + NOTICES[0][1], "nothing of that kind", NOTICES[0][1]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_notices"], r["licenses"], r["n_exact"], r["n_differences"], r["saved_bytes"] > 0) for r in op6_licenses(spark, str(tmp_path)).collect()}
    assert got == {0: (0, "", 0, 0, False), 1: (0, "", 0, 0, False), 2: (2, "Apache-2.0,MIT", 2, 0, True), 3: (0, "", 0, 0, False), 4: (1, "Apache-2.0", 1, 0, True)}


def test_changed_and_broken_notices(docs, nothing):
    s = Scanner(NOTICES)
    rnd = random.Random(1)
    for name, text in NOTICES:
        words = text.split()
        assert s.judge(text)[0] == name and s.judge(text)[3] == 0
        if len(words) > 12:
            k = rnd.randrange(len(words))
            changed = " ".join(words[:k] + ["changed"] + words[k + 1 :])
            tried = [(licenses.word_differences(licenses.wording(changed), licenses.wording(t)), n) for n, t in NOTICES]
            # a changed version number can be as near to another license
            assert s.judge(changed)[0] in {n for d, n in tried if d == min(tried)[0]} and s.judge(changed)[3] == min(tried)[0]
    broken = "Permission to use, copy, modify, and/or distribute this software for any purpose\nwith or without fee is hereby granted, provided that the above copyright notice\nand this permission notice appear in all copies."
    assert [(f[0], f[1], f[2], f[5]) for f in s.scan("x\n" + broken + "\ny")] == [(1, 3, "ISC", 0)]
    assert s.scan("a license for everything and nothing at all, says who") == [] and s.scan("") == []
    assert license_notices(nothing).count() == 0 and license_notices(docs).where("size(notices) > 0").count() == 1


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    counts = []
    for k, (_, stage) in enumerate(cp.STAGES):
        before, kept = kept, cp.keep(stage(spark, kept, DATA))
        counts.append(kept.count())
        if k < len(cp.STAGES) - 1:
            assert kept.columns == docs.columns
        if k == 2:  # nothing but words goes, and only repeated ones
            pairs = kept.select("doc_id", F.col("text").alias("after")).join(before, "doc_id").collect()
            assert len(pairs) == counts[1] and all(set(brute_words(p["after"])) <= set(brute_words(p["text"])) for p in pairs)
    assert docs.count() > counts[0] > counts[1] == counts[2]
    assert {"doc_id", "token_ids"} <= set(kept.columns) and counts[4] == counts[3]


def test_pipeline_takes_empty_and_odd_tables(spark, docs, nothing):
    import corpus_pipeline as cp

    for table in (nothing, docs):
        out = table
        for _, stage in cp.STAGES:
            out = cp.keep(stage(spark, out, DATA))
        assert out.count() <= 3 * table.count()


def test_pipeline_stages_against_plain_versions(spark):
    """Every stage on its own input: its decisions by brute force or by its law."""
    from tokenizers import Tokenizer

    import corpus_pipeline as cp
    from reelspan.llm.queries import tokenizer_file

    from .test_duplicates import brute_groups, brute_repeats
    from .test_sharding_mixing import plain_targets

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows_of = lambda df: sorted(((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect()), key=str)
    stages = dict(cp.STAGES)
    accepted = {r["doc_id"] for r in quality.quality(docs, spark.read.parquet(f"{DATA}/labels.parquet")).where("accepted").collect()}
    good = cp.keep(stages["quality"](spark, docs, DATA))
    assert rows_of(good) == [r for r in rows_of(docs) if r[0] in accepted]
    single = cp.keep(stages["near_duplicates"](spark, good, DATA))
    groups = brute_groups(rows_of(good), 5, 80)
    assert rows_of(single) == [r for r in rows_of(good) if groups[r[0]][2]]
    cut = cp.keep(stages["substrings"](spark, single, DATA))
    plain = brute_repeats(rows_of(single))
    assert rows_of(cut) == sorted(((i, plain[i][2], lang, source, len(plain[i][2])) for i, _, lang, source, _ in rows_of(single)), key=str)
    mixed = cp.keep(stages["mixing"](spark, cut, DATA))
    size = {r[0]: len(brute_words(r[1])) for r in rows_of(cut)}
    total, taken, longest, times = Counter(), Counter(), Counter(), Counter()
    for i, _, _, source, _ in rows_of(cut):
        total[source] += size[i]
        longest[source] = max(longest[source], size[i])
    for i, _, _, source, _ in rows_of(mixed):
        taken[source] += size[i]
        times[i] += 1
    assert set(rows_of(mixed)) <= set(rows_of(cut)) and max(times.values()) <= 3
    for source, target in plain_targets(dict(total)).items():
        assert abs(taken[source] - target) <= longest[source] / 2 + 1
    library, texts = Tokenizer.from_file(tokenizer_file()), {r[0]: r[1] for r in rows_of(cut)}
    got = stages["tokens"](spark, mixed, DATA).collect()
    assert len(got) == mixed.count()
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["token_ids"], r["n_tokens"]) == (ids, len(ids))
