"""Near duplicates, vectors and passages, against brute force."""

import hashlib

import numpy as np
import pytest

from reelspan.llm import hyperminhash as hm
from reelspan.llm.components import components
from reelspan.llm.embeddings import near_vectors, tables_for
from reelspan.llm.substrings import drop_repeats

from .conftest import brute_words


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_groups(rows, width, percent):
    sets = {}
    for i, text, *_ in rows:
        w = brute_words(lower(text))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80), (3, 60)])
def test_near_duplicates(docs, rows, width, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in hm.near_duplicates(docs, width, percent).collect()}
    assert got == brute_groups(rows, width, percent)


def test_large_groups_go_through_blocks(spark, monkeypatch):
    """Many copies with many different edits: some reach others only over others."""
    monkeypatch.setattr(hm, "SMALL", 3)
    monkeypatch.setattr(hm, "BLOCK", 7)
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.choice(60, rng.integers(0, 6), replace=False):
            w[k] = f"e{i}_{k}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in hm.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == brute_groups(rows, 3, 85)
    assert len({c for _, c, _ in got.values()}) > 3


def test_near_duplicates_edges(spark, nothing):
    assert hm.near_duplicates(nothing).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "other words here entirely, many"), (5, "a b c d e f"), (7, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["component_id"], r["kept"]) for r in hm.near_duplicates(df).collect()), key=str)
    assert (False, 5, 3, False) in got and (False, 7, 7, True) in got and (True, None, None, True) in got and len(got) == 5


def test_common_counts():
    rng = np.random.default_rng(0)
    a = [np.unique(rng.integers(0, 400, rng.integers(0, 90)).astype(np.uint64)) for _ in range(40)]
    b = [np.unique(rng.integers(0, 400, rng.integers(0, 90)).astype(np.uint64) ** 2) for _ in range(30)]
    assert hm._common(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


def test_estimates_are_close():
    rng = np.random.default_rng(1)
    sketcher = hm.Sketcher(*hm.bands_for(0.85))
    for share in (0.0, 0.5, 0.9):
        x = rng.integers(0, 2**63, 4000).astype(np.uint64)
        y = np.concatenate([x[: int(4000 * share)], rng.integers(0, 2**63, 4000 - int(4000 * share)).astype(np.uint64)])
        truth = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs(hm.estimate(sketcher.registers(x), sketcher.registers(y), 4000, 4000) - truth) < 0.12


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (200, 100), (300, 301), (300, 301)]
    df = spark.createDataFrame(edges + [(None, 5)], "u long, v long").repartition(7)
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys([100, 101, 102, 200], 100) | {300: 300, 301: 300}
    assert components(df.limit(0)).count() == 0


def brute_vectors(rows, cosine=0.98):
    ok = {}
    for k, (i, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[k] = np.array(v, np.float64)
    links = {k: [] for k in range(len(rows))}
    for a in ok:
        for b in ok:
            if a != b and rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= cosine:
                links[a].append(b)
    out = {}
    for k, (i, *_) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min(rows[j][0] for j in seen)
        out[i] = (len(links[k]), least, least == i)
    return out


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    rows, centre = [], rng.standard_normal((6, 16))
    for i in range(700):
        v = centre[rng.integers(6)] + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.25, 1.0])
        rows.append((i, v.astype(np.float32).tolist(), int(rng.integers(2))))
    rows += [(1000 + i, rows[3][1], 0) for i in range(5)] + [(2000, rows[3][1], None), (2001, None, 0), (2002, [0.0] * 16, 0), (2003, [float("nan")] * 16, 0), (2004, [], 0), (2005, [1.0, None], 0), (2006, [1.0, 2.0], 0), (2007, [2.0, 4.0], 0), (2008, [float("inf"), 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(6)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df).collect()}
    assert got == brute_vectors(rows)


def test_near_vectors_in_blocks(spark, monkeypatch):
    from reelspan.llm import embeddings

    monkeypatch.setattr(embeddings, "BLOCK", 8)
    rng = np.random.default_rng(5)
    rows = [(i, (np.ones(8) + rng.standard_normal(8) * 0.08).tolist(), 1) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    as_read = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df).collect()}
    assert got == brute_vectors(as_read)
    assert near_vectors(df.limit(0)).count() == 0


def test_tables_grow_slowly():
    assert tables_for(10**9, 0.98)[1] < 20 * tables_for(10**4, 0.98)[1]


def brute_repeats(rows, window=50):
    first, lists = {}, {i: brute_words(t) for i, t, *_ in rows}
    for i in sorted(lists):
        w = lists[i]
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, w in lists.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("parts", [1, 6])
def test_drop_repeats(docs, rows, parts):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in drop_repeats(docs.repartition(parts)).collect()}
    assert got == brute_repeats(rows)


def test_drop_repeats_edges(spark, docs, nothing):
    assert drop_repeats(nothing).count() == 0
    assert drop_repeats(docs).drop("n_words", "n_removed").schema.names == docs.columns
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(None, text), (4, text), (4, text), (9, text), (9, "y " + text)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in drop_repeats(df).collect())
    assert got == [(-1, 60, 0), (4, 60, 0), (4, 60, 0), (9, 60, 60), (9, 61, 60)]


def test_sketch_loses_no_repeat(spark):
    import pyarrow as pa

    from reelspan.llm.substrings import Windows, estimates, repeated_signs

    rng = np.random.default_rng(1)
    passage = " ".join(f"p{i}" for i in range(70))
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 100)) + " " + (passage if i % 2 else "") for i in range(40)]
    for parts in (1, 5):
        df = spark.createDataFrame([(i, 7, t) for i, t in enumerate(texts)], "id long, key long, text string").repartition(parts)
        got = {}
        for r in repeated_signs(df, 9, 4).collect():
            got.setdefault(r["id"], set()).update(np.frombuffer(r["found"], np.uint64).tolist())
        want = set(Windows(pa.array([passage]), 50, 8).sign.tolist())
        assert all(want <= got[i] for i in range(1, 40, 2))
        # besides, windows over the passage's edge may have a sign inside it
        assert sum(len(x - want) for x in got.values()) < 40 and not any(got.get(i) for i in range(0, 40, 2))
    signs, counts = rng.integers(0, 2**63, 5000).astype(np.uint64), rng.integers(1, 3, 5000)
    signs[:50] = signs[50:100]
    true = {s: counts[signs == s].sum() for s in signs}
    found = estimates(signs, counts)
    assert all(f >= true[s] for f, s in zip(found, signs)) and sum(f > true[s] for f, s in zip(found, signs)) < 200


def test_query_digest(spark, tmp_path, rows):
    from reelspan.llm.queries import op3_substrings

    spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, (_, _, t) in brute_repeats(rows).items()}
    assert {r["doc_id"]: r["kept_sha256"] for r in op3_substrings(spark, str(tmp_path)).collect()} == want
