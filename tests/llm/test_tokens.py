"""BPE against the tokenizers library, and files of token ids read back whole and by place."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from reelspan.llm.batches import buffer
from reelspan.llm.bpe import PATTERN, Encoder, Model, bpe_decode, bpe_encode, cut_places
from reelspan.llm.queries import op5_token_file, op7_bpe, tokenizer_file
from reelspan.llm.tokenfile import Dac, dac_bytes, library_encoder, read_token_file, write_token_file


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


@pytest.fixture(scope="module")
def own():
    return Encoder(Model(tokenizer_file()).encode_pieces)


def ids_of(own, text):
    return np.frombuffer(own([text])[0], "<u4").tolist()


def test_same_ids_as_the_library(own, library):
    rnd = random.Random(2)
    letters = " \t\n\r  ab'scdz1,é  \x1c\x85!漢🙂"
    cases = ["", " ", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endof", "x" * 5000, "I'll 'twas don't", "ab " * 300, "a  \n b "]
    cases += ["".join(rnd.choice(letters) for _ in range(rnd.randrange(50))) for _ in range(3000)]
    want = [e.ids for e in library.encode_batch(cases, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own(cases)] == want


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_any_text(text):
    from tokenizers import Tokenizer

    global _pair
    try:
        _pair
    except NameError:
        _pair = (Encoder(Model(tokenizer_file()).encode_pieces), Tokenizer.from_file(tokenizer_file()))
    assert ids_of(_pair[0], text) == _pair[1].encode(text, add_special_tokens=False).ids
    assert np.frombuffer(library_encoder(tokenizer_file())([text])[0], "<u4").tolist() == ids_of(_pair[0], text)


def test_cuts_are_cuts_of_the_split_pattern():
    rnd = random.Random(8)
    letters = " \t\n\n  ab'scdz1,é.-|>  \x1c\x85\u2003\u3000\xa0!漢🙂"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(4000)] + [None, ""]
    data, offsets = buffer(pa.array(texts))
    cuts = set(cut_places(data, offsets).tolist())
    assert set(offsets[:-1][offsets[:-1] < offsets[1:]].tolist()) <= cuts and len(cuts) > 8000
    safe, at = set(), 0
    for t in texts:
        for word in regex.findall(PATTERN, t or ""):
            safe.add(at)
            at += len(word.encode())
    assert cuts <= safe


def test_long_words(own, library):
    rnd = random.Random(3)
    for n in (65, 500, 3000, 30000):
        words = ["".join(rnd.choice("abcdefgh") for _ in range(n)), "ab" * (n // 2), "x" * n]
        assert [ids_of(own, w) for w in words] == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]


def test_memory_is_bounded(library):
    small = Encoder(Model(tokenizer_file()).encode_pieces, limit=10)
    texts = [f"word{i} other{i} third{i}" for i in range(50)]
    assert [np.frombuffer(x, "<u4").tolist() for t in texts for x in small([t])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert len(small.known) <= 10


def test_encode_and_decode(docs, rows, library):
    got = {r["doc_id"]: r for r in bpe_decode(bpe_encode(docs, tokenizer_file()), tokenizer_file()).collect()}
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i]["token_ids"] == ids and got[i]["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_decoding_broken_bytes(spark, library):
    ids = [[i] for i in range(0, 600)] + [[], [50256, 171, 255]]
    df = spark.createDataFrame([(k, i) for k, i in enumerate(ids)] + [(9999, None)], "doc_id long, token_ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in bpe_decode(df, tokenizer_file()).collect()}
    assert [got[k] for k in range(len(ids))] == [library.decode(i, skip_special_tokens=False) for i in ids] and got[9999] == ""


def test_empty_table(nothing):
    assert bpe_decode(bpe_encode(nothing, tokenizer_file()), tokenizer_file()).count() == 0


@pytest.mark.parametrize("n, top", [(0, 1), (1, 2), (511, 300), (512, 70000), (5000, 256), (5000, 50257), (3000, 2**32)])
def test_random_access(n, top):
    ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    dac = Dac(dac_bytes(ids))
    assert dac.range(0, n).tolist() == ids.tolist()
    rnd = random.Random(n)
    for _ in range(200 if n else 0):
        i, j = sorted((rnd.randrange(n), rnd.randrange(n)))
        assert dac[i] == ids[i] and dac.range(i, j).tolist() == ids[i:j].tolist()
    with pytest.raises(IndexError):
        dac[n]


def test_token_file(spark, docs, rows, library, tmp_path):
    write_token_file(docs, str(tmp_path / "f"), tokenizer_file())
    got = {r["doc_id"]: r for r in read_token_file(spark, str(tmp_path / "f")).collect()}
    start = 0
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        assert (got[i]["start"], got[i]["n_tokens"]) == (start, len(ids)) and np.frombuffer(got[i]["ids"], "<u4").tolist() == ids
        start += len(ids)


def test_null_and_repeated_ids(spark, library, tmp_path):
    rows = [(None, "no id"), (4, "b"), (None, ""), (4, "b"), (2, None), (9, "a b c " * 70000)]
    write_token_file(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), str(tmp_path / "f"), tokenizer_file())
    got = read_token_file(spark, str(tmp_path / "f")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 2, 4, 4, 9] and [r["n_tokens"] for r in got[2:]] == [1, 2, 2, len(library.encode("a b c " * 70000).ids) + 1]
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(6)]


def test_token_file_queries(spark, rows, library, tmp_path):
    """The digests of op5 and op7 against the library alone."""
    spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t, *_ in rows}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {i: (len(x), sha(",".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for i, x in ids.items()}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op7_bpe(spark, str(tmp_path)).collect()} == want
    start, files = 0, {}
    for i in sorted(ids):
        files[i] = (start, len(ids[i]) + 1, zlib.crc32(np.array([*ids[i], 0], "<u4").tobytes()))
        start += len(ids[i]) + 1
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in op5_token_file(spark, str(tmp_path)).collect()} == files


def test_token_file_of_nothing(spark, nothing, tmp_path):
    write_token_file(nothing, str(tmp_path / "f"), tokenizer_file())
    assert read_token_file(spark, str(tmp_path / "f")).count() == 0
