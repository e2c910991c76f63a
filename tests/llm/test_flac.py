"""FLAC: round trips, every kind of subframe, verified checksums."""

import numpy as np
import pytest

from reelspan.llm import flac
from reelspan.llm.flac import crc8, crc16, decode_streams, encode_streams, from_flac, payload, samples_of, to_flac


def streams():
    rng = np.random.default_rng(3)
    return [
        np.array([5], np.int8), np.full(3000, -128, np.int8), rng.integers(-128, 128, 5000).astype(np.int8), (np.sin(np.arange(9000) / 9) * 100).astype(np.int8),
        np.array([0] * 2000 + [-128] + [0] * 2000, np.int8), samples_of(payload(b"")), samples_of(payload("é some text ".encode() * 300)),
    ]


@pytest.mark.parametrize("lpc", [False, True])
@pytest.mark.parametrize("block", [192, 1000, 1024])
def test_round_trip(lpc, block):
    data = streams()
    coded = encode_streams(data, block=block, lpc=lpc)
    for s, d in zip(data, decode_streams(coded)):
        assert (d["samples"][:, 0] == s).all() and d["samples"].shape == (len(s), 1)
        assert [n for _, n in d["blocks"]] == [min(block, len(s) - i) for i in range(0, len(s), block)]
        assert [a for a, _ in d["blocks"]] == list(range(0, len(s), block))


def test_sixteen_bits_and_no_seek_table():
    s = (np.cumsum(np.random.default_rng(1).integers(-40, 41, 4000))).astype(np.int16)
    (coded,) = encode_streams([s], bits=16)
    assert (decode_streams([coded])[0]["samples"][:, 0] == s).all()
    info, rest = coded[:42], coded[42:]
    size = int.from_bytes(rest[1:4], "big")
    bare = info[:4] + bytes([info[4] | 0x80]) + info[5:] + rest[4 + size :]
    assert (decode_streams([bare])[0]["samples"][:, 0] == s).all()


def test_stereo_and_partitions():
    """A frame written bit by bit: mid and side, two Rice partitions, one of them escaped, a wasted bit."""
    left, right = [10, 12, 14, 16], [8, 8, 10, 20]
    mid = [(a + b) >> 1 for a, b in zip(left, right)]
    side = [a - b for a, b in zip(left, right)]
    bits = ""
    put = lambda v, n: format(v & ((1 << n) - 1), f"0{n}b")
    fold = lambda v: 2 * v if v >= 0 else -2 * v - 1
    rice = lambda v, k: "0" * (fold(v) >> k) + "1" + (put(fold(v), k) if k else "")
    bits += "0" + put(8, 6) + "0" + "00" + put(1, 4) + put(2, 4) + rice(mid[0], 2) + rice(mid[1], 2) + put(15, 4) + put(6, 5) + put(mid[2], 6) + put(mid[3], 6)
    half = [v >> 1 for v in side]
    bits += "0" + put(1, 6) + "1" + "1" + "".join(put(v, 8) for v in half)
    bits += "0" * (-len(bits) % 8)
    head = bytes([0xFF, 0xF8, 0x60, 0xA2, 0x00, 3])
    frame = head + bytes([crc8(head)]) + int(bits, 2).to_bytes(len(bits) // 8, "big")
    whole = np.frombuffer(frame, np.uint8)
    frame += int(crc16(whole, np.array([0]), np.array([len(whole)]))[0]).to_bytes(2, "big")
    info = (4).to_bytes(2, "big") * 2 + bytes(6) + (16000 << 44 | 1 << 41 | 7 << 36 | 4).to_bytes(8, "big") + bytes(16)
    got = decode_streams([b"fLaC\x80\x00\x00\x22" + info + frame])[0]
    assert got["samples"].T.tolist() == [left, right]


def test_checksums_are_verified():
    (coded,) = encode_streams([streams()[3]])
    for at in (len(coded) - 1, len(coded) - 40, 60):
        broken = bytearray(coded)
        broken[at] ^= 4
        with pytest.raises((ValueError, KeyError, IndexError)):
            decode_streams([bytes(broken)])


def test_known_checksums():
    assert crc8(b"123456789") == 0xF4
    assert crc16(np.frombuffer(b"123456789", np.uint8), np.array([0, 3]), np.array([9, 3])).tolist() == [0xFEE8, 0]


def test_columns(docs, rows, nothing):
    got = {r["doc_id"]: r for r in from_flac(to_flac(docs)).collect()}
    for i, text, *_ in rows:
        raw = payload((text or "").encode())
        r = got[i]
        assert bytes(r["pcm"]) == raw and r["n_bytes"] == len((text or "").encode()) and r["n_samples"] == len(raw) and len(raw) % 64 == 0 and raw
        for b in r["blocks"]:
            assert b["offset"] == b["first_sample"]
    assert from_flac(to_flac(nothing)).count() == 0
    assert flac.payload(b"x" * 64) == b"x" * 64


def test_null_stream(spark):
    assert from_flac(spark.createDataFrame([(1, None)], "doc_id long, media binary")).first()["pcm"] is None


def test_long_streams_are_coded_in_stretches(monkeypatch):
    data = streams()
    whole = encode_streams(data, block=192)
    monkeypatch.setattr(flac, "STRETCH", 400)
    assert encode_streams(data, block=192) == whole
    with pytest.raises(ValueError):
        encode_streams([np.zeros(0, np.int8)])


def test_query_digest(spark, rows, tmp_path):
    """All columns of op8 from the texts alone, but for the streams, which are coded and read back here."""
    import hashlib
    import zlib

    from reelspan.llm.queries import op8_flac

    spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in op8_flac(spark, str(tmp_path)).collect()}
    assert sorted(got) == [r[0] for r in rows]
    for i, text, *_ in rows:
        raw, r = (text or "").encode(), got[i]
        full = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        x = [b - 128 for b in full]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        turns = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
        assert r["feature"] == f"peak={max(map(abs, x))} energy={sum(v * v for v in x)} crossings={turns} frames={-(-len(full) // flac.BLOCK)}"
        (media,) = encode_streams([np.array(x, np.int8)])
        assert decode_streams([media])[0]["pcm"] == full and (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
