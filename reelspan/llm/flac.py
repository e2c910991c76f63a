"""Lossless audio in FLAC streams: an encoder, and a decoder to PCM blocks with seekable sample offsets.

Many frames are worked on side by side: position i of every frame is handled in one step of array operations, so that the
serial parts of the format (unary runs, prediction from decoded samples, checksums) cost one step per sample of the longest
frame and not one per sample of the input. The decoder finds the frames of a stream in its seek table, which the encoder fills
with a point for every frame; without a full table it walks the stream frame after frame.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import buffer, mapped, slices

BLOCK = 1024
#: Samples that are coded side by side.
STRETCH = 1 << 20
RATE = 16000
#: Coefficients of the format's fixed predictors, by order, latest sample first.
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}
#: Block size and sample size codes of a frame header that need no further bytes.
BLOCK_CODES = {1: 192} | {k: 576 << (k - 2) for k in range(2, 6)} | {k: 256 << (k - 8) for k in range(8, 16)}
BITS_CODES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def _crc_table(polynomial: int, width: int) -> np.ndarray:
    out = []
    for byte in range(256):
        r = byte << (width - 8)
        for _ in range(8):
            r = (r << 1 ^ polynomial if r >> (width - 1) else r << 1) & ((1 << width) - 1)
        out.append(r)
    return np.array(out, np.uint32)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    r = 0
    for b in data:
        r = int(_CRC8[r ^ b])
    return r


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each span of bytes."""
    order = np.argsort(starts - ends, kind="stable")  # longest first: the spans still open are a prefix
    at, sizes = starts[order], (ends - starts)[order]
    r = np.zeros(len(at), np.uint32)
    n = len(at)
    for i in range(int(sizes[0]) if n else 0):
        while sizes[n - 1] <= i:
            n -= 1
        x = r[:n]
        r[:n] = (x << np.uint32(8) & np.uint32(0xFFFF)) ^ _CRC16[x >> np.uint32(8) ^ data[at[:n] + i]]
    out = np.empty_like(r)
    out[order] = r
    return out


def _utf8(n: int) -> bytes:
    """A frame number coded as UTF-8 codes a character, up to 36 bits."""
    if n < 128:
        return bytes([n])
    tail = []
    limit = 64
    while True:
        tail.append(128 | n & 63)
        n >>= 6
        limit >>= 1
        if n < limit:
            lead = (0xFF00 >> (len(tail) + 1)) & 0xFF
            return bytes([lead | n, *reversed(tail)])


def _frame_header(number: int, size: int, bits_code: int, fixed: int) -> bytes:
    head = bytes([0xFF, 0xF8, 0x70 if size != fixed or size not in BLOCK_CODES.values() else [k for k, v in BLOCK_CODES.items() if v == size][0] << 4, bits_code << 1]) + _utf8(number)
    if head[2] == 0x70:
        head += (size - 1).to_bytes(2, "big")
    return head + bytes([crc8(head)])


def _pack(values: np.ndarray, lengths: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of up to 32 bits written one after another, every row from a byte of its own; bytes and each row's start."""
    bits = np.zeros(n_rows, np.int64)
    np.add.at(bits, rows, lengths)
    size = (bits + 7) // 8
    start = np.cumsum(size) - size
    ends = np.cumsum(lengths)
    first = np.zeros(n_rows, np.int64)
    heads = np.flatnonzero(np.diff(rows, prepend=-1))
    first[rows[heads]] = (ends - lengths)[heads]
    at = ends - lengths - first[rows] + 8 * start[rows]
    word, off = at >> 5, at & 31
    wide = values.astype(np.uint64) << (np.uint64(64) - (off + lengths).astype(np.uint64))
    total = int(size.sum())
    words = np.zeros(total // 4 + 3, np.uint32)
    change = np.flatnonzero(np.diff(word, prepend=-1))
    where = word[change]
    # numbers never overlap, so sums of those that begin in a word are their union
    words[where] |= np.add.reduceat(wide >> np.uint64(32), change).astype(np.uint32)
    words[where + 1] |= (np.add.reduceat(wide & np.uint64(0xFFFFFFFF), change)).astype(np.uint32)
    return words.astype(">u4").view(np.uint8)[:total], start


def _coded_frames(streams: list[np.ndarray], numbers: np.ndarray, bits: int, block: int, lpc: bool) -> list[list[bytes]]:
    """The frames of stretches of streams, with their checksums; ``numbers`` are the first frames' places in their streams."""
    bits_code = {v: k for k, v in BITS_CODES.items()}[bits]
    counts = [-(-len(s) // block) for s in streams]
    owner = np.repeat(np.arange(len(streams)), counts)
    sizes = np.concatenate([np.minimum(block, np.maximum(0, len(s) - block * np.arange(c))) for s, c in zip(streams, counts)]).astype(np.int64)
    n = len(sizes)
    flat = np.concatenate(streams).astype(np.int32)
    begin = np.cumsum(sizes) - sizes
    inside = np.arange(block)[None, :] < sizes[:, None]
    x = np.zeros((n, block), np.int32)
    x[inside] = flat
    diffs = [x]
    for _ in range(2):
        d = diffs[-1].copy()
        d[:, 1:] -= diffs[-1][:, :-1]
        diffs.append(d)
    order = np.zeros(n, np.int64)
    best = (np.abs(x) * inside).sum(1)
    for k in (1, 2):
        cost = (np.abs(diffs[k]) * inside)[:, k:].sum(1) + (np.abs(x[:, :k]) * inside[:, :k]).sum(1)
        order = np.where((cost < best) & (sizes > k), k, order)
        best = np.minimum(best, np.where(sizes > k, cost, best))
    residual = np.choose(order[:, None], diffs)
    shift, coefficients = 5, np.zeros((n, 2), np.int64)
    if lpc:
        w = x.astype(np.float64) * inside
        r0, r1, r2 = (w * w).sum(1) + 1e-9, (w[:, 1:] * w[:, :-1]).sum(1), (w[:, 2:] * w[:, :-2]).sum(1)
        det = r0 * r0 - r1 * r1 + 1e-9
        coefficients = np.clip(np.rint(np.stack([r1 * (r0 - r2), r0 * r2 - r1 * r1], 1) / det[:, None] * (1 << shift)), -64, 63).astype(np.int64)
        order = np.where(sizes > 2, 2, 0)
        guess = (coefficients[:, :1] * x[:, 1:-1] + coefficients[:, 1:] * x[:, :-2]) >> shift
        residual = x.copy()
        residual[:, 2:] = np.where(sizes[:, None] > 2, x[:, 2:] - guess, x[:, 2:])
    coded = inside & (np.arange(block)[None, :] >= order[:, None])
    folded = np.where(residual < 0, -2 * residual.astype(np.int64) - 1, 2 * residual.astype(np.int64)) * coded
    n_coded = np.maximum(1, coded.sum(1))
    mean = folded.sum(1) / n_coded
    k = np.clip(np.floor(np.log2(np.maximum(mean, 1))), 0, 14).astype(np.int64)
    most = folded.max(1)
    for _ in range(15):  # a code may take 32 bits at most
        k = np.where((most >> k) + 1 + k > 32, k + 1, k)
    use_lpc = lpc & (sizes > 2)
    n_bits = ((folded >> k[:, None]) * coded).sum(1) + n_coded * (1 + k) + order * bits + 18 + 8 + use_lpc * (9 + 14)
    constant = (x == x[:, :1]).all(1, where=inside)
    verbatim = ~constant & ((n_bits >= sizes * bits) | (k > 14) | ((most >> np.minimum(k, 60)) + 1 + k > 32))
    plain = constant | verbatim
    order = np.where(plain, 0, order)
    use_lpc &= ~plain
    kind = np.where(constant, 0, np.where(verbatim, 1, np.where(use_lpc, 32 + order - 1, 8 + order)))
    mask = (1 << bits) - 1
    # every frame: subframe type, warm-up, predictor, Rice parameter, then one number for each residual
    lead_v = np.zeros((n, 10), np.int64)
    lead_l = np.zeros((n, 10), np.int64)
    lead_v[:, 0], lead_l[:, 0] = kind << 1, 8
    for j in range(2):
        lead_v[:, 1 + j], lead_l[:, 1 + j] = np.where(order > j, x[:, j] & mask, 0), np.where(order > j, bits, 0)
    for j, (v, w) in enumerate([(7 - 1, 4), (shift, 5), (coefficients[:, 0] & 127, 7), (coefficients[:, 1] & 127, 7)]):
        lead_v[:, 3 + j], lead_l[:, 3 + j] = np.where(use_lpc, v, 0), np.where(use_lpc, w, 0)
    lead_l[:, 7], lead_v[:, 8], lead_l[:, 8] = np.where(plain, 0, 6), np.where(plain, 0, k), np.where(plain, 0, 4)
    lead_v[:, 9], lead_l[:, 9] = np.where(constant, x[:, 0] & mask, 0), np.where(constant, bits, 0)
    q = folded >> k[:, None]
    body_v = np.where(verbatim[:, None], x & mask, (1 << k[:, None]) | (folded & ((1 << k[:, None]) - 1)))
    body_l = np.where(verbatim[:, None], bits, q + 1 + k[:, None])
    body_l = np.where(constant[:, None] | ~np.where(verbatim[:, None], inside, inside & (np.arange(block)[None, :] >= order[:, None])), 0, body_l)
    values, lengths = np.concatenate([lead_v, body_v], 1), np.concatenate([lead_l, body_l], 1)
    used = lengths > 0
    packed, start = _pack(values[used], lengths[used], np.nonzero(used)[0], n)
    stop = np.append(start[1:], len(packed))
    headers = []
    number = np.arange(n) - (np.cumsum(counts) - counts - numbers)[owner]
    cache: dict[tuple[int, int], bytes] = {}
    for i, size in zip(number.tolist(), sizes.tolist()):
        if (i, size) not in cache:
            cache[i, size] = _frame_header(i, size, bits_code, block)
        headers.append(cache[i, size])
    raw = packed.tobytes()
    frames = [h + raw[a:b] for h, a, b in zip(headers, start.tolist(), stop.tolist())]
    lens = np.fromiter(map(len, frames), np.int64, n)
    joined = np.frombuffer(b"".join(frames), np.uint8)
    ends = np.cumsum(lens)
    checks = crc16(joined, ends - lens, ends)
    checked = [f + int(v).to_bytes(2, "big") for f, v in zip(frames, checks.tolist())]
    return [checked[b - c : b] for c, b in zip(counts, np.cumsum(counts).tolist())]


def encode_streams(streams: list[np.ndarray], bits: int = 8, block: int = BLOCK, lpc: bool = False) -> list[bytes]:
    """One FLAC stream (one channel) for each array of signed samples of up to 16 bits.

    A frame takes the fixed predictor of order 0 to 2 with the least sum of residuals, or with ``lpc`` a quantised linear
    predictor of order 2, and one Rice parameter; a frame that this would not shorten is stored verbatim, a constant one as one
    sample. Long streams are worked through in stretches of ``STRETCH`` samples, so memory does not grow with them.
    """
    if not all(len(s) for s in streams):
        raise ValueError("a stream needs samples")
    stretch = max(1, STRETCH // block) * block
    todo = [(k, a) for k, s in enumerate(streams) for a in range(0, len(s), stretch)]
    coded: list[list[bytes]] = [[] for _ in streams]
    while todo:
        upto = np.cumsum([min(stretch, len(streams[k]) - a) for k, a in todo[: STRETCH // block + 1]])
        some = todo[: max(1, int(np.searchsorted(upto, stretch, "right")))]
        todo = todo[len(some) :]
        for (k, _), own in zip(some, _coded_frames([streams[k][a : a + stretch] for k, a in some], np.array([a // block for _, a in some]), bits, block, lpc)):
            coded[k] += own
    out = []
    for s, own in zip(streams, coded):
        own_sizes = list(map(len, own))
        sizes = np.minimum(block, len(s) - block * np.arange(len(own)))
        width = (bits + 7) // 8
        digest = hashlib.md5(np.ascontiguousarray(s, f"<i{width}").tobytes(), usedforsecurity=False).digest()
        info = block.to_bytes(2, "big") * 2 + min(own_sizes).to_bytes(3, "big") + max(own_sizes).to_bytes(3, "big")
        info += (RATE << 44 | (bits - 1) << 36 | len(s)).to_bytes(8, "big") + digest
        points = b"".join(
            (block * i).to_bytes(8, "big") + off.to_bytes(8, "big") + size.to_bytes(2, "big")
            for i, (off, size) in enumerate(zip((np.cumsum(own_sizes) - own_sizes).tolist(), sizes.tolist()))
        )
        out.append(b"fLaC\x00\x00\x00\x22" + info + b"\x83" + len(points).to_bytes(3, "big") + points + b"".join(own))
    return out


class _Bits:
    """A bit reader for every frame, side by side."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        # the 64 bits from every byte on
        self.window = np.zeros(len(data) + 8, np.uint64)
        for i in range(8):
            self.window |= padded[i : i + len(data) + 8].astype(np.uint64) << np.uint64(56 - 8 * i)
        self.at = at * 8

    def peek(self, who: np.ndarray) -> np.ndarray:
        """At least 57 bits, at the top."""
        at = self.at[who]
        return self.window[at >> 3] << (at & 7).astype(np.uint64)

    def take(self, who: np.ndarray, n) -> np.ndarray:
        n = np.broadcast_to(np.asarray(n, np.int64), who.shape)
        v = np.where(n > 0, self.peek(who) >> (np.uint64(64) - np.maximum(n, 1).astype(np.uint64)), np.uint64(0))
        self.at[who] += n
        return v.astype(np.int64)

    def signed(self, who: np.ndarray, n) -> np.ndarray:
        v = self.take(who, n)
        n = np.asarray(n, np.int64)
        return np.where(v >> np.maximum(n - 1, 0) & 1, v - (1 << n), v)

    def rice(self, who: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Rice-coded signed numbers with the parameters ``k`` (at most 14, else read the slow way)."""
        top = self.peek(who)
        high = top >> np.uint64(32)
        if (high == 0).any() or k.max(initial=0) > 14:
            q = self.unary(who)
            v = q << k | self.take(who, k)
        else:
            q = 32 - np.frexp(high.astype(np.float64))[1].astype(np.int64)
            # two shifts to the right, since k can be 0 and a shift by 64 is undefined
            low = (top << (q + 1).astype(np.uint64)) >> np.uint64(1) >> (63 - k).astype(np.uint64)
            v = q << k | low.astype(np.int64)
            self.at[who] += q + 1 + k
        return v >> 1 ^ -(v & 1)

    def unary(self, who: np.ndarray) -> np.ndarray:
        """Zeros before the next one, which is read too."""
        total = np.zeros(len(who), np.int64)
        left = np.arange(len(who))
        while len(left):
            top = self.peek(who[left]) >> np.uint64(32)  # the next 32 bits
            some = top > 0
            zeros = np.where(some, 31 - np.frexp(np.maximum(top, 1).astype(np.float64))[1] + 1, 32)
            total[left] += zeros
            self.at[who[left]] += zeros + some
            left = left[~some]
        return total


def _subframes(bits: _Bits, sizes: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """One channel's samples of every frame, as rows."""
    n, width = len(sizes), int(sizes.max())
    out = np.zeros((width, n), np.int64)  # sample by sample: a step writes one row
    every = np.arange(n)
    head = bits.take(every, 8)
    if (head >> 7).any():
        raise ValueError("a subframe does not begin with 0")
    kind = head >> 1 & 63
    wasted = np.zeros(n, np.int64)
    some = every[head & 1 == 1]
    if len(some):
        wasted[some] = bits.unary(some) + 1
    depth = depth - wasted
    constant, verbatim = kind == 0, kind == 1
    order = np.where((kind >= 8) & (kind <= 12), kind - 8, np.where(kind >= 32, kind - 31, 0))
    if (~(constant | verbatim | ((kind >= 8) & (kind <= 12)) | (kind >= 32))).any():
        raise ValueError("a subframe of a reserved type")
    who = every[constant]
    out[:, who] = bits.signed(who, depth[who])
    for i in range(int(order.max(initial=0))):
        who = every[order > i]
        out[i, who] = bits.signed(who, depth[who])
    most = int(order.max(initial=0))
    coefficients, shift = np.zeros((most, n), np.int64), np.zeros(n, np.int64)
    linear = every[kind >= 32]
    if len(linear):
        precision = bits.take(linear, 4) + 1
        shift[linear] = bits.signed(linear, np.full(len(linear), 5))
        for i in range(int(order[linear].max())):
            mine = order[linear] > i
            coefficients[i, linear[mine]] = bits.signed(linear[mine], precision[mine])
    for k, c in FIXED.items():
        for i, v in enumerate(c[:most]):
            coefficients[i, kind == 8 + k] = v
    rice = ~(constant | verbatim)
    method, parts = np.zeros(n, np.int64), np.zeros(n, np.int64)
    who = every[rice]
    if len(who):
        method[who], parts[who] = bits.take(who, 2), bits.take(who, 4)
        if (method[who] > 1).any():
            raise ValueError("a residual of a reserved coding")
    part_size = np.maximum(1, sizes >> parts)
    parameter, escape = np.zeros(n, np.int64), np.full(n, -1)
    order_by = np.argsort(-sizes, kind="stable")
    sorted_sizes = sizes[order_by]
    live = n
    single = not parts.any()
    for i in range(width):
        while sorted_sizes[live - 1] <= i:
            live -= 1
        who = order_by[:live]
        plain = verbatim[who]
        if plain.any():
            mine = who[plain]
            out[i, mine] = bits.signed(mine, depth[mine])
        who = who[rice[who]]
        if not len(who):
            continue
        if not single or i == 0:
            new = who[i % part_size[who] == 0] if i else who
            if len(new):
                code = 4 + method[new]
                parameter[new] = bits.take(new, code)
                escaped = new[parameter[new] == (1 << code) - 1]
                escape[new] = -1
                if len(escaped):
                    escape[escaped] = bits.take(escaped, 5)
        if i < most:
            who = who[order[who] <= i]
            if not len(who):
                continue
        raw = escape[who] >= 0
        if raw.any():
            fixed = who[raw]
            out[i, fixed] = bits.signed(fixed, escape[fixed])
            coded = who[~raw]
        else:
            coded = who
        if len(coded):
            out[i, coded] = bits.rice(coded, parameter[coded])
        if most and i:
            guess = coefficients[0, who] * out[i - 1, who]
            for j in range(1, min(most, i)):
                guess += coefficients[j, who] * out[i - 1 - j, who]
            out[i, who] += guess >> np.maximum(shift[who], 0)
    return (out << wasted).T


def _headers(data: bytes) -> tuple[dict, list[int], int]:
    """Stream facts, offsets of the seek points and where the frames begin."""
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, facts, points, last = 4, {}, [], False
    while not last:
        last, kind, size = bool(data[at] >> 7), data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            facts = {"block": int.from_bytes(body[2:4], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            points = [int.from_bytes(body[i + 8 : i + 16], "big") for i in range(0, size, 18) if body[i : i + 8] != b"\xff" * 8]
        at += 4 + size
    return facts, points, at


def _frame_facts(data: bytes, at: int, facts: dict) -> tuple[int, int, int, int]:
    """Where the subframes begin, block size, channel assignment and sample size; the header's checksum is verified."""
    if data[at : at + 2] not in (b"\xff\xf8", b"\xff\xf9"):
        raise ValueError(f"no frame at byte {at}")
    size_code, rate_code, channels, bits_code = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    i, lead = at + 5, data[at + 4]
    while lead & 0x80 and lead & 0x40:
        lead, i = lead << 1 & 0xFF, i + 1
    if size_code in (6, 7):
        size, i = int.from_bytes(data[i : i + size_code - 5], "big") + 1, i + size_code - 5
    else:
        size = BLOCK_CODES[size_code]
    i += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if crc8(data[at:i]) != data[i]:
        raise ValueError(f"the header at byte {at} does not match its checksum")
    return i + 1, size, channels, BITS_CODES[bits_code] if bits_code else facts["bits"]


def _frames(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, channels: int, depths: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Samples of frames with one channel assignment (a row each, by channel) and the byte after each, its checksum included."""
    bits = _Bits(data, starts)
    n_channels = channels + 1 if channels < 8 else 2
    side = {8: 1, 9: 0, 10: 1}.get(channels, -1)
    got = [_subframes(bits, sizes, depths + (c == side)) for c in range(n_channels)]
    if channels == 8:
        got[1] = got[0] - got[1]
    elif channels == 9:
        got[0] = got[0] + got[1]
    elif channels == 10:
        middle = got[0] << 1 | got[1] & 1
        got = [(middle + got[1]) >> 1, (middle - got[1]) >> 1]
    return got, (bits.at + 7) // 8 + 2


def decode_streams(streams: list[bytes]) -> list[dict]:
    """For each stream: rate, channels, bits, samples (n by channels), pcm, and blocks, the first sample and size of every frame.

    pcm is interleaved and little-endian; samples of up to 8 bits are unsigned in it, as in WAV files.

    Checksums of every header and frame and the digest of all samples are verified; a stream that fails raises ValueError.
    """
    out, todo = [], []
    joined = np.frombuffer(b"".join(streams), np.uint8)
    base = 0
    for k, data in enumerate(streams):
        facts, points, first = _headers(data)
        full, at, found = facts["samples"], 0, []
        for p in points:
            head = _frame_facts(data, first + p, facts)
            if at >= full:
                break
            found.append((k, base + first + p, base + head[0], *head[1:]))
            at += head[1]
        if at != full or not found:  # no full table: frame after frame
            found, i = [], first
            while i < len(data):
                head = _frame_facts(data, i, facts)
                _, stop = _frames(joined, np.array([base + head[0]]), np.array([head[1]]), head[2], np.array([head[3]]))
                found.append((k, base + i, base + head[0], *head[1:]))
                i = int(stop[0]) - base
        todo += found
        out.append(facts | {"blocks": [], "parts": []})
        base += len(data)
    table = np.array(todo, np.int64).reshape(-1, 6)
    parts: list = [None] * len(table)
    for channels in np.unique(table[:, 4]).tolist():
        mine = np.flatnonzero(table[:, 4] == channels)
        for some in (mine[i : i + 4096] for i in range(0, len(mine), 4096)):
            t = table[some]
            got, stop = _frames(joined, t[:, 2], t[:, 3], channels, t[:, 5])
            told = joined[stop - 2].astype(np.uint32) << 8 | joined[stop - 1]
            if (crc16(joined, t[:, 1], stop - 2) != told).any():
                raise ValueError("a frame does not match its checksum")
            for row, (i, size) in enumerate(zip(some.tolist(), t[:, 3].tolist())):
                parts[i] = np.stack([c[row, :size] for c in got], 1).astype(np.int16 if out[todo[i][0]]["bits"] <= 16 else np.int32)
    for (k, *_), part in zip(todo, parts):
        blocks = out[k]["blocks"]
        blocks.append((sum(blocks[-1]) if blocks else 0, len(part)))
        out[k]["parts"].append(part)
    for o in out:
        o["samples"] = np.concatenate(o.pop("parts"))
        width = (o["bits"] + 7) // 8
        if width == 3:
            raw = o["samples"].astype("<i4").view(np.uint8).reshape(*o["samples"].shape, 4)[..., :width].tobytes()
        else:
            raw = o["samples"].astype(f"<i{width}").tobytes()
        if o["md5"] != b"\0" * 16 and hashlib.md5(raw, usedforsecurity=False).digest() != o["md5"]:
            raise ValueError("the samples do not match the stream's digest")
        o["pcm"] = (np.frombuffer(raw, np.uint8) ^ np.uint8(128)).tobytes() if width == 1 else raw
    return out


def samples_of(raw: bytes) -> np.ndarray:
    """Bytes as unsigned 8-bit PCM: the signed samples."""
    return (np.frombuffer(raw, np.uint8) ^ np.uint8(128)).view(np.int8)


def payload(text: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def to_flac(rows: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """Replaces the text column by ``media_col``: its UTF-8 bytes, padded with zeros to a positive multiple of 64, as FLAC.

    A byte is an unsigned 8-bit sample. Null texts count as empty. Also adds ``n_bytes``, the size before padding. Columns of
    these two names are replaced; all others stay. Rows are coded on their own, without a shuffle: repeated rows give equal streams,
    an empty table an empty result, and a text of any length one stream, coded in stretches.
    """
    stay = [c for c in rows.columns if c not in (text_col, media_col, "n_bytes")]
    rows = rows.select(*stay, text_col)
    schema = rows.select(*stay).schema.add("n_bytes", T.LongType()).add(media_col, T.BinaryType())

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            data, at = buffer(part.column(text_col))
            raw, at = data.tobytes(), at.tolist()
            texts = [raw[a:b] for a, b in zip(at, at[1:])]
            media = encode_streams([samples_of(payload(t)) for t in texts])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in stay), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], [*stay, "n_bytes", media_col])

    return rows.transform(mapped, coded, schema)


def facts_of(samples: np.ndarray) -> tuple[int, int, int]:
    """Largest magnitude, energy and number of sign changes of the first channel."""
    peak = energy = 0
    for a in range(0, len(samples), STRETCH):
        x = samples[a : a + STRETCH, 0].astype(np.int64)
        peak, energy = max(peak, int(np.abs(x).max())), energy + int((x * x).sum())
    below = samples[:, 0] < 0
    return peak, energy, int((below[1:] != below[:-1]).sum())


BLOCKS = T.ArrayType(T.StructType([T.StructField("first_sample", T.LongType()), T.StructField("n_samples", T.IntegerType()), T.StructField("offset", T.LongType())]))


def from_flac(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds what the streams hold: sample_rate, channels, bits, n_samples, peak, energy, crossings, pcm and blocks.

    blocks lists first_sample, n_samples and the byte offset in pcm of every frame, so a reader can seek to any sample. A null
    stream gives nulls; a broken one fails the job, since its samples cannot be known. Columns of these names are replaced.
    """
    names = ["sample_rate", "channels", "bits", "n_samples", "peak", "energy", "crossings", "pcm", "blocks"]
    stay = [c for c in media.columns if c not in names]
    media = media.select(*stay)
    schema = media.select(*stay).schema
    for name, kind in zip(names, [T.IntegerType(), T.IntegerType(), T.IntegerType(), *[T.LongType()] * 4, T.BinaryType(), BLOCKS]):
        schema = schema.add(name, kind)
    kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary(), pa.list_(pa.struct([("first_sample", pa.int64()), ("n_samples", pa.int32()), ("offset", pa.int64())]))]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, media_col):
            streams = part.column(media_col).to_pylist()
            found = iter(decode_streams([s for s in streams if s is not None]))
            rows = []
            for s in streams:
                if s is None:
                    rows.append((None,) * len(names))
                    continue
                d = next(found)
                step = d["channels"] * ((d["bits"] + 7) // 8)
                rows.append((d["rate"], d["channels"], d["bits"], len(d["samples"]), *facts_of(d["samples"]), d["pcm"], [{"first_sample": a, "n_samples": n, "offset": a * step} for a, n in d["blocks"]]))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in stay), *(pa.array(v, t) for v, t in zip(zip(*rows), kinds))], [*stay, *names])

    return media.transform(mapped, decoded, schema)
