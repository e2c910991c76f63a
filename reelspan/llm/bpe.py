"""Byte-level BPE: encoding by segment trees over pair ranks, and decoding.

Every word that is cut off the text by the tokenizer's split pattern is merged on its own. Its tree has one leaf for each
adjacent pair of symbols, holding (rank, place); the root is the least of them, that is the leftmost pair of lowest rank. A
merge changes three leaves, and each change goes up the tree in as many steps as it has levels. Trees of one size are kept as
the rows of one array and are worked on together, each with its own merges, until no root has a rank.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import buffer, mapped, mixed, slices, word_hashes

#: The split pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces whose ids a worker remembers (about 60 bytes each); the memory starts afresh when it is full.
REMEMBERED = 690_000
_NO_RANK = np.int64(1) << 62
_PLACE = 32
#: Long words of one size that are too few to be worked on side by side.
_FEW = 24


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if it is printable Latin-1 and no space, else one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


def check_plain(path: str) -> dict:
    """The tokenizer file, if texts can be cut where ``cut_places`` does; else an error."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec["pre_tokenizer"]
    if spec["model"]["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or spec["normalizer"]:
        raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
    for t in spec["added_tokens"]:
        if regex.search(r"[ \n]|[A-Za-z][!-/:-@\[-`{}~]", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"]:
            raise ValueError("added tokens with spaces, line feeds, marks after letters or stripping are not supported")
    return spec


class Model:
    """The tables of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        spec = check_plain(path)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pattern = regex.compile(PATTERN)
        letters = byte_alphabet()
        self.byte_ids = np.array([vocab[c] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), merged
        size = max([*vocab.values(), *self.special.values()]) + 1
        of = {c: b for b, c in enumerate(letters)}
        spelled = [b""] * size
        for token, i in vocab.items():
            spelled[i] = bytes(of[c] for c in token)
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.lengths = np.array(list(map(len, spelled)), np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def _forest(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Merges in every row of ``symbols`` (rows of a power of 2 places); returns which places still hold a symbol."""
        n, width = symbols.shape
        place = np.arange(width, dtype=np.int64)
        alive = place[None, :] < lengths[:, None]
        tree = np.full((n, 2 * width), _NO_RANK, np.int64)
        if width > 1:
            ranks = self.rank(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, width - 1)
            tree[:, width : 2 * width - 1] = np.where((ranks >= 0) & alive[:, 1:], ranks << _PLACE | place[:-1], _NO_RANK)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        after = np.minimum(np.broadcast_to(place + 1, (n, width)), lengths[:, None])
        before = np.broadcast_to(place - 1, (n, width)).copy()
        # flat views, addressed by row * width + place
        tree_, after_, before_, symbols_, alive_ = tree.ravel(), after.ravel(), before.ravel(), symbols.ravel(), alive.ravel()
        row = np.flatnonzero(tree[:, 1] < _NO_RANK)
        while len(row):
            root = tree_[row * (2 * width) + 1]
            at, base, end = root & ((1 << _PLACE) - 1), row * width, lengths[row]
            gone = after_[base + at]
            new = self.merged[root >> _PLACE]
            symbols_[base + at] = new
            alive_[base + gone] = False
            follow, ahead = after_[base + gone], before_[base + at]
            after_[base + at] = follow
            has_follow, has_ahead = follow < end, ahead >= 0
            before_[(base + follow)[has_follow]] = at[has_follow]
            neighbour = symbols_[np.where(has_follow, base + follow, base)]
            right = np.where(has_follow, self.rank(new, neighbour), -1)
            left = np.where(has_ahead, self.rank(symbols_[np.where(has_ahead, base + ahead, base)], new), -1)
            trunk = row * (2 * width)
            for leaf, value in ((gone, np.full(len(row), -1)), (at, right), (np.where(has_ahead, ahead, at), np.where(has_ahead, left, right))):
                node = trunk + width + leaf
                tree_[node] = np.where(value >= 0, value << _PLACE | leaf, _NO_RANK)
                node = width + leaf
                while node[0] > 1:  # all leaves are equally deep
                    node >>= 1
                    tree_[trunk + node] = np.minimum(tree_[trunk + 2 * node], tree_[trunk + 2 * node + 1])
            row = row[tree_[trunk + 1] < _NO_RANK]
        return alive

    @cached_property
    def _merges(self) -> dict[int, tuple[int, int]]:
        """Pair -> its rank and what it becomes."""
        return dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged[self.ranks].tolist())))

    def _tree(self, symbols: list[int]) -> list[int]:
        """The symbols of one long word after all merges: the same tree, worked on alone."""
        n, merges, none = len(symbols), self._merges, int(_NO_RANK)
        width = 1 << (n - 1).bit_length()
        tree = [none] * (2 * width)

        def leaf(left: int, right: int, place: int) -> int:
            found = merges.get(symbols[left] << 32 | symbols[right])
            return found[0] << _PLACE | place if found else none

        tree[width : width + n - 1] = [leaf(i, i + 1, i) for i in range(n - 1)]
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while tree[1] < none:
            at = tree[1] & (1 << _PLACE) - 1
            gone = after[at]
            symbols[at] = merges[symbols[at] << 32 | symbols[gone]][1]
            symbols[gone] = -1
            follow, ahead = after[gone], before[at]
            after[at] = follow
            changed = [(gone, none), (at, none)]
            if follow < n:
                before[follow] = at
                changed[1] = (at, leaf(at, follow, at))
            if ahead >= 0:
                changed.append((ahead, leaf(ahead, at, ahead)))
            for place, value in changed:
                node = width + place
                tree[node] = value
                while node > 1:
                    node >>= 1
                    least = min(tree[2 * node], tree[2 * node + 1])
                    if tree[node] == least:
                        break
                    tree[node] = least
        return [s for s in symbols if s >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, word after word, and the number of ids of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        begin = np.cumsum(sizes) - sizes
        counts = np.zeros(len(words), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        width, low = 1, 0
        while low < sizes.max(initial=0):
            mine = np.flatnonzero((sizes > low) & (sizes <= width))
            if len(mine) < _FEW and width > 64:  # a step over few trees costs as much as one over many
                for i in mine.tolist():
                    got = self._tree(raw[begin[i] : begin[i] + sizes[i]].tolist())
                    counts[i] = len(got)
                    found.append((np.array([i]), np.array(got, np.int64)))
                mine = mine[:0]
            step = max(1, (1 << 18) // width)
            for part in (mine[i : i + step] for i in range(0, len(mine), step)):
                place = np.arange(width)
                inside = place[None, :] < sizes[part][:, None]
                symbols = raw[np.where(inside, begin[part][:, None] + place, 0)]
                alive = self._forest(symbols, sizes[part])
                counts[part] = alive.sum(1)
                found.append((part, symbols[alive]))
            width, low = width * 2, width
        ids = np.zeros(counts.sum(), np.int64)
        start = np.cumsum(counts) - counts
        for part, got in found:
            n = counts[part]
            ids[np.repeat(start[part] - (np.cumsum(n) - n), n) + np.arange(len(got))] = got
        return ids, counts

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece as little-endian 32-bit numbers."""
        words: list[bytes] = []
        parts: list[int] = []
        special: list[tuple[int, int]] = []
        for piece in pieces:
            n = len(words)
            if self.special_pattern and self.special_pattern.search(piece):
                at = 0
                for m in self.special_pattern.finditer(piece):
                    words += map(str.encode, self.pattern.findall(piece[at : m.start()]))
                    special.append((len(words), self.special[m[0]]))
                    words.append(b"\0")
                    at = m.end()
                words += map(str.encode, self.pattern.findall(piece[at:]))
            else:
                words += map(str.encode, self.pattern.findall(piece))
            parts.append(len(words) - n)
        if not words:
            return [b""] * len(pieces)
        ids, counts = self.encode_words(words)
        ends = np.concatenate([[0], np.cumsum(counts)])
        for word, i in special:  # a stand-in word of one byte has one id
            ids[ends[word]] = i
        flat = ids.astype("<u4").tobytes()
        cut = (4 * ends[np.concatenate([[0], np.cumsum(parts)])]).tolist()
        return [flat[a:b] for a, b in zip(cut, cut[1:])]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids that ends at ``ends``."""
        n = self.lengths[ids]
        after = np.cumsum(n)
        flat = self.spelled[np.repeat(self.begins[ids] - (after - n), n) + np.arange(after[-1] if len(after) else 0)].tobytes()
        cut = [0, *np.concatenate([[0], after])[ends].tolist()]
        return [flat[a:b] for a, b in zip(cut, cut[1:])]


#: White space of one byte, and the UTF-8 forms of all other white space: first byte, second, and the range of a third.
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), *range(28, 33)]] = True
_WIDE_SPACE = [(0xC2, 0x85, None), (0xC2, 0xA0, None), (0xE1, 0x9A, (0x80, 0x80)), (0xE2, 0x80, (0x80, 0x8A)), (0xE2, 0x80, (0xA8, 0xAF)), (0xE2, 0x81, (0x9F, 0x9F)), (0xE3, 0x80, (0x80, 0x80))]
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: ASCII marks but the bar, which added tokens are written with; and how many of them at the end of a piece are looked at.
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and c != 124]] = True
_MARKS = 8
#: Bytes of a piece that is remembered, and bytes of text that are looked up at once.
_LONGEST, _STRETCH = 256, 1 << 20


def cut_places(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the texts of a buffer can be cut so that the pieces, each encoded alone, give the ids of the whole.

    The split pattern always cuts before a space that no white space follows, before a lone line feed, and between an ASCII letter
    and the marks at the end of such a piece. Other safe cuts are left out. Every text that is not empty starts a piece.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    last, first = np.zeros(n, bool), np.zeros(n, bool)
    last[heads[1:] - 1] = last[n - 1] = first[heads] = True
    near = np.concatenate([data, np.zeros(3, np.uint8)])
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[~last[at] & ~_SPACE[near[at + 1]]]
    some = np.flatnonzero(near[at + 1] >= 0xC2)
    if len(some):
        a, b, c = (near[at[some] + k] for k in (1, 2, 3))
        unsafe = np.zeros(len(some), bool)
        for one, two, three in _WIDE_SPACE:
            unsafe |= (a == one) & (b == two) & ((c >= three[0]) & (c <= three[1]) if three else True)
        at = np.delete(at, some[unsafe])
    before = data[np.maximum(at - 1, 0)]
    # a line feed at a text's head, or after a byte that may end white space, is no cut
    at = at[(data[at] == 32) | ~(first[at] | _SPACE[before] | (before >= 0x80))]
    first[at] = True
    cuts = np.flatnonzero(first)
    place = np.append(cuts[1:], n) - 1
    mine = _MARK[data[place]]
    place, low = place[mine], cuts[mine]
    for _ in range(_MARKS):
        place = place - ((place - 1 > low) & _MARK[data[np.maximum(place - 1, 0)]])
    first[place[(place > low) & _LETTER[data[np.maximum(place - 1, 0)]]]] = True
    return np.flatnonzero(first)


class Memo:
    """Ids of pieces by 128 bits of hash, of ``limit`` pieces at most: an open hash table in arrays, for whole columns at once."""

    def __init__(self, limit: int):
        self.limit, self.slots = limit, 1 << max(4, (3 * limit // 2).bit_length())
        self.clear()

    def clear(self) -> None:
        self.size = self.used = 0
        self.keys, self.checks, self.begin = (np.zeros(self.slots, np.uint64) for _ in range(3))
        self.count = np.zeros(self.slots, np.int32)
        self.flat = np.zeros(1 << 12, np.uint32)

    def __len__(self) -> int:
        return self.size

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The slot of every key, or -1."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        slot = (keys & np.uint64(self.slots - 1)).astype(np.int64)
        while len(todo):
            there = self.keys[slot]
            hit = (there == keys[todo]) & (self.checks[slot] == checks[todo])
            out[todo[hit]] = slot[hit]
            go = (there != 0) & ~hit
            todo, slot = todo[go], (slot[go] + 1) & (self.slots - 1)
        return out

    def put(self, keys: np.ndarray, checks: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Remembers the ids of distinct pieces, counts of which belong to each; it starts afresh when it is full."""
        if self.size + len(keys) > self.limit:
            self.clear()
            keys, checks, counts = keys[: self.limit], checks[: self.limit], counts[: self.limit]
            ids = ids[: counts.sum()]
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + 2 * len(ids), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        begin = self.used + np.cumsum(counts) - counts
        self.used, self.size = self.used + len(ids), self.size + len(keys)
        todo, slot = np.arange(len(keys)), (keys & np.uint64(self.slots - 1)).astype(np.int64)
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[todo[free]]
            own = free & (self.keys[slot] == keys[todo])
            for held, new in ((self.checks, checks), (self.begin, begin), (self.count, counts)):
                held[slot[own]] = new[todo[own]]
            todo, slot = todo[~own], (slot[~own] + 1) & (self.slots - 1)


def _put_runs(out: np.ndarray, to: np.ndarray, flat: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> None:
    """Puts runs of ``flat`` to their places in ``out``."""
    after = np.cumsum(counts)
    step = np.arange(after[-1] if len(after) else 0)
    out[np.repeat(to - (after - counts), counts) + step] = flat[np.repeat(begin.astype(np.int64) - (after - counts), counts) + step]


class Encoder:
    """Encodes whole texts piece by piece and remembers the ids of pieces, up to ``limit`` of them."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = REMEMBERED):
        self.encode, self.known = encode, Memo(limit)

    def _block(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces of a stretch of text, and how many each has."""
        if len(begin) == 1 and len(data) > _LONGEST:
            ids = np.frombuffer(self.encode([data.tobytes().decode()])[0], "<u4")
            return ids, np.array([len(ids)])
        keys = np.maximum(word_hashes(data, begin, end), 1)
        # the check has the first and the last eight bytes
        eight = np.ndarray(len(data) + 8, "<u8", np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)]), 0, (1,))
        size = (end - begin).astype(np.uint64)
        short = np.where(size < 8, 64 - 8 * size, np.uint64(0))
        checks = mixed((eight[begin + 8] << short) + np.uint64(1)) ^ (eight[end] >> short) ^ size << np.uint64(40)
        slot = self.known.find(keys, checks)
        counts = self.known.count[slot].astype(np.int64)
        missed = np.flatnonzero(slot < 0)
        if len(missed):
            order = missed[np.lexsort((checks[missed], keys[missed]))]
            new = np.ones(len(order), bool)
            new[1:] = (keys[order][1:] != keys[order][:-1]) | (checks[order][1:] != checks[order][:-1])
            of, some = np.cumsum(new) - 1, order[new]
            raw = data.tobytes()
            got = self.encode([raw[a:b].decode() for a, b in zip(begin[some].tolist(), end[some].tolist())])
            sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
            fresh, starts = np.frombuffer(b"".join(got), "<u4"), np.cumsum(sizes) - sizes
            counts[order] = sizes[of]
        after = np.cumsum(counts)
        out = np.zeros(after[-1], np.uint32)
        hit = np.flatnonzero(slot >= 0)
        _put_runs(out, (after - counts)[hit], self.known.flat, self.known.begin[slot[hit]], counts[hit])
        if len(missed):
            _put_runs(out, (after - counts)[order], fresh, starts[of], counts[order])
            short_ = size[some] <= _LONGEST
            self.known.put(keys[some][short_], checks[some][short_], sizes[short_], fresh[np.repeat(short_, sizes)])
        return out, counts

    def column(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and where each row's end; null counts as empty. Long texts are worked through in stretches."""
        data, offsets = buffer(col)
        begin = cut_places(data, offsets)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        end = np.append(begin[1:], len(data))
        long = end - begin > _LONGEST
        cuts = np.flatnonzero(np.diff(begin // _STRETCH, prepend=-1).astype(bool) | long | np.roll(long, 1)).tolist() + [len(begin)]
        done = [self._block(data[begin[a] : end[b - 1]], begin[a:b] - begin[a], end[a:b] - begin[a]) for a, b in zip(cuts, cuts[1:])]
        after = np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in done]))])
        return np.concatenate([ids for ids, _ in done]), after[np.searchsorted(begin, offsets)[1:]]

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids, ends = self.column(pa.array(texts, pa.string()))
        flat, cut = ids.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
        return [flat[a:b] for a, b in zip(cut, cut[1:])]


@lru_cache(2)
def model(path: str) -> Model:
    return Model(path)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(model(path).encode_pieces)


def bpe_encode(docs: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """Replaces the text column by ``ids_col``, the array of its ids; all other columns stay.

    Ids equal those of the tokenizers library without special tokens added; strings of added tokens in a text get their id, as
    there. A null or empty text has no ids. The text is never cut short: a word of any length is one tree. A column already named
    ``ids_col`` is replaced. Every row is encoded on its own, without a shuffle; repeated rows each get their ids, an empty table
    gives an empty result.
    """
    stay = [c for c in docs.columns if c not in (text_col, ids_col)]
    docs = docs.select(*stay, text_col)
    schema = docs.select(*stay).schema.add(ids_col, T.ArrayType(T.IntegerType()))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for part in slices(batches, text_col):
            flat, ends = encode.column(part.column(text_col))
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.view(np.int32)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in stay), ids], [*stay, ids_col])

    return docs.transform(mapped, encoded, schema)


def bpe_decode(coded: DataFrame, tokenizer: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """Adds ``text_col``, the decoded text of ``ids_col``, in place of a column of that name.

    Bytes that are no UTF-8 become U+FFFD; null or no ids give an empty text, an empty table an empty result, repeated rows a text
    each. A row is decoded whole.
    """
    columns = [c for c in coded.columns if c != text_col]
    coded = coded.select(*columns)
    schema = coded.select(*columns).schema.add(text_col, T.StringType())

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                col = part.column(ids_col)
                sizes = np.asarray(pc.fill_null(pc.list_value_length(col), 0), np.int64)
                ids = np.asarray(col.flatten(), np.int64)
                texts = [b.decode("utf-8", "replace") for b in tables.decode(ids, np.cumsum(sizes))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(texts, pa.string())], [*columns, text_col])

    return coded.transform(mapped, decoded, schema)
