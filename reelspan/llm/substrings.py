"""Removal of repeated 50-word passages: a count-min prefilter, then exact grouping of the windows it lets through."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import buffer, mapped, mixed, slices, spans_hash, word_hashes, words
from .store import discard, keep, partitions, possibly_in

WINDOW = 50
#: Words of the runs whose least hash, the sign, stands for a window in the sketch.
GRAM = 8
#: Rows of the count-min sketch; a shard's rows have four counters or more for each sign that it is sent.
ROWS = 3
#: Signs or windows that a task gathers before it sends them on, and windows for which there is a shard at least.
FLUSH, SHARD_WINDOWS = 1 << 19, 1 << 20


def _sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n neighbours."""
    size = len(x) - n + 1
    pad = -len(x) % n
    full = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, n)
    ahead = np.minimum.accumulate(full, 1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:size], ahead[n - 1 : n - 1 + size])


class Windows:
    """All windows of the texts of a column: the word they start at, the row they are in and the run that stands for them."""

    def __init__(self, col: pa.Array, window: int, gram: int):
        self.data, self.offsets = buffer(col)
        self.starts, self.ends, self.first = words(self.data, self.offsets)
        n = len(self.starts)
        self.window = window
        counts = np.diff(self.first)
        windows = np.maximum(0, counts - window + 1)
        self.rows = np.repeat(np.arange(len(counts)), windows)
        after = np.cumsum(windows)
        self.at = np.arange(int(after[-1]) if len(after) else 0) - np.repeat(after - windows, windows) + self.first[:-1][self.rows]
        if len(self.at):
            self.hashes = word_hashes(self.data, self.starts, self.ends)
            grams = spans_hash(self.hashes, np.arange(n - gram + 1), np.arange(gram, n + 1))
            self.sign = _sliding_least(grams, window - gram + 1)[self.at]
        else:
            self.sign = np.zeros(0, np.uint64)

    def full(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of hash for the chosen windows."""
        a, b = self.at[which], self.at[which] + self.window
        return spans_hash(self.hashes, a, b), spans_hash(word_hashes(self.data, self.starts, self.ends, 1), a, b, 1)


def _counters(signs: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mixed(signs + np.uint64((row + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(64 - bits)).astype(np.int64)


def estimates(signs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What a count-min sketch of signs with their counts has for each of them: never less than its true total."""
    bits = max(6, (4 * len(signs) - 1).bit_length())
    least = np.full(len(signs), np.inf)
    for row in range(ROWS):
        at = _counters(signs, row, bits)
        least = np.minimum(least, np.bincount(at, counts, 1 << bits)[at])
    return least


def _dealt(values: np.ndarray, shards: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by shard, and (shard, begin, end) of the runs in it."""
    shard = (mixed(values ^ np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1)).tolist() + [len(order)]
    return order, [(int(shard[order[a]]), a, b) for a, b in zip(cuts, cuts[1:])]


def _batches(rows: list[tuple], names: list[str], kinds: list[pa.DataType], size: int = 2000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size]), kinds)], names)


def _packed(ids: np.ndarray, keys: np.ndarray, values: np.ndarray, buckets: int) -> list[tuple[int, bytes, bytes]]:
    """(bucket, documents, values) with a row for each bucket of documents: their ids, keys and numbers of values, and the values."""
    if not len(ids):
        return []
    bucket = (mixed(ids.astype(np.uint64) ^ mixed(keys.astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((values, keys, ids, bucket))
    b, d, k, v = bucket[order], ids[order], keys[order], values[order]
    head = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])]))
    docs = np.stack([d[head], k[head], np.diff(np.append(head, len(d)))])
    cuts = np.flatnonzero(np.diff(b[head], prepend=-1)).tolist() + [len(head)]
    at = [*head.tolist(), len(d)]
    return [(int(b[at[i]]), docs[:, i:j].tobytes(), v[at[i] : at[j]].tobytes()) for i, j in zip(cuts, cuts[1:])]


def _by_key(batches: Iterator[pa.RecordBatch], key: str, columns: list[str]) -> Iterator[list[list[bytes]]]:
    """Of rows sorted by ``key``, the data of all rows of a key, column by column."""
    last, held = None, []
    for whole in batches:
        for k, *row in zip(*(whole.column(c).to_pylist() for c in [key, *columns])):
            if row[0] is not None:
                if k != last and held:
                    yield list(zip(*held))
                    held = []
                last = k
                held.append(row)
    if held:
        yield list(zip(*held))


def _answers(batches: Iterator[pa.RecordBatch], columns: list[str], work: Callable[[list[list[bytes]]], tuple[np.ndarray, ...]], buckets: int) -> Iterator[pa.RecordBatch]:
    """What ``work`` finds in the data of each shard, as (ids, keys, values), packed for many shards together; packed rows go on as they are."""
    ready: list[pa.RecordBatch] = []

    def seen() -> Iterator[pa.RecordBatch]:
        for whole in batches:
            plain = whole.filter(pc.is_valid(whole.column("bucket")))
            if plain.num_rows:
                ready.append(plain.select(_PACKED_NAMES))
            yield whole

    held, size = [], 0
    for data in _by_key(seen(), "shard", columns):
        yield from ready
        ready.clear()
        held.append(work(data))
        size += len(held[-1][0])
        if size > FLUSH:
            yield from _batches(_packed(*map(np.concatenate, zip(*held)), buckets), _PACKED_NAMES, _PACKED_KINDS)
            held, size = [], 0
    yield from ready
    if held:
        yield from _batches(_packed(*map(np.concatenate, zip(*held)), buckets), _PACKED_NAMES, _PACKED_KINDS)


def _unpacked(packed: DataFrame, kind: type) -> DataFrame:
    """(id, key, found) of packed rows: one row a document, with all its values of that kind in order."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in _by_key(batches, "bucket", ["docs", "found"]):
            ids, keys, n = np.concatenate([np.frombuffer(x, np.int64).reshape(3, -1) for x in data[0]], 1)
            values = np.frombuffer(b"".join(data[1]), kind)
            ids, keys = np.repeat(ids, n), np.repeat(keys, n)
            order = np.lexsort((values, keys, ids))
            d, k, v = ids[order], keys[order], values[order]
            cuts = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])])).tolist() + [len(d)]
            rows = [(int(d[a]), int(k[a]), v[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
            yield from _batches(rows, ["id", "key", "found"], [pa.int64(), pa.int64(), pa.binary()])

    dealt = packed.repartition(partitions(packed.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.transform(mapped, opened, "id long, key long, found binary")


_PACKED = "bucket int, docs binary, found binary"
_PACKED_NAMES, _PACKED_KINDS = ["bucket", "docs", "found"], [pa.int32(), pa.binary(), pa.binary()]


def repeated_signs(docs: DataFrame, shards: int, buckets: int, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, key, found) of (id, key, text): signs, 64 bits each, of the text's windows that a count-min sketch has twice or more.

    A window's sign is the least hash of the ``gram``-word runs in it; it is counted once for each stretch of neighbouring windows
    that share it. Equal windows have equal signs and no count is less than the truth, so a window that starts in two
    documents is never left out. The sketch grows with the input: it is dealt to shards by sign, every shard merges what the
    tasks have counted, with the documents that it came from, and answers for these. A sign that a task has met twice itself is
    known there and goes to its shard once, so very common ones do not gather in a shard.
    """
    names, kinds = ["shard", *_PACKED_NAMES, "signs", "counts", "of"], [pa.int32(), *_PACKED_KINDS, pa.binary(), pa.binary(), pa.binary()]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            signs, ids, keys = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(signs, kind="stable")
            signs, ids, keys = signs[order], ids[order], keys[order]
            head = np.flatnonzero(np.concatenate([[True], signs[1:] != signs[:-1]]))
            n = np.diff(np.append(head, len(signs)))
            twice = np.repeat(n > 1, n)
            rows = [(row[0] % shards, *row, None, None, None) for row in _packed(ids[twice], keys[twice], signs[twice], buckets)]
            order, runs = _dealt(signs[head], shards)
            at, counts = head[order], np.minimum(n[order], 2).astype(np.uint8)
            for shard, a, b in runs:
                rows.append((shard, None, None, None, signs[at[a:b]].tobytes(), counts[a:b].tobytes(), np.stack([ids[at[a:b]], keys[at[a:b]]]).tobytes()))
            yield from _batches(rows, names, kinds)

        for part in slices(batches, "text"):
            w = Windows(part.column("text"), window, gram)
            if len(w.sign):
                new = np.ones(len(w.sign), bool)
                new[1:] = (w.sign[1:] != w.sign[:-1]) | (w.rows[1:] != w.rows[:-1])
                rows = w.rows[new]
                held.append((w.sign[new], *(np.asarray(part.column(c), np.int64)[rows] for c in ("id", "key"))))
                size += len(rows)
                if size > FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def counted(data: list[list[bytes]]) -> tuple[np.ndarray, ...]:
        signs, counts = np.frombuffer(b"".join(data[0]), np.uint64), np.frombuffer(b"".join(data[1]), np.uint8)
        ids, keys = np.concatenate([np.frombuffer(x, np.int64).reshape(2, -1) for x in data[2]], 1)
        told = (counts == 1) & (estimates(signs, counts) > 1)
        return ids[told], keys[told], signs[told]

    dealt = docs.select("id", "key", "text").transform(mapped, sent, f"shard int, {_PACKED}, signs binary, counts binary, of binary")
    n = partitions(docs.sparkSession)
    answers = dealt.repartition(n, "shard").sortWithinPartitions("shard").transform(mapped, lambda batches: _answers(batches, ["signs", "counts", "of"], counted, buckets), _PACKED)
    return _unpacked(answers, np.uint64)


def _first_of_each(h1: np.ndarray, h2: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by window, and for each in that order the least document that has the same window."""
    order = np.lexsort((docs, h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, docs[order][np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))]


def drop_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text's words, joined by one space, less those covered by a window that also starts in a smaller id.

    Adds n_words and n_removed (columns of these names are replaced); all other columns stay. Words are the runs between spaces
    and the bytes 9 to 13. Windows are judged on the input, not on what is left, so copies of a document keep only its first.
    Null and empty texts have no words and become empty; texts shorter than the window are only respaced. Rows with a null id
    neither cover nor lose words; rows that share an id do not cover each other. An empty table gives an empty result.

    Only texts with a sign that the sketch calls repeated are looked at again. Of their windows with such a sign, each task sends one
    per document and window to the shard of its hash; windows that it has seen in a smaller document itself it settles at once, so
    very common passages arrive once from each task, spread over the shards. Shards group by a 128-bit hash of the words and
    report the covered places; only texts with such places meet them in a join, all others are respaced where they are. Shards
    are four a shuffle partition, or more, so that none holds over a million windows on average.
    """
    spark = docs.sparkSession
    stay = [c for c in docs.columns if c not in ("n_words", "n_removed", text_col)]
    base = docs.select(F.struct(*[F.col(c) for c in stay]).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(text_col).alias("text"))
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    n_parts = partitions(spark)
    signs = keep(repeated_signs(narrow, 4 * n_parts, n_parts, window))
    # a sign stands for some twenty windows
    n_signs = signs.agg(F.sum(F.octet_length("found"))).first()[0] or 0
    shards = max(4 * n_parts, n_signs // 8 * 20 // SHARD_WINDOWS)
    buckets = max(n_parts, shards // 4)
    names, kinds = ["shard", *_PACKED_NAMES, "h1", "h2", "of", "places"], [pa.int32(), *_PACKED_KINDS] + 4 * [pa.binary()]

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            h1, h2, ids, keys, places = (np.concatenate(x) for x in zip(*held))
            order, least = _first_of_each(h1, h2, ids)
            own = ids[order]
            known = order[own > least]
            rows = [(row[0] % shards, *row, None, None, None, None) for row in _packed(ids[known], keys[known], places[known], buckets)]
            rest = np.sort(order[own == least])  # as they came, so that a document's ids and places stand together
            by, runs = _dealt(h1[rest], shards)
            rest = rest[by]
            for shard, a, b in runs:
                r = rest[a:b]
                rows.append((shard, None, None, None, h1[r].tobytes(), h2[r].tobytes(), np.stack([ids[r], keys[r]]).tobytes(), places[r].tobytes()))
            yield from _batches(rows, names, kinds)

        for part in slices(batches, "text"):
            w = Windows(part.column("text"), window, GRAM)
            lists = [np.frombuffer(x, np.uint64) for x in part.column("found").to_pylist()]
            of = mixed(np.arange(len(lists), dtype=np.uint64) + np.uint64(1))
            wanted = np.concatenate(lists) ^ np.repeat(of, [len(x) for x in lists])
            which = np.flatnonzero(np.isin(w.sign ^ of[w.rows], wanted)) if len(w.sign) else []
            if len(which):
                rows = w.rows[which]
                ids, keys = (np.asarray(part.column(c), np.int64)[rows] for c in ("id", "key"))
                held.append((*w.full(which), ids, keys, (w.at[which] - w.first[:-1][rows]).astype(np.uint32)))
                size += len(which)
                if size > FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def settled(data: list[list[bytes]]) -> tuple[np.ndarray, ...]:
        h1, h2 = (np.frombuffer(b"".join(x), np.uint64) for x in data[:2])
        ids, keys = np.concatenate([np.frombuffer(x, np.int64).reshape(2, -1) for x in data[2]], 1)
        places = np.frombuffer(b"".join(data[3]), np.uint32)
        order, least = _first_of_each(h1, h2, ids)
        late = order[ids[order] > least]
        return ids[late], keys[late], places[late]

    some = possibly_in(narrow, "id", signs.select("id")).where("_maybe").drop("_maybe")
    marked = some.join(signs, ["id", "key"]).select("id", "key", "text", "found")
    sent = marked.transform(mapped, picked, f"shard int, {_PACKED}, h1 binary, h2 binary, of binary, places binary").repartition(n_parts, "shard").sortWithinPartitions("shard")
    late = sent.transform(mapped, lambda batches: _answers(batches, ["h1", "h2", "of", "places"], settled, buckets), _PACKED)
    places = keep(_unpacked(late, np.uint32))
    discard(signs)
    marks = places.select("id", "key", F.col("found").alias("places"))
    split = possibly_in(base, "id", places.select("id"))
    plain = split.where("not _maybe").select("row", "text", F.lit(None).cast("binary").alias("places"))
    met = split.where("_maybe").drop("_maybe").join(marks, ["id", "key"], "left").select("row", "text", "places")
    out_schema = docs.select(F.struct(*[F.col(c) for c in stay]).alias("row")).schema.add("text", T.StringType()).add("n_words", T.LongType()).add("n_removed", T.LongType())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = buffer(part.column("text"))
            starts, ends, first = words(data, offsets)
            change = np.zeros(len(starts) + 1, np.int64)
            for i, found in enumerate(part.column("places").to_pylist()):
                if found:
                    at = first[i] + np.frombuffer(found, np.uint32).astype(np.int64)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + window, -1)
            gone = np.cumsum(change)[:-1] > 0
            n = np.diff(first)
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
            kept_starts, kept_ends = starts[~gone], ends[~gone]
            sizes = kept_ends - kept_starts + 1  # with the space before it
            after = np.cumsum(sizes)
            source = np.repeat(kept_starts - 1 - (after - sizes), sizes) + np.arange(int(after[-1]) if len(after) else 0)
            spaced = data[np.maximum(source, 0)]
            spaced[after - sizes] = 32
            left = n - removed
            bounds = np.concatenate([[0], after])[np.concatenate([[0], np.cumsum(left)])].tolist()
            raw = spaced.tobytes()
            texts = [raw[a + 1 : b].decode() for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], ["row", "text", "n_words", "n_removed"])

    done = plain.unionByName(met).transform(mapped, cut, out_schema)
    order = [F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("n_words", "n_removed")]
    return done.select(*order, "n_words", "n_removed")
