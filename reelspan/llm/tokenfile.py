"""Token ids in files of directly addressable codes.

A file holds segments. A segment codes a run of ids in levels of one byte: level k has, for every id that needs more than k bytes,
its k-th byte and one bit that says whether it goes on; the bit's rank in its level is the id's place in the next. Ranks come
from a directory that counts the ones before every 512 bits, so any id is found from its number in a few look-ups, and any
range of ids without decoding what stands before it.

Files are Parquet, one segment to a row, because Spark's committed writers reach any store and leave one copy if a task is run
again: the columns are file, segment, before (ids of the file before this segment), n_nulls and docs (64-bit document ids; the first
n_nulls are null), ends (64-bit end of each document in the segment), n_tokens and codes (the bytes below).
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import mapped, slices
from .bpe import Encoder, byte_alphabet, check_plain

MAGIC = b"DAC1"
DIRECTORY_BITS = 512
#: Ids after which a segment ends, at the next end of a document.
SEGMENT_IDS = 1 << 18


def dac_bytes(ids: np.ndarray) -> bytes:
    """The codes of unsigned 32-bit ids: magic, count of ids and of levels; per level its size, bytes, bits and directory."""
    rest, levels = np.asarray(ids, np.uint32), []
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), DIRECTORY_BITS)) if len(more) else np.zeros(0, np.uint32)
        directory = np.concatenate([[0], np.cumsum(blocks)]).astype("<u4")
        levels.append(struct.pack("<Q", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + directory.tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            return MAGIC + struct.pack("<QB", len(ids), len(levels)) + b"".join(levels)


class Dac:
    """Reads codes in place."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a segment of token ids")
        self.n, n_levels = struct.unpack_from("<QB", raw, 4)
        self.levels, at = [], 13
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", raw, at)
            at += 8
            chunks = np.frombuffer(raw, np.uint8, n, at)
            bits = np.frombuffer(raw, np.uint8, (n + 7) // 8, at + n)
            at += n + (n + 7) // 8
            directory = np.frombuffer(raw, "<u4", -(-n // DIRECTORY_BITS) + 1, at)
            at += 4 * len(directory)
            self.levels.append((chunks, bits, directory))

    @staticmethod
    def _rank(bits: np.ndarray, directory: np.ndarray, i: int) -> int:
        """Ones before bit i."""
        block = i // DIRECTORY_BITS
        first = block * DIRECTORY_BITS // 8
        tail = np.unpackbits(bits[first : (i + 7) // 8], bitorder="little")[: i - block * DIRECTORY_BITS]
        return int(directory[block]) + int(tail.sum())

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, directory in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self._rank(bits, directory, i), shift + 8
        return value

    def range(self, a: int, b: int) -> np.ndarray:
        """Ids a to b, the latter not included, from those places of each level alone."""
        parts, spans = [], (a, b)
        for chunks, bits, directory in self.levels:
            lo, hi = spans
            more = np.unpackbits(bits[lo >> 3 : (hi + 7) >> 3], bitorder="little")[lo & 7 :][: hi - lo].astype(bool)
            parts.append((chunks[lo:hi], more))
            if not more.any():
                break
            start = self._rank(bits, directory, lo)
            spans = (start, start + int(more.sum()))
        value = np.zeros(0, np.uint32)
        for chunks, more in reversed(parts):
            own = chunks.astype(np.uint32)
            if len(value):
                own[more] |= value << np.uint32(8)
            value = own
        return value


#: Pieces that the split pattern leaves whole: Latin letters, with a space before them or not.
_PLAIN = regex.compile(r" ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+")


@lru_cache(2)
def library_encoder(path: str) -> Encoder:
    """The tokenizers library on each distinct piece between places where its split pattern always cuts.

    Plain words go to the library's model at once, all other pieces through all of its steps.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    check_plain(path)
    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    letters = {b: c for b, c in enumerate(byte_alphabet())}
    merge = tok.model.tokenize

    def encode(pieces: list[str]) -> list[bytes]:
        plain = [_PLAIN.fullmatch(p) is not None for p in pieces]
        rest = iter(tok.encode_batch_fast([p for p, one in zip(pieces, plain) if not one], add_special_tokens=False))
        return [
            array("I", [t.id for t in merge(p.encode().decode("latin-1").translate(letters))] if one else next(rest).ids).tobytes()
            for p, one in zip(pieces, plain)
        ]

    return Encoder(encode)


FILE_SCHEMA = "file long, segment long, before long, n_nulls long, docs binary, ends binary, n_tokens long, codes binary"
_NAMES = [x.split(" ")[0] for x in FILE_SCHEMA.split(", ")]
_KINDS = [pa.int64()] * 4 + [pa.binary()] * 2 + [pa.int64(), pa.binary()]


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text, appends ``end_id`` and writes all ids in ascending order of the document id.

    Documents are dealt by ranges of their id and sorted within each; a range is a file, and a file's segments end at the end of a
    document. A null or empty text has the end id alone. Ids must be integers; null ids stand before all others, and rows
    that share an id stand next to each other, in no set order. A long text is one document of one segment. An empty table writes
    no segments. Other columns are ignored.
    """
    ordered = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).repartitionByRange("doc").sortWithinPartitions("doc")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file = library_encoder(tokenizer), TaskContext.get().partitionId()
        segment, before, n_nulls, n = 0, 0, 0, 0
        ids, ends, names = [], [], []

        def done() -> pa.RecordBatch:
            docs_, ends_ = (np.concatenate(x).astype("<i8").tobytes() for x in (names, ends))
            row = (file, segment, before, n_nulls, docs_, ends_, n, dac_bytes(np.concatenate(ids)))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _KINDS)], _NAMES)

        for part in slices(batches, "text"):
            flat, stops = encode.column(part.column("text"))
            ids.append(np.insert(flat, stops, end_id))
            ends.append(n + stops + np.arange(1, len(stops) + 1))
            names.append(np.asarray(pc.fill_null(part.column("doc"), 0), np.int64))
            n_nulls += part.column("doc").null_count
            n = int(ends[-1][-1])
            if n >= SEGMENT_IDS:
                yield done()
                segment, before, n_nulls, n = segment + 1, before + n, 0, 0
                ids, ends, names = [], [], []
        if names:
            yield done()

    ordered.transform(mapped, coded, FILE_SCHEMA).write.parquet(path)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) of every document.

    A segment knows the ids before it in its file; what all files before that hold is a prefix sum with one row a file, as many
    as ranges were written, which bounds what is broadcast. Codes are read where they lie, without a shuffle.
    """
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("file_start"))
    places = rows.join(F.broadcast(files), "file").select((F.col("file_start") + F.col("before")).alias("start"), "n_nulls", "docs", "ends", "codes")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                start, n_nulls, names, ends, codes = (batch.column(c)[k].as_py() for c in ("start", "n_nulls", "docs", "ends", "codes"))
                dac, names, ends = Dac(codes), np.frombuffer(names, "<i8"), np.frombuffer(ends, "<i8")
                begins = np.concatenate([[0], ends[:-1]])
                for at in range(0, len(ends), 1024):
                    some = slice(at, at + 1024)
                    ids = [dac.range(a, b).astype("<u4").tobytes() for a, b in zip(begins[some].tolist(), ends[some].tolist())]
                    docs = pa.array(names[some], mask=np.arange(len(names))[some] < n_nulls)
                    yield pa.RecordBatch.from_arrays([docs, pa.array(begins[some] + start), pa.array((ends - begins)[some]), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return places.transform(mapped, read, "doc_id long, start long, n_tokens long, ids binary")
