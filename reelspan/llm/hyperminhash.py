"""Near duplicates by HyperMinHash: banded registers, corrected estimates, exact confirmation, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import buffer, mapped, mixed, slices, spans_hash, word_hashes, words
from .components import components
from .store import discard, keep, partitions, possibly_in

MANTISSA = 10
#: Open buckets of up to this many members pair them; larger ones are compared in blocks of so many rows and shingles at most, on average.
SMALL, BLOCK, BLOCK_SHINGLES = 32, 512, 1 << 18
#: Meetings of equal shingles that are counted at once.
_MEETINGS = 1 << 20
#: Chance of missing a pair that is just at the threshold.
MISS = 1e-7


def bands_for(threshold: float, registers: int = 320) -> tuple[int, int]:
    """Bands and registers a band: the longest bands for which enough of them fit."""
    fits = [(math.ceil(math.log(MISS) / math.log1p(-(threshold**r))), r) for r in range(1, 16)]
    return max((x for x in fits if x[0] * x[1] <= registers), key=lambda x: x[1])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(col: pa.Array, width: int) -> list[np.ndarray]:
    """Each row's distinct shingle hashes, sorted; a row of fewer words has its whole sequence as one, a row of none has none."""
    data, offsets = buffer(col)
    starts, ends, first = words(_LOWER[data], offsets)
    values = word_hashes(_LOWER[data], starts, ends)
    counts = np.diff(first)
    n = np.where(counts == 0, 0, np.maximum(1, counts - width + 1))
    after = np.cumsum(n)
    begin = np.repeat(first[:-1] - (after - n), n) + np.arange(after[-1] if len(n) else 0)
    hashes = spans_hash(values, begin, begin + np.repeat(np.minimum(counts, width), n))
    return [np.unique(h) for h in np.split(hashes, after[:-1])] if len(n) else []


class Sketcher:
    """Registers of shingle sets: by bucket, the leading zeros of the least hash and the bits that follow."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.m = bands, rows, bands * rows
        grid = mixed(np.arange(self.m * self.m, dtype=np.uint64) + np.uint64(977)).reshape(self.m, self.m)
        self.order = grid >> np.uint64(32)
        self.seeds = mixed(np.arange(self.bands, dtype=np.uint64) + np.uint64(31))

    def registers(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(self.m, np.iinfo(np.uint64).max, np.uint64)
        bucket = ((hashes >> np.uint64(32)) * np.uint64(self.m) >> np.uint64(32)).astype(np.int64)
        value = mixed(hashes ^ np.uint64(0x5851F42D4C957F2D))
        np.minimum.at(least, bucket, value)
        zeros = 64 - np.frexp((least >> np.uint64(11)).astype(np.float64))[1] - 11
        mantissa = (least << np.minimum(zeros + 1, 63).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
        out = (zeros.astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
        full = np.zeros(self.m, bool)
        full[bucket] = True
        if not full.all():  # an empty bucket takes the register of a full one, the same one for sets that have the same full ones
            at, empty = np.flatnonzero(full), np.flatnonzero(~full)
            out[empty] = out[at[self.order[np.ix_(empty, at)].argmin(1)]]
        return out

    def band_keys(self, registers: np.ndarray) -> np.ndarray:
        """For rows of registers: one 64-bit key a band."""
        key = np.broadcast_to(self.seeds, (len(registers), self.bands)).copy()
        parts = registers.reshape(len(registers), self.bands, self.rows)
        for i in range(self.rows):
            key = mixed(key ^ (parts[:, :, i].astype(np.uint64) + np.uint64(i << 20)))
        return key.astype(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> float:
    """Jaccard similarity from two rows of registers, less the matches that chance alone would give."""
    m = len(a)

    def spread(n: int) -> np.ndarray:
        edges = np.exp(-max(n, 1) / m * 2.0 ** -np.arange(33))
        return np.diff(edges)

    chance = float((spread(n_a) * spread(n_b)).sum()) / 2**MANTISSA
    return (float((a == b).mean()) - chance) / (1 - chance)


def _sketch(docs: DataFrame, width: int, sketcher: Sketcher) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text"), width)
            none = b""
            sums = [(int(s.sum() & np.uint64(2**63 - 1)), int(mixed(s).sum() & np.uint64(2**63 - 1))) if len(s) else (0, 0) for s in sets]
            regs = [sketcher.registers(s).tobytes() if len(s) else none for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*sums)), pa.array(regs, pa.binary())],
                ["id", "n", "d1", "d2", "regs"],
            )

    return docs.transform(mapped, work, "id long, n long, d1 long, d2 long, regs binary")


def _banded(reps: DataFrame, sketcher: Sketcher) -> DataFrame:
    """(key, id, n) for every band."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                keys = sketcher.band_keys(np.stack([np.frombuffer(r, np.uint16) for r in part.column("regs").to_pylist()]))
                each = lambda c: pa.array(np.repeat(np.asarray(part.column(c), np.int64), keys.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), each("id"), each("n")], ["key", "id", "n"])

    return reps.select("id", "n", "regs").transform(mapped, work, "key long, id long, n long")


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every set of ``b``."""
    out = np.zeros((len(a), len(b)), np.int64)
    tokens = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    if not len(tokens):
        return out

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate(sets)
        at = np.searchsorted(tokens, flat)
        at[at == len(tokens)] = 0
        own = tokens[at] == flat
        order = np.argsort(at[own], kind="stable")
        return at[own][order], row[own][order], np.bincount(at[own], minlength=len(tokens))

    (ta, ra, ca), (tb, rb, cb) = places(a), places(b)
    frequent = ca * cb * 64 >= out.size
    wide = np.flatnonzero(frequent)
    number = np.cumsum(frequent) - 1
    for i in range(0, len(wide), 2048):  # words that many rows share: a product of 0/1 matrices
        n = min(2048, len(wide) - i)
        x, y = np.zeros((len(a), n), np.float32), np.zeros((len(b), n), np.float32)
        for m, t, r in ((x, ta, ra), (y, tb, rb)):
            mine = frequent[t] & (number[t] >= i) & (number[t] < i + n)
            m[r[mine], number[t[mine]] - i] = 1
        out += (x @ y.T).astype(np.int64)
    rare = ~frequent  # all others: their pairs, counted
    first_b = np.cumsum(cb) - cb
    mine = np.flatnonzero(rare[ta])
    upto = np.cumsum(cb[ta[mine]])
    cuts = [0, *np.searchsorted(upto, np.arange(_MEETINGS, upto[-1], _MEETINGS)).tolist(), len(mine)] if len(mine) else [0]
    for part in (mine[i:j] for i, j in zip(cuts, cuts[1:]) if j > i):
        times = cb[ta[part]]
        after = np.cumsum(times)
        pick = np.repeat(first_b[ta[part]] - (after - times), times) + np.arange(int(after[-1]))
        out += np.bincount(np.repeat(ra[part], times) * len(b) + rb[pick], minlength=out.size).reshape(out.shape)
    return out


def _block_links(members: DataFrame, sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """Links between components of each group, of (grp, id, comp): outsiders of the group's largest component with all members.

    Rows are dealt by hash to blocks of bounded rows and shingles, and every block of outsiders meets every block of members on its
    own. Only edges that join components leave it, a spanning set of them.
    """
    met = members.join(sets.select("id", "n"), "id")
    sizes = keep(met.groupBy("grp", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s")))
    blocks = lambda rows, shingles: F.greatest(F.ceil(rows / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")
    tally = keep(sizes.groupBy("grp").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.max(F.struct("c", "comp", "s")).alias("top")).select(
        "grp", F.col("top.comp").alias("main"), blocks(F.col("c"), F.col("s")).alias("blocks"), blocks(F.col("c") - F.col("top.c"), F.col("s") - F.col("top.s")).alias("outer")
    ).where("outer > 0"))
    met = members.join(tally, "grp").select("*", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int").alias("b"), F.pmod(F.xxhash64("id", F.lit(8)), F.col("outer")).cast("int").alias("o"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    inner = met.select("grp", "id", "comp", "b", upto("outer").alias("o"), F.lit(0).alias("side"))
    outer = met.where("comp <> main").select("grp", "id", "comp", upto("blocks").alias("b"), "o", F.lit(1).alias("side"))
    dealt = inner.unionByName(outer).select(F.xxhash64("grp", "b", "o").alias("task"), "side", "id", "comp")
    full = dealt.join(sets.select("id", "n", "hashes"), "id").repartition(parts, "task").sortWithinPartitions("task")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(rows: list[tuple]) -> pa.RecordBatch:
            sides = [[r for r in rows if r[1] == k] for k in (0, 1)]
            edges = np.zeros((0, 2), np.int64)
            if all(sides):
                (ids_a, comp_a, n_a), (ids_b, comp_b, n_b) = ([np.array([r[i] for r in side], np.int64) for i in (2, 3, 4)] for side in sides)
                common = _common(*([np.frombuffer(r[5], np.uint64) for r in side] for side in sides))
                near = (100 * common >= percent * (n_a[:, None] + n_b[None, :] - common)) & (comp_a[:, None] != comp_b[None, :])
                i, j = np.nonzero(near)
                # one edge for each pair of components
                _, first = np.unique(np.stack([comp_a[i], comp_b[j]], 1), axis=0, return_index=True) if len(i) else (None, np.zeros(0, np.int64))
                edges = np.stack([ids_a[i[first]], ids_b[j[first]]], 1)
            return pa.RecordBatch.from_arrays([pa.array(edges.min(1)), pa.array(edges.max(1))], ["u", "v"])

        task, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("task", "side", "id", "comp", "n", "hashes"))):
                if row[0] != task:
                    if held:
                        yield work(held)
                    task, held = row[0], []
                held.append(row)
        if held:
            yield work(held)

    return full.select("task", "side", "id", "comp", "n", "hashes").transform(mapped, linked, "u long, v long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (u, v), those whose sets are similar enough: first by the corrected estimate, then by the sets."""
    side = lambda c: sets.select(F.col("id").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "regs", "hashes")))
    met = pairs.select("u", "v").join(side("v"), "v").join(side("u"), "u").where(
        (F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent)
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for whole in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                for i, (n_a, n_b, a, b, x, y) in enumerate(zip(*(whole.column(c).to_pylist() for c in ("n_u", "n_v", "regs_u", "regs_v", "hashes_u", "hashes_v")))):
                    a, b = np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16)
                    if estimate(a, b, n_a, n_b) < percent / 100 - 3.0 / math.sqrt(min(n_a, n_b, len(a))):
                        continue
                    common = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                    if 100 * common >= percent * (n_a + n_b - common):
                        good.append((whole["u"][i].as_py(), whole["v"][i].as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in good], pa.int64()) for k in (0, 1)], ["u", "v"])

    return met.select("u", "v", "n_u", "n_v", "regs_u", "regs_v", "hashes_u", "hashes_v").transform(mapped, work, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (least id that links reach, itself included) and kept.

    Rows link if 100 * |intersection| >= percent * |union| of their distinct ``width``-word shingles (A-Z lower-cased, words
    between spaces and bytes 9 to 13). Rows of fewer words have their whole sequence as one shingle; rows without words, and null
    texts, have none, link with nothing and are kept. Rows with equal sets are one class from the start, so copies are never
    paired. Shingles are held as 64-bit hashes.

    Registers are banded so that a pair at the threshold meets in a band but for a chance of 1e-7. First every row meets the one
    row that it shares most bands with, of those that are the least of a bucket, so that large groups join in a few comparisons a
    row. Then every bucket that still has several components is settled exactly: small ones pair their members, as far as their
    sizes can be similar; groups of overlapping larger ones compare all rows outside their largest component with all rows, in
    blocks, and only edges between components leave a block. No bucket is capped, and nothing is collected.

    Ids must be integers; a null id is dropped from links but kept as a row; rows that share an id share its component. An empty
    table gives an empty result.
    """
    bands, rows = bands_for(percent / 100)
    sketcher = Sketcher(bands, rows)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched = keep(_sketch(source, width, sketcher))
    linked = sketched.where("n > 0 and id is not null")
    rows_of = keep(sketched.select("id", "n", "d1", "d2"))
    reps = keep(linked.groupBy("n", "d1", "d2").agg(F.min("id").alias("id"), F.min_by("regs", "id").alias("regs")))
    discard(sketched)
    keyed = keep(_banded(reps, sketcher))
    shared = keep(keyed.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("id", "n")).alias("pivot")).where("size > 1"))
    members = keep(keyed.join(shared, "key").select("key", "id", "n", F.col("pivot.id").alias("pivot"), F.col("pivot.n").alias("pivot_n"), "size"))
    discard(keyed)
    used = members.select("id").distinct()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = [s.tobytes() for s in shingle_sets(part.column("text"), width)]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], ["id", "hashes"])

    wanted = possibly_in(source, "id", keep(used)).where("_maybe").select("id", "text")
    sets = keep(wanted.transform(mapped, hashed, "id long, hashes binary").join(reps.select("id", "n", "regs"), "id"))
    alike = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent

    # the pivot that each row shares most bands with, of those that it can be similar to
    offers = members.where((F.col("id") != F.col("pivot")) & alike(F.col("n"), F.col("pivot_n"))).groupBy("id", "pivot").agg(F.count("*").alias("bands"))
    best = offers.groupBy("id").agg(F.max(F.struct("bands", (-F.col("pivot")).alias("p"))).alias("best")).select((-F.col("best.p")).alias("u"), F.col("id").alias("v"))
    edges = keep(_confirmed(keep(best), sets, percent))
    found = keep(components(edges))

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(found, rows["id"] == found["node"], "left").withColumn("comp", F.coalesce("component", "id")).drop("node", "component")

    left = keep(labelled(members.select("key", "id", "n", "size")))
    open_ = keep(left.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("key"))
    left = keep(left.join(open_, "key"))
    small = left.where(F.col("size") <= SMALL)
    a, b = small.alias("a"), small.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.comp") != F.col("b.comp")) & alike(F.col("a.n"), F.col("b.n"))).select(F.col("a.id").alias("u"), F.col("b.id").alias("v")).distinct()
    edges = edges.unionByName(keep(_confirmed(keep(pairs), sets, percent)))
    large = keep(left.where(F.col("size") > SMALL).select("key", "id"))
    if large.take(1):
        heads = keep(large.groupBy("key").agg(F.min("id").alias("v")))
        groups = keep(components(large.join(heads, "key").select(F.col("id").alias("u"), "v").where("u <> v").distinct()))
        crowd = keep(labelled(groups.select(F.col("node").alias("id"), F.col("component").alias("grp"))))
        edges = edges.unionByName(keep(_block_links(crowd, sets, percent, partitions(docs.sparkSession))))
    found = keep(components(edges))
    classes = keep(reps.join(found, reps["id"] == found["node"], "left").select("n", "d1", "d2", F.coalesce("component", "id").alias("component_id")))
    base = rows_of.alias("s")
    out = base.join(classes.alias("c"), (F.col("s.n") == F.col("c.n")) & (F.col("s.d1") == F.col("c.d1")) & (F.col("s.d2") == F.col("c.d2")) & F.col("s.id").isNotNull(), "left")
    component = F.coalesce("component_id", "s.id")
    return out.select(F.col("s.id").alias(id_col), F.col("s.n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("s.id"), F.lit(True)).alias("kept"))
