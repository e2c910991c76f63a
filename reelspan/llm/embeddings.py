"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import mapped
from .components import components, local_roots
from .store import keep, partitions

#: Rows of a bucket that are compared at once; a larger bucket is dealt out as pairs of blocks of this size.
BLOCK = 256
#: Chance of missing a pair that is just at the threshold.
MISS = 1e-8
#: Mean number of unrelated rows that a bucket may hold.
COMPANY = 4


def tables_for(n: int, cosine: float) -> tuple[int, int]:
    """Sign bits a table for n vectors, and tables: the bits grow with log n, the tables keep the chance of a miss."""
    bits = min(30, max(6, math.ceil(math.log2(max(n, 2) / COMPANY))))
    same = 1 - math.acos(cosine) / math.pi
    return bits, math.ceil(math.log(MISS) / math.log1p(-(same**bits)))


def apart_for(cosine: float, bits: int = 64) -> int:
    """Most sign bits, of ``bits`` more, in which vectors at the threshold differ but for a chance of ``MISS``."""
    differ = math.acos(cosine) / math.pi
    beyond, most = 1.0, -1
    while beyond > MISS:
        most += 1
        beyond -= math.comb(bits, most) * differ**most * (1 - differ) ** (bits - most)
    return most


def _planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng(20240607 + dim).standard_normal((dim, bits * tables))


def _sketch(x: np.ndarray) -> np.ndarray:
    """64 sign bits of each row, by planes of their own."""
    signs = x @ np.random.default_rng(977 + x.shape[1]).standard_normal((x.shape[1], 64)) > 0
    return np.packbits(signs, 1).view(np.int64).ravel()


def _keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    signs = (x @ _planes(x.shape[1], bits, tables) > 0).reshape(len(x), tables, bits)
    return (signs.astype(np.int32) << np.arange(bits, dtype=np.int32)).sum(2, dtype=np.int32)


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<f8").reshape(len(col), -1)


def _meetings(group: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all that meet, of rows sorted by group: in a pair of two blocks only rows of different blocks."""
    d = 1
    while True:
        a = np.flatnonzero(group[:-d] == group[d:]) if d < len(group) else np.zeros(0, np.int64)
        if not len(a):
            return
        a = a[(side[a] != side[a + d]) | (side[a] == 2)]
        yield from ((x, x + d) for x in (a[i : i + 65536] for i in range(0, len(a), 65536)))
        d += 1


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that are sorted by group, in tables that no group is cut by."""
    held: list[pa.RecordBatch] = []
    for whole in batches:
        for batch in (whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096)):
            # all but the last group of what is held can be done
            held.append(batch)
            table = pa.Table.from_batches(held)
            group = table.column("group").to_numpy()
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _compare(rows: dict[str, np.ndarray], cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row numbers that link, of rows sorted by group; a pair that an earlier table holds too is left to that table."""
    x, keys, table = rows["x"], rows["keys"], rows["table"]
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in _meetings(rows["group"], rows["side"]):
        hit = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
        a, b = a[hit], b[hit]
        if len(a):
            mine = (keys[a] == keys[b]).argmax(1) == table[a]
            found_a.append(a[mine])
            found_b.append(b[mine])
    return np.concatenate(found_a), np.concatenate(found_b)


def near_vectors(rows: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``rows``: id, n_links (other rows linked directly), component_id (least id reachable) and kept.

    Rows link if their labels are equal and not null and the cosine of their vectors, in double precision, is at least ``cosine``.
    Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing; vectors of different length do not link.
    Equal vectors with one label are one class from the start and count as many links as they are. Every other pair at the
    threshold shares a table's sign bits but for a chance of 1e-8 and is then confirmed by its cosine. Rows of a bucket are first
    compared by 64 sign bits of other planes, and only those that are near enough in these to any other (again but for 1e-8) have
    their vectors fetched. Buckets of more than 256 rows are compared in pairs of blocks spread over tasks; links are counted where they are found and only spanning edges leave a
    block, so neither pairs nor groups are gathered. Ids are integers; a null id is kept as a row without links. Rows that share an id
    and a vector are separate rows. An empty table gives an empty result.
    """
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = F.coalesce(fine, F.lit(False))
    # -0.0 counts as 0.0
    marked = keep(base.select("id", "label", valid.alias("ok"), F.when(valid, F.transform("v", lambda x: x + F.lit(0.0))).alias("v")))
    key = F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256)
    named = keep(marked.select("id", "label", "ok", F.when(F.col("ok"), key).alias("vkey"), "v"))
    classes = keep(named.where("ok").groupBy("label", "vkey").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")))
    n = classes.count()
    bits, tables = tables_for(n, cosine)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in (whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096)):
                sizes = np.asarray(part.column("v").value_lengths())
                flat, begin = np.asarray(part.column("v").flatten(), np.float64), np.cumsum(sizes) - sizes
                keys, units, sketch = [b""] * len(sizes), [b""] * len(sizes), np.zeros(len(sizes), np.int64)
                for dim in np.unique(sizes):
                    mine = np.flatnonzero(sizes == dim)
                    x = flat[begin[mine][:, None] + np.arange(dim)]
                    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the norm
                    x /= np.sqrt((x * x).sum(1, keepdims=True))
                    sketch[mine] = _sketch(x)
                    for i, k, u in zip(mine.tolist(), _keys(x, bits, int(tables)), x):
                        keys[i], units[i] = k.astype("<i4").tobytes(), u.astype("<f8").tobytes()
                yield pa.RecordBatch.from_arrays([part.column("label"), part.column("rep"), part.column("n"), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), pa.array(units, pa.binary()), pa.array(sketch)], ["label", "rep", "n", "dim", "keys", "x", "sketch"])

    signs = keep(classes.select("label", "rep", "n", "v").transform(mapped, signed, "label string, rep long, n long, dim int, keys binary, x binary, sketch long"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keys = np.frombuffer(b"".join(part.column("keys").to_pylist()), "<i4")
            times = np.repeat(np.arange(part.num_rows), tables)
            yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(times)) for c in ("label", "dim", "rep", "sketch")] + [pa.array(np.tile(np.arange(tables, dtype=np.int32), part.num_rows)), pa.array(keys)], ["label", "dim", "rep", "sketch", "tab", "bits"])

    cells = ["label", "dim", "tab", "bits"]
    placed = signs.select("label", "dim", "rep", "sketch", "keys").transform(mapped, spread, "label string, dim int, rep long, sketch long, tab int, bits int")
    placed = keep(placed)
    crowded = keep(placed.groupBy(*cells).agg(F.count("*").alias("size")).where("size > 1"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep", F.lit(5)), blocks).cast("int")
    seated = placed.join(crowded, cells).select(*cells, "rep", "sketch", blocks.alias("blocks"), own.alias("own"))
    # a block meets itself (side 2) and every other block (sides 0 and 1)
    dealt = seated.select(*cells, "rep", "sketch", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        F.xxhash64(*cells, F.least("own", "other"), F.greatest("own", "other")).alias("group"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), "tab", "rep", "sketch",
    )
    n_parts, apart = max(partitions(rows.sparkSession), 1), apart_for(cosine)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            sketch, some = table.column("sketch").to_numpy(), np.zeros(table.num_rows, bool)
            for a, b in _meetings(table.column("group").to_numpy(), table.column("side").to_numpy()):
                hit = np.bitwise_count((sketch[a] ^ sketch[b]).view(np.uint64)) <= apart
                some[a[hit]] = some[b[hit]] = True
            yield from table.filter(pa.array(some)).select(["group", "side", "tab", "rep"]).combine_chunks().to_batches()

    met = dealt.repartition(n_parts, "group").sortWithinPartitions("group").transform(mapped, near, "group long, side int, tab int, rep long")
    full = keep(met).join(signs, "rep").select("group", "side", "tab", "rep", "n", "keys", "x").repartition(n_parts, "group").sortWithinPartitions("group")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(table: pa.Table) -> pa.RecordBatch:
            get = lambda c: table.column(c).to_numpy()
            chunk = table.combine_chunks()
            rep, count = get("rep"), get("n")
            raw = [np.frombuffer(b, "<f8") for b in chunk.column("x").to_pylist()]
            width = max(map(len, raw))
            x = np.zeros((len(raw), width))
            for i, r in enumerate(raw):
                x[i, : len(r)] = r
            keys = np.frombuffer(b"".join(chunk.column("keys").to_pylist()), "<i4").reshape(-1, tables)
            a, b = _compare({"group": get("group"), "side": get("side"), "x": x, "keys": keys, "table": get("tab")}, cosine)
            links = np.bincount(a, count[b], len(rep)) + np.bincount(b, count[a], len(rep))
            nodes, at = np.unique(rep, return_inverse=True)
            root = local_roots(at[a], at[b], len(nodes))
            total = np.bincount(at, links, len(nodes)).astype(np.int64)
            some = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(total[some]), pa.array(nodes[root[some]])], ["rep", "links", "root"])

        yield from map(work, _whole_groups(batches))

    hits = keep(full.transform(mapped, linked, "rep long, links long, root long"))
    found = components(hits.where("rep <> root").select(F.col("rep").alias("u"), F.col("root").alias("v")))
    counts = hits.groupBy("rep").agg(F.sum("links").alias("links"))
    result = keep(classes.select("label", "vkey", "rep", "n").join(counts, "rep", "left").join(found, F.col("rep") == found["node"], "left").select(
        "label", "vkey", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    ))
    out = named.select("id", "label", "vkey").alias("a").join(result.alias("b"), (F.col("a.label") == F.col("b.label")) & (F.col("a.vkey") == F.col("b.vkey")), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
