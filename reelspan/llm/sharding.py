"""Contiguous shards of near equal byte size, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import keep

#: Part of the law: a group of equal texts with more than 1/HEAVY of all bytes is dealt row by row.
HEAVY = 1024
#: Cells that the order is split into, each of which gives one total to the prefix sum: one for so many rows, HEAVY at least.
CELL_ROWS = 1 << 16


def byte_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", cells: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, shard and slot.

    Rows are ordered by (hash of the text, id), so equal texts are neighbours. Sizes are summed per cell of that order,
    the cell totals are turned into offsets, and an offset divided by the equal target names the shard: shards are contiguous
    runs of the order. A row counts as standing at the middle of its group of equal texts, so equal texts share a shard; a group
    with over 1/1024 of all bytes is cut row by row instead, whatever the number of cells, so that no group can unbalance the
    shards. No shard is off its target by more than a group of that size or one document.

    size is the UTF-8 bytes of the text plus 1. A null text counts as no bytes (size 1, crc 0) and stands with empty texts. An
    empty table gives an empty result; rows alike in every column are dealt as separate rows. Cells grow with the number of rows
    (or are given, as a power of 2 of 1024 at least), so a cell's sort does not; offsets are summed up in two levels, over 1024 runs
    of cells and within each, which bounds the one-partition window. Heavy groups are under 1024, which bounds their broadcast.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = keep(docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("h"),
    ))
    n_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(1))).first()
    heavy = rows.groupBy("h").agg(F.sum("size").alias("group_size")).where(F.col("group_size") * HEAVY > total)
    cells = cells or max(HEAVY, 1 << (n_rows // CELL_ROWS).bit_length())
    bits, run_bits = cells.bit_length() - 1, HEAVY.bit_length() - 1
    parts = F.ceil(F.col("group_size") * cells / F.lit(total))
    placed = rows.join(F.broadcast(heavy), "h", "left").select(
        "id", "size", "crc", "h",
        F.shiftrightunsigned("h", 64 - bits).alias("cell"),
        F.when(F.col("group_size").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("id", F.lit(1)), parts) + 1).cast("long").alias("part"),
    )
    sums = placed.groupBy("cell", "part").agg(F.sum("size").alias("cell_size"), F.count("*").alias("cell_rows"))
    sums = sums.withColumn("run", F.shiftright("cell", bits - run_bits))
    runs = sums.groupBy("run").agg(F.sum("cell_size").alias("run_size"), F.sum("cell_rows").alias("run_rows"))
    upto = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("run", upto("run_size", Window.orderBy("run")).alias("run_size"), upto("run_rows", Window.orderBy("run")).alias("run_rows"))
    in_run = Window.partitionBy("run").orderBy("cell", "part")
    offsets = sums.select("run", "cell", "part", upto("cell_size", in_run).alias("s"), upto("cell_rows", in_run).alias("r")).join(F.broadcast(runs), "run").select(
        "cell", "part", (F.col("run_size") + F.col("s")).alias("size_before"), (F.col("run_rows") + F.col("r")).alias("rows_before")
    )
    inside = Window.partitionBy("cell", "part").orderBy("h", "id", "size", "crc")
    group = Window.partitionBy("cell", "part", "h").orderBy("id", "size", "crc")
    at = placed.select(
        "*",
        (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"),
        F.row_number().over(inside).alias("nth"),
    ).withColumn("middle", F.when(F.col("part") == 0, 2 * F.first("start").over(group) + F.sum("size").over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).otherwise(2 * F.col("start") + F.col("size")))
    cut = keep(at.join(offsets, ["cell", "part"]).select(
        "id", "size", "crc",
        F.least(F.lit(n_shards - 1), F.floor((2 * F.col("size_before") + F.col("middle")) * n_shards / F.lit(2 * total))).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("nth") - 1).alias("place"),
    ))
    firsts = cut.groupBy("shard").agg(F.min("place").alias("first_place"))
    return cut.join(F.broadcast(firsts), "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("place") - F.col("first_place")).cast("long").alias("slot")
    )
