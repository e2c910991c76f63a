"""Reading input tables and keeping intermediate tables where every executor can reach them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a table that ``keep`` wrote, once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/kept-" in path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


#: Bits of a membership map, which bound what is broadcast: 2**26, 8 MB, in parts of 2**15.
MAP_BITS, PART_BITS = 26, 15


def possibly_in(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """``rows`` with ``_maybe``: false only if the column's value is surely not in the one column of ``ids``.

    A hashed bitmap is broadcast whole, of the same size for any input, so that what cannot match need not be shuffled to meet a
    join; a join of the rest makes the answer exact. Null is never in.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << MAP_BITS))
    own = ids.columns[0]
    maps = ids.where(F.col(own).isNotNull()).select(place(own).alias("p")).groupBy(F.shiftright("p", PART_BITS).alias("_part")).agg(
        F.bitmap_construct_agg(F.col("p").bitwiseAND((1 << PART_BITS) - 1)).alias("_bits")
    )
    every = ids.sparkSession.range(0, 1 << (MAP_BITS - PART_BITS), 1, 1).select(F.col("id").alias("_part"))
    maps = every.join(maps, "_part", "left").select("_part", F.coalesce("_bits", F.lit(bytes(1 << (PART_BITS - 3)))).alias("_bits"))
    at = place(column).bitwiseAND((1 << PART_BITS) - 1)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1
    joined = rows.withColumn("_part", F.shiftright(place(column), PART_BITS)).join(F.broadcast(maps), "_part", "left")
    return joined.withColumn("_maybe", F.coalesce(there & F.col(column).isNotNull(), F.lit(False))).select(*rows.columns, "_maybe")


def without(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose value is not in the one column of ``ids``; only rows that may be in it are shuffled."""
    marked = possibly_in(rows, column, ids)
    maybe = marked.where("_maybe").drop("_maybe").join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_anti").select(*rows.columns)
    return marked.where("not _maybe").drop("_maybe").unionByName(maybe)


def within(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose value is in the one column of ``ids``; values alone are shuffled to find what a map lets through wrongly."""
    maybe = possibly_in(rows, column, ids).where("_maybe").drop("_maybe")
    wrong = keep(maybe.select(column).join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_anti").distinct())
    return without(maybe, column, wrong)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text):
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a string column; 0 for null."""
    marked = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w")
    return F.coalesce(F.length(F.regexp_replace(marked, r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")
