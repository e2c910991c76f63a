"""The registered queries of this subpackage: thin digests of the operators' results over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import uuid

from .bpe import bpe_decode, bpe_encode
from .embeddings import near_vectors
from .flac import from_flac, to_flac
from .hyperminhash import near_duplicates
from .licenses import license_notices
from .mixing import mix
from .quality import quality
from .sharding import byte_shards
from .store import shared_dir, table
from .substrings import drop_repeats
from .tokenfile import read_token_file, write_token_file


def tokenizer_file() -> str:
    """The vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(table(spark, sf_dir, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_file(table(spark, sf_dir, "documents"), path, tokenizer_file())
    return read_token_file(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_notices(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("notices").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct("notices.license")), ",").alias("licenses"),
        F.size(F.filter("notices", lambda n: n["n_differences"] == 0)).cast("long").alias("n_exact"),
        F.aggregate("notices", F.lit(0).cast("long"), lambda a, n: a + n["n_differences"]).alias("n_differences"),
        F.aggregate("notices", F.lit(0).cast("long"), lambda a, n: a + n["saved_bytes"]).alias("saved_bytes"),
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file())
    return bpe_decode(coded, tokenizer_file()).select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_flac(to_flac(table(spark, sf_dir, "documents").select("doc_id", "text"))).select(
        "doc_id", "n_bytes",
        F.octet_length("pcm").cast("long").alias("payload_bytes"),
        F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pcm, -64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(*(x for c in ("peak", "energy", "crossings") for x in (F.lit(f"{c}="), F.col(c).cast("string"), F.lit(" "))), F.lit("frames="), F.size("blocks").cast("string")).alias("feature"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op10_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def shards_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the shards of op1 must keep to, over all documents: slots without gaps, near equal bytes, light groups of texts together."""
    docs = table(spark, sf_dir, "documents")
    dealt = byte_shards(docs, 16).join(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")), "doc_id")
    shards = dealt.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("longest"), F.count_distinct("slot").alias("slots"), F.min("slot").alias("low"), F.max("slot").alias("high"))
    total = shards.agg(F.sum("n").alias("n_rows"), F.sum("bytes").alias("n_bytes"), F.max("longest").alias("longest"), F.bool_and((F.col("slots") == F.col("n")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1)).alias("gapless"), F.max("bytes").alias("most"), F.min("bytes").alias("least"))
    groups = dealt.groupBy("h").agg(F.sum("size").alias("bytes"), F.count_distinct("shard").alias("n")).agg(F.min(F.when(F.col("n") > 1, F.col("bytes"))).alias("split"))
    both = total.unionByName(groups, allowMissingColumns=True)
    both = both.agg(*(F.max(c).alias(c) for c in both.columns))  # one row of each
    near = F.col("longest") + F.col("n_bytes") / 1024
    even = (F.col("most") - F.col("n_bytes") / 16 <= near) & (F.col("n_bytes") / 16 - F.col("least") <= near)
    light = F.coalesce(F.col("split") * 1024 > F.col("n_bytes"), F.lit(True))  # the lightest group that is not in one shard
    return both.select("n_rows", "n_bytes", "gapless", even.alias("even"), light.alias("together"))


def mix_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of op9 must keep to, by source: its target, and words taken that are near it."""
    by = op9_mixing(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").groupBy("source", "source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("longest"), F.bool_and(F.col("taken") <= 3 * F.col("size")).alias("capped"))
    near = F.abs(F.col("taken") - F.col("target")) <= F.col("longest") / 2 + 1
    return by.select("source", "source_size", F.round("target", 3).alias("target"), near.alias("near"), "capped")


def flac_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that do not depend on how FLAC is coded."""
    return op8_flac(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


QUERIES = {"op10_hyperminhash": op10_hyperminhash, "op1_sharding": op1_sharding, "op2_quality": op2_quality, "op3_substrings": op3_substrings, "op4_embeddings": op4_embeddings, "op5_token_file": op5_token_file, "op6_licenses": op6_licenses, "op7_bpe": op7_bpe, "op8_flac": op8_flac, "op9_mixing": op9_mixing}
QUERIES |= {"shards_law": shards_law, "mix_law": mix_law, "flac_payload": flac_payload}
#: The cosine is taken from dot products over all pairs of a label: for the small tables of a comparison only.
OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS u, vec_id AS w FROM v UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u
), least AS (
  SELECT u, min(w) AS component_id FROM reach GROUP BY u
), n AS (
  SELECT u, count(*) AS n_links FROM links GROUP BY u
)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, least.component_id, v.vec_id = least.component_id AS kept
FROM v JOIN least ON least.u = v.vec_id LEFT JOIN n ON n.u = v.vec_id
"""

#: Every shingle that two documents share is counted: for small tables only.
OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 3 THEN [array_to_string(l, ' ')]
    ELSE list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2]) END) AS x FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT u, v FROM shared JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)
), both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reach r JOIN both_ways l ON r.v = l.u
), least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least ON least.u = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents
), k AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM w
), win AS (
  SELECT doc_id, i, md5(array_to_string(l[i : i + 49], ' ')) AS h FROM (SELECT doc_id, l, unnest(range(1, len(l) - 48)) AS i FROM w)
), late AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first FROM win) WHERE first < doc_id
), marked AS (
  SELECT k.doc_id, k.i, k.word, max(CASE WHEN late.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY k.doc_id ORDER BY k.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM k LEFT JOIN late ON late.doc_id = k.doc_id AND late.i = k.i
), cut AS (SELECT doc_id, count(*) AS n, sum(gone) AS g, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS t FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(g, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents d LEFT JOIN cut USING (doc_id)
"""

SHARDS_SQL = "SELECT count(*) AS n_rows, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS n_bytes, true AS gapless, true AS even, true AS together FROM documents"

MIX_SQL = r"""
WITH s AS (
  SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS source_size FROM documents GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM s
), w AS (
  SELECT *, ([5, 2, 1][nth % 3 + 1])::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM r
), o AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM w
), level AS (SELECT arg_min(rest / open_weight, cap / weight) AS t FROM o WHERE cap * open_weight > rest * weight)
SELECT source, source_size, round(CASE WHEN t IS NULL THEN cap ELSE least(cap, weight * t) END, 3) AS target, true AS near, true AS capped FROM o, level
"""

FLAC_SQL = """
WITH p AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, strlen(coalesce(text, ''))::BIGINT AS n FROM documents), q AS (SELECT *, greatest(64, (n + 63) // 64 * 64) AS full_size FROM p)
SELECT doc_id, n AS n_bytes, full_size AS payload_bytes, sha256(raw || unhex(repeat('00', (full_size - n)::BIGINT))) AS payload_sha256 FROM q
"""

ORACLES: dict[str, str] = {"shards_law": SHARDS_SQL, "mix_law": MIX_SQL, "flac_payload": FLAC_SQL, "op3_substrings": OP3_SQL, "op4_embeddings": OP4_SQL, "op10_hyperminhash": OP10_SQL}
