"""Rendezvous hashing of stable record keys over weighted shards, by DataFrame functions alone.

Every (key, shard) pair gets a uniform number u from a hash; the shard with the least ``-ln(u) / weight`` takes
the key. A shard's share follows its weight, and a shard that is added takes keys only into itself, because the
other shards' numbers do not depend on it.

Defined results: a null key is hashed as the empty text, so null keys share one shard; a null or empty text has no
bytes; rows that are equal in everything get different slots of one shard; an empty table gives an empty one. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucket_of, cuts_and_hot, documents, partitions

#: Hex digits of a digest that make a shard's number: 48 bits, exact in a double.
_DIGITS = 12
#: Parts, by the text's checksum, of a range that one doc_id fills.
_SUBRANGES = 64


def draw(key: Column, shard: int) -> Column:
    """The pair's number, uniform in (0, 1)."""
    digest = F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") + 0.5) / float(16**_DIGITS)


def _cost(key: Column, shard: int, weight: float) -> Column:
    return F.struct((-F.ln(draw(key, shard)) / F.lit(float(weight))).alias("c"), F.lit(shard).alias("i"))


def _winner(key: Column, weights: Sequence[float]) -> Column:
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("each shard needs a weight over 0")
    costs = [_cost(key, i, w) for i, w in enumerate(weights)]
    return F.least(*costs) if len(costs) > 1 else costs[0]


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, that takes the key (a text)."""
    return _winner(key, weights)["i"]


def assign_shards(docs: DataFrame, weights: Sequence[float], new_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard (with one more shard of new_weight) of every row.

    slot counts a shard's rows from 0 in ascending order of doc_id, without gaps. No shard is sorted in one
    task: ranges of doc_id are numbered each for itself, and start at the sum of the ranges before them; the table of
    sums has a row for each shard and range, however large the input. A doc_id that fills whole ranges by itself is
    cut further by its texts' checksums.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    cuts, hot = cuts_and_hot(docs.select("doc_id"), "doc_id", min(64, partitions(spark)))
    sub = F.lit(_SUBRANGES)
    for k in hot:
        sub = F.when(F.col("doc_id").eqNullSafe(F.lit(k)), F.crc32(raw) % _SUBRANGES).otherwise(sub)
    at = [bucket_of("doc_id", cuts).alias("_range"), sub.cast("int").alias("_sub")]
    best = _winner(key, weights)
    grown = F.least(best, _cost(key, len(weights), new_weight))["i"]
    rows = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), best["i"].alias("shard"), grown.alias("grown_shard"), *at)
    # the sums need the key alone: texts stay out of this pass unless a key is hot
    sums = docs.select(best["i"].alias("shard"), *at).groupBy("shard", "_range", "_sub").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_range", F.col("_sub")).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("shard", "_range", "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("shard", "_range", "_sub").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    # at most 64 ranges (and 64 parts of each that is hot) for each shard: a proven bound on what is broadcast
    return (
        rows.withColumn("_row", F.row_number().over(own))
        .join(F.broadcast(starts), ["shard", "_range", "_sub"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("_before") + F.col("_row") - 1).cast("long").alias("slot"), "grown_shard")
    )


def op9_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(documents(spark, sf_dir), [1.0] * 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


_COSTS = {n: ", ".join(f"-ln((('0x' || substr(md5(k || ':{i}'), 1, 12))::BIGINT + 0.5) / 281474976710656.0)" for i in range(n)) for n in (8, 9)}
_CRC_STEP = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
#: Of CRC-32 in SQL: common table expressions (recursive) that make its table t, and its value of a text.
CRC_CTES = f"""bits AS (SELECT range AS i, range AS c, 0 AS k FROM range(256) UNION ALL SELECT i, {_CRC_STEP}, k + 1 FROM bits WHERE k < 8),
t AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8)"""


def crc_sql(text: str) -> str:
    bytes_of = f"[('0x' || x)::BIGINT FOR x IN regexp_extract_all(hex(encode({text})), '..')]"
    return f"xor(list_reduce(list_prepend(4294967295, {bytes_of}), lambda a, b: xor(a // 256, t[(xor(a, b) % 256) + 1])), 4294967295)"


OP9_SQL = f"""
WITH RECURSIVE {CRC_CTES},
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, size, {crc_sql('text')} AS text_crc32, [{_COSTS[8]}] AS a, [{_COSTS[9]}] AS b FROM d, t),
s AS (SELECT doc_id, size, text_crc32, (list_position(a, list_min(a)) - 1)::INTEGER AS shard, (list_position(b, list_min(b)) - 1)::INTEGER AS grown_shard FROM c)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1)::BIGINT AS slot, grown_shard FROM s
"""
