"""Sharding by rendezvous hashing.

Each record key gets one pseudo-random draw per shard, and the shard with the best
weighted draw takes the record. A draw depends on the key and the shard's number only, so
a further shard takes records into itself and moves no other. All of it is column
expressions; the one shuffle carries four narrow columns to number the rows of a shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import table

#: Each shard numbers its rows in so many slices, which are windows of their own; shards
#: times slices bounds the table of slice offsets that is broadcast.
SLICES = 4096

_DRAW_BITS = 52


def _draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) that depends on the key and the shard."""
    head = F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, _DRAW_BITS // 4)
    return (F.conv(head, 16, 10).cast("double") + 0.5) / float(2**_DRAW_BITS)


def rendezvous(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """The best (score, -shard) among shards first, first+1, ..: a struct column.

    A shard of weight w scores -w / ln(draw), which gives it a share of w over all weights.
    Equal scores go to the lower shard. Weights must be positive.
    """
    if any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    scores = [
        F.struct(
            (F.lit(-float(w)) / F.ln(_draw(key, i))).alias("score"), F.lit(-i).alias("minus")
        )
        for i, w in enumerate(weights, first)
    ]
    return scores[0] if len(scores) == 1 else F.array_max(F.array(*scores))


def assign_shards(
    documents: DataFrame, weights: Sequence[float], next_weight: float = 1.0, slices: int = SLICES
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    size is the text's UTF-8 length plus 1; slot numbers a shard's rows without gaps from 0, by
    slice of the key's hash and then by doc_id. grown_shard is the shard after one more, of
    weight next_weight, has joined. A null text counts as empty. A null doc_id has no key, so
    its text is the key. Rows that repeat a doc_id share a shard and get slots of their own.
    They are numbered in one task, which sorts and spills narrow rows of some 40 bytes each, never texts.
    Other columns are not read. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(text)))
    n = len(weights)
    rows = (
        documents.select("doc_id", text.alias("text"), key.alias("key"))
        .select(
            "doc_id",
            (F.octet_length("text") + 1).cast("long").alias("size"),
            F.crc32("text").cast("long").alias("text_crc32"),
            rendezvous(F.col("key"), weights).alias("now"),
            rendezvous(F.col("key"), [next_weight], n).alias("more"),
            (F.conv(F.substring(F.md5("key"), 1, 8), 16, 10).cast("long") % slices)
            .cast("int")
            .alias("slice"),
        )
        .select(
            "doc_id",
            "size",
            "text_crc32",
            (-F.col("now.minus")).cast("int").alias("shard"),
            F.when(F.col("more.score") > F.col("now.score"), F.lit(n))
            .otherwise(-F.col("now.minus"))
            .cast("int")
            .alias("grown_shard"),
            "slice",
        )
    )
    counts = rows.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32")
    return (
        rows.withColumn("inside", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), ["shard", "slice"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("offset") + F.col("inside")).cast("long").alias("slot"),
            "grown_shard",
        )
    )


def op8_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), [1.0] * 16)


def _score_sql(shard: int) -> str:
    digits = f"('0x' || substr(md5(k || ':{shard}'), 1, 13))::BIGINT"
    return f"(-1.0 / ln(({digits}::DOUBLE + 0.5) / 4503599627370496.0))"


#: DuckDB has no CRC-32, so the SQL folds the bytes through the table of the reflected polynomial.
SQL = f"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(0, 9), lambda a, b:
      CASE WHEN b = 0 THEN a WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END, i::BIGINT) AS c
    FROM range(0, 256) r(i))
),
d AS (
  SELECT doc_id, coalesce(text, '') AS text,
    coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) AS k
  FROM documents
),
s AS (
  SELECT doc_id, k, strlen(text) + 1 AS size, hex(encode(text)) AS h,
    [{", ".join(_score_sql(i) for i in range(16))}] AS a, {_score_sql(16)} AS more
  FROM d
),
p AS (
  SELECT s.*, list_position(a, list_max(a)) - 1 AS shard,
    ('0x' || substr(md5(k), 1, 8))::BIGINT % {SLICES} AS slice,
    xor(list_reduce(range(0, (length(h) // 2)::BIGINT), lambda c, j:
      xor(c >> 8, t[(xor(c & 255, ('0x' || substr(h, 2 * j + 1, 2))::BIGINT)) + 1]), 4294967295::BIGINT),
      4294967295::BIGINT) AS text_crc32
  FROM s, crc_table
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY slice, doc_id, text_crc32) - 1 AS slot,
  (CASE WHEN more > list_max(a) THEN 16 ELSE shard END)::INT AS grown_shard
FROM p
"""
