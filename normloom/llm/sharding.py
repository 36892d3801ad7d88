"""Jump consistent hashing: stable keys to shards without a ring table, with a gapless slot in each shard.

Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normloom.llm.shared import column, packed, unpacked

#: Rows that one ordered numbering group should hold; more rows make more groups, not larger ones.
ROWS_PER_BUCKET = 10_000


def jump_hash(key: Column, shards: int) -> Column:
    """Struct ``shard, grown``: the bucket of ``key`` among ``shards`` and among ``shards + 1``.

    The jump sequence draws its i-th pseudo-random number as the upper 31 bits of
    ``xxhash64(key, i)``. Each jump goes strictly forward, so ``shards`` steps always suffice;
    a step beyond the end changes nothing. The state that leaves the loop is the last bucket
    below ``shards`` and the next jump, which tells whether one more shard would take the row.
    """
    start = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))

    def step(state: Column, i: Column) -> Column:
        draw = F.shiftrightunsigned(F.xxhash64(key, i), 33)
        jump = F.floor((state["next"] + 1) * (F.lit(2147483648.0) / (draw + 1)))
        moved = F.struct(state["next"].alias("at"), jump.cast("long").alias("next"))
        return F.when(state["next"] < shards, moved).otherwise(state)

    def result(state: Column) -> Column:
        shard = state["at"].cast("int")
        return F.struct(shard.alias("shard"), F.when(state["next"] == shards, F.lit(shards)).otherwise(shard).alias("grown"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, result)


def assign_shards(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``docs`` plus ``size, text_crc32, law, shard, slot, grown_shard``.

    The key and the shard count alone decide the shard (law ``key``); ``grown_shard`` is the shard
    when one more is appended. ``slot`` numbers the rows of a shard from 0 without gaps: rows are
    dealt to buckets inside their shard by a hash of the whole identity, numbered there in order of
    key, checksum and size, and shifted by the sizes of the buckets before. Rows that agree in all three are
    interchangeable. A null text counts as empty (size 16, checksum 0); null keys share a shard.
    An empty table gives an empty result. Added columns replace input columns of the same names.
    """
    content = F.coalesce(column(text), F.lit(""))
    ident = docs.select(column(key).alias("key"), F.crc32(content).alias("crc"))
    buckets = max(1, math.ceil(docs.count() / (shards * rows_per_bucket)))

    def dealt(df: DataFrame) -> DataFrame:
        jump = jump_hash(F.col("key"), shards)
        return df.withColumn("jump", jump).withColumn("bucket", F.pmod(F.xxhash64("key", "crc"), F.lit(buckets)).cast("int"))

    sizes = dealt(ident).groupBy(F.col("jump.shard").alias("shard"), "bucket").agg(F.count("*").alias("rows"))
    before = sizes.selectExpr("shard", "bucket", "sum(rows) over (partition by shard order by bucket rows between unbounded preceding and current row) - rows as before")
    rows = dealt(packed(docs, key=column(key), crc=F.crc32(content), bytes=F.octet_length(content).cast("long") + 16))
    rows = rows.select("row", "key", "crc", "bytes", F.col("jump.shard").alias("shard"), F.col("jump.grown").alias("grown"), "bucket")
    rows = rows.selectExpr("*", "row_number() over (partition by shard, bucket order by key, crc, bytes) - 1 as place")
    placed = rows.join(before, ["shard", "bucket"])
    out = placed.select(
        "row",
        F.col("bytes").alias("size"),
        F.col("crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        (F.col("before") + F.col("place")).cast("long").alias("slot"),
        F.col("grown").alias("grown_shard"),
    )
    return unpacked(out, docs.columns, ["size", "text_crc32", "law", "shard", "slot", "grown_shard"])
