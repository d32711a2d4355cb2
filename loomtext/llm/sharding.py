"""Jump consistent hashing: stable keys to shards without a ring table.

A key's walk of jumps depends on the key and the shard count alone; with one more shard, a key stays
where it is or goes to the new one, so only 1/(n+1) of the rows move.

Defined results: a null key hashes like one fixed key; a null or empty text counts no bytes; repeated rows
get slots of their own; an empty table gives an empty result; columns with the names of the results are replaced, others left alone, and rows
with a null shard are a shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.llm.common import Spilled, spill, table

#: Multiplier of the published generator (fixed value of the algorithm).
JUMP_MULTIPLIER = 2862933555777941757

SHARDS = 40
ROW_OVERHEAD = 16
#: About so many rows of one shard are numbered by one window group.
ROWS_A_BUCKET = 20_000
#: Repeats of one row are written out in blocks of so many.
REPEAT_BLOCK = 65_536


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key, all keys jumping together until each has passed the last shard."""
    key = keys.astype(np.uint64)
    out = np.zeros(len(key), np.int64)
    at, live = np.zeros(len(key), np.int64), np.arange(len(key))
    while len(live):
        out[live] = at[live]
        key[live] = key[live] * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
        draw = (key[live] >> np.uint64(33)).astype(np.float64) + 1
        at[live] = ((out[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[at[live] < shards]
    return out


def shard_of(key, shards: int):
    """Column: the shard of a key of any type. A map-side expression; nothing is shuffled."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def jump(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(hashed.to_numpy().view(np.uint64), shards).astype(np.int32))

    return jump(F.xxhash64(key))


def assign_shards(df: DataFrame, key: str = "doc_id", shards: int = SHARDS, out: str = "shard") -> DataFrame:
    return df.withColumn(out, shard_of(F.col(key), shards))


def number_slots(rows: DataFrame, shard: str = "shard", slot: str = "slot", rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """Number the rows of each shard 0, 1, 2... without bringing a shard into one task.

    Equal rows are counted first; the others are dealt into buckets by hash, numbered within their bucket, and moved
    up by the sizes of the buckets before. Only bucket sizes meet in one place.
    """
    row = rows.select(F.struct(*rows.columns).alias("row"))  # so that no name of a column matters
    kept = Spilled(row.groupBy("row").agg(F.count(F.lit(1)).alias("n")), "slots").df.withColumn("shard", F.col("row")[shard])
    total, shards = kept.agg(F.sum("n"), F.count_distinct("shard")).first()
    buckets = max(1, (total or 0) // (rows_a_bucket * max(1, shards)))
    kept = kept.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = kept.groupBy("shard", "bucket").agg(F.sum("n").alias("size"))
    first = sizes.select("shard", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "bucket").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = kept.join(first, kept["shard"].eqNullSafe(first["shard"]) & (kept["bucket"] == first["bucket"])).select(kept["*"], "first").withColumn("first", F.col("first") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    blocks = placed.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(REPEAT_BLOCK).cast("long"))))
    upto = F.least(F.col("from") + REPEAT_BLOCK, F.col("n")) - 1
    each = blocks.withColumn("k", F.explode(F.sequence(F.col("from"), upto)))
    return each.select(*[F.col("row")[c].alias(c) for c in rows.columns if c != slot], (F.col("first") + F.col("k")).alias(slot))


def write_shards(df: DataFrame, path: str, shard: str = "shard", files_a_shard: int = 1) -> None:
    """One folder a shard; rows of a shard are salted over files_a_shard tasks."""
    salt = F.floor(F.rand(7) * files_a_shard)
    df.repartition(F.col(shard), salt).write.partitionBy(shard).parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = assign_shards(assign_shards(rows), shards=SHARDS + 1, out="grown_shard")
    return number_slots(spill(rows, "sharded")).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
