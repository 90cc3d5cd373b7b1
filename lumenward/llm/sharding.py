"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A stable key goes to a shard by arithmetic alone: no ring table, and appending shards moves only the
rows that the new shards take. Slots number the rows of each shard from 0 without a gap.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenward.llm import common

SHARDS = 24
#: Rows of a shard numbered by one task; more rows get more tasks.
ROWS_PER_BUCKET = 200_000
#: Slots of one equal row that are handed out together.
RUN = 1 << 16
#: Offset rows that may be broadcast (about 40 bytes each).
BROADCAST_ROWS = 200_000
_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key among n_shards."""
    if n_shards < 1:
        raise ValueError("at least one shard is needed")
    key = np.array(keys, dtype=np.uint64)
    shard = np.zeros(len(key), dtype=np.int64)
    going = np.arange(len(key))
    at = np.zeros(len(key), dtype=np.int64)
    while len(going):
        shard[going] = at
        with np.errstate(over="ignore"):
            key = key * _STEP + np.uint64(1)
        ratio = np.float64(1 << 31) / ((key >> np.uint64(33)).astype(np.float64) + 1.0)
        at = np.floor((at + 1) * ratio).astype(np.int64)
        on = at < n_shards
        going, key, at = going[on], key[on], at[on]
    return shard.astype(np.int32)


def shard_of(key: Column, n_shards: int, appended: int = 1) -> Column:
    """struct<shard, grown_shard>: the shard of a key with n_shards and with n_shards + appended.

    The key is hashed with xxhash64 first, so any type works; a null key has one fixed shard.
    """

    @F.pandas_udf("struct<shard:int,grown_shard:int>")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for hashed in batches:
            bits = hashed.to_numpy(dtype=np.int64).view(np.uint64)
            yield pd.DataFrame({"shard": jump(bits, n_shards), "grown_shard": jump(bits, n_shards + appended)})

    return place(F.xxhash64(key))


def assign(df: DataFrame, key: str = "doc_id", n_shards: int = SHARDS, appended: int = 1) -> DataFrame:
    """df with shard and grown_shard; columns of these names are replaced. Row-local, no shuffle.

    Null keys: one fixed shard. Repeated rows: a row each, the same shard. Texts are not read, so null, empty and
    very long ones are nothing special. Empty table: no rows. Other columns stay as they are.
    """
    kept = [c for c in df.columns if c not in ("shard", "grown_shard")]
    both = df.select(F.struct(*kept).alias("row"), shard_of(F.col(key), n_shards, appended).alias("at"))
    return both.select(*[F.col("row").getField(c).alias(c) for c in kept], "at.shard", "at.grown_shard")


def with_slots(df: DataFrame, order: Sequence[str], shard: str = "shard", n_rows: int | None = None, n_shards: int = SHARDS) -> DataFrame:
    """df with slot: a gapless number from 0 within each shard.

    df must be narrow (digests, not texts). Equal rows are first counted together, so that a row repeated
    any number of times is one row in the shuffle, and dealt out again in runs over all tasks. Each shard is cut into buckets by a hash of `order`;
    a bucket's first slot is the number of rows in the buckets before it. Equal rows get neighbouring slots.
    """
    n_rows = df.count() if n_rows is None else n_rows
    buckets = max(1, -(-n_rows // (n_shards * ROWS_PER_BUCKET)))
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n")).withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy(shard).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.groupBy(shard, "__b").agg(F.sum("__n").alias("__rows"))
    starts = starts.select(shard, "__b", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    if buckets * n_shards <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    within = Window.partitionBy(shard, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("__at", F.coalesce(F.sum("__n").over(within), F.lit(0))).join(starts, [shard, "__b"])
    last = F.col("__start") + F.col("__at") + F.col("__n") - 1
    runs = placed.select(*df.columns, last.alias("__last"), F.explode(F.sequence(F.col("__start") + F.col("__at"), last, F.lit(RUN).cast("long"))).alias("__run"))
    runs = runs.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), shard, "__run")
    return runs.select(*df.columns, F.explode(F.sequence("__run", F.least(F.col("__run") + RUN - 1, "__last"))).alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 under the law `key`.

    Null text: size 8, CRC of the empty text. Null doc_id: one fixed shard. Repeated rows: the same shard,
    different slots. Empty table: no rows. Other columns of documents are not read.
    """
    common.arrow_batches(spark)
    docs = common.table(spark, sf_dir, "documents")
    data = common.text_of("text").cast("binary")
    digests = docs.select("doc_id", (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    placed = with_slots(assign(digests), ["doc_id", "text_crc32", "size"], n_rows=docs.count())
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
