"""A seeded shuffle of a table into shards, in two passes over the disk, with DataFrame functions only.

The first pass scatters rows uniformly into buckets by a seeded hash; a bucket fits into memory. The second takes each
bucket whole and shuffles it by Fisher-Yates (Spark's ``shuffle`` of an array). A row's position in the shuffled table
is its place in its bucket plus the sizes of the buckets before; shards take positions in turn, so that their row counts
are at most one apart and the slots of a shard have no gap.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import keep, small

#: Rows of a bucket on average; a bucket's keys must fit into a task's memory.
BUCKET_ROWS = 1 << 16
#: Copies of one row that are dealt out together before they are scattered.
COPIES = 1 << 14


def shuffle_plan(df: DataFrame, key: list[str], shards: int, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``key`` columns of every row with its ``shard`` and ``slot``.

    The key should be short (an id and digests): it goes through the shuffle in place of the rows. Rows with an equal
    key, nulls included, are counted first and then dealt out one by one, so that repeated rows neither meet in one
    bucket nor are lost. The result depends on the rows and ``seed``, ``shards`` and ``bucket_rows``, not on how the
    table is laid out. An empty table gives an empty plan.
    """
    counted = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    parts = counted.withColumn("__part", F.explode(F.expr(f"sequence(0L, (__n - 1) div {COPIES})")))
    hot = F.when(F.col("__part") > 0, F.xxhash64("__part", *key)).otherwise(F.xxhash64(*key))
    copies = parts.repartition(hot).withColumn(
        "__copy", F.explode(F.expr(f"sequence(__part * {COPIES}, least(__n, (__part + 1) * {COPIES}) - 1)"))
    )
    rows = keep(copies.select(*key, F.xxhash64(F.lit(seed), *key, "__copy").alias("__hash")))
    buckets = max(1, math.ceil(rows.count() / bucket_rows))
    scattered = rows.withColumn("__bucket", F.pmod("__hash", F.lit(buckets)).cast("int"))
    before = (
        scattered.groupBy("__bucket").count()
        .select("__bucket", (F.sum("count").over(Window.orderBy("__bucket")) - F.col("count")).alias("__before"))
    )  # a row a bucket
    # one bucket a partition: the generator of shuffle() starts from the seed and the partition's number
    gathered = (
        scattered.repartitionById(buckets, F.col("__bucket"))
        .groupBy("__bucket")
        .agg(F.array_sort(F.collect_list(F.struct("__hash", *key))).alias("__rows"))
    )
    shuffled = gathered.select("__bucket", F.shuffle("__rows", F.lit(seed)).alias("__rows")).join(small(before), "__bucket")
    placed = shuffled.select("__before", F.posexplode("__rows").alias("__place", "__row"))
    position = F.col("__before") + F.col("__place")
    return placed.select(
        *[F.col(f"__row.`{k}`").alias(k) for k in key],
        F.pmod(position, F.lit(shards)).cast("int").alias("shard"),
        F.floor(position / shards).cast("long").alias("slot"),
    )


def write_shards(df: DataFrame, path: str, shards: int, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> None:
    """Write all rows of ``df``, shuffled, as Parquet below ``path`` in one folder a shard, in the order of the slots.

    The plan is made for row digests; the rows then follow it in one exchange, ranged by shard and slot, so that large
    shards are several files in order. Rows that are equal in all columns share a digest and are written as often as
    they occur. Existing files are replaced.
    """
    digest = [F.xxhash64(*df.columns).alias("__d0"), F.xxhash64(F.lit("b"), *df.columns).alias("__d1")]
    digested = df.select("*", *digest)
    plan = shuffle_plan(digested, ["__d0", "__d1"], shards, seed, bucket_rows)
    once = digested.dropDuplicates(["__d0", "__d1"])
    placed = once.join(plan, ["__d0", "__d1"]).drop("__d0", "__d1")
    ordered = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.mode("overwrite").partitionBy("shard").parquet(path)
