"""Joins and groupings that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY_SLOTS = 10_000          # a heavy key holds more than 1/10,000 of all rows: at most 10,000 keys
ROWS_PER_PART = 1_000_000     # a key is cut into parts of about this many rows


def heavy_keys(df: DataFrame, key: str, at_least: int = ROWS_PER_PART) -> DataFrame:
    """(key, n) of the keys with more than `at_least` rows and more than 1/HEAVY_SLOTS of all rows.

    The second condition proves the size bound that makes the result safe to broadcast. Counts are
    combined map-side, so finding a hot key costs no more than finding a cold one.
    """
    total = df.agg(F.count("*").alias("total")).scalar()
    sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return sizes.where((F.col("n") > at_least) & (F.col("n") * HEAVY_SLOTS > total))


def balanced_join(big: DataFrame, small: DataFrame, key: str, spread: str, how: str = "inner",
                  rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Equi join in which the rows of a heavy key are shared out over many tasks.

    `small` has one row per key; it is repeated only for heavy keys, once per part. `spread` is a
    column of `big` that differs from row to row; it picks the part, so a task that is run again
    puts its rows in the same parts.
    """
    parts = F.broadcast(heavy_keys(big, key, rows_per_part).select(
        key, F.ceil(F.col("n") / rows_per_part).cast("int").alias("_parts")))
    cut = F.coalesce(F.col("_parts"), F.lit(1))
    left = (big.join(parts, key, "left")
            .withColumn("_part", F.pmod(F.xxhash64(spread), cut).cast("int")).drop("_parts"))
    right = (small.join(parts, key, "left")
             .withColumn("_part", F.explode(F.sequence(F.lit(0), cut - 1))).drop("_parts"))
    return left.join(right, [key, "_part"], how).drop("_part")
