"""Rendezvous sharding: every record goes to the shard that scores best for its key.

A shard's score for a key is -ln(u) / weight, u a hash of (shard, key) in (0, 1); the least score
wins. Scores of other shards do not change when a shard is added, so a new shard takes exactly the
keys for which it scores best and no key moves between old shards. With weights w a shard gets w / sum(w)
of the keys. One narrow pass gives the shard; only the slots need a shuffle, of a few numbers per row.

Defined results: a null key counts as the empty key; rows that share a key share a shard; identical
rows get slots in any order; no rows give no rows; a null text has size 1 and checksum 0. Columns of
the input other than the key and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelsight.llm.common import key_text, running_start, stored, text_of

DIGITS = 13                 # hexadecimal digits of the hash that make u: 52 bits, exact in a double
SLOT_CELLS = 3              # hexadecimal digits that cut a shard into 4,096 cells for numbering


def score(key: Column, shard: int, weight: float) -> Column:
    part = F.conv(F.substring(F.md5(F.concat(F.lit(f"{shard}:"), key).cast("binary")), 1, DIGITS), 16, 10)
    u = (part.cast("bigint").cast("double") + 0.5) / float(16 ** DIGITS)
    return -F.ln(u) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The number of the winning shard; shards of weight 0 get nothing, a tie goes to the lower one."""
    named = [F.struct(score(key, i, w).alias("score"), F.lit(i).alias("shard"))
             for i, w in enumerate(weights) if w > 0]
    if not named:
        raise ValueError("no shard has a positive weight")
    return F.array_min(F.array(*named))["shard"]


def shard_records(records: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text",
                  grown_weight: float = 1.0) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every record.

    `grown_shard` is the shard with one more shard of weight `grown_weight`.
    """
    body = text_of(text)
    placed = records.select(
        F.col(key), (F.octet_length(body) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.md5(key_text(key).cast("binary")).alias("_order"),
        rendezvous(key_text(key), weights).alias("shard"),
        rendezvous(key_text(key), [*weights, grown_weight]).alias("grown_shard"))
    placed = stored(placed.withColumn("_cell", F.left("_order", F.lit(SLOT_CELLS))), "shards")
    slots = running_start(placed, "shard", "_cell", ["_order", "text_crc32", "size"],
                          F.lit(1).cast("bigint"), "slot")
    return slots.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(records: DataFrame, weights: Sequence[float], path: str, key: str = "doc_id") -> None:
    """The records as files, one folder per shard. The rebalance hint lets AQE cut large shards into
    several files."""
    (records.withColumn("shard", rendezvous(key_text(key), weights)).hint("rebalance", "shard")
     .write.partitionBy("shard").parquet(path))
