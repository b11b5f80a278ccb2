"""Mixing sources to target weights with exact quotas per output shard.

The words of a source lie on a line, its documents in an order drawn by hash. The line is cut into
blocks of equal length; since the order is random, a run of blocks is a random sample of the source. A
target of T words on a line of S takes the whole line T div S times and then its first T mod S words.

Which shard gets how many of a source's blocks is drawn by a splitting tree: the root holds the block
quotas of all sources, and every node passes a multivariate hypergeometric draw of them to its left half and
the rest to its right. So every shard gets its exact number of blocks, every source spends its exact
quota, and the counts are those of one random deal of all blocks. Shards then take disjoint runs of blocks, and
`write_mix` orders each shard's rows by hash.

Only per-source numbers reach the driver (one row per source, its number is checked), and text never leaves
its row: running totals are made per hash cell first, so a source with a third of all rows is many small sorts.

Defined results: a null source is a source of its own, last in order; a null text has no words and is never
taken; a source without words has target 0; repeated rows are documents of their own; no rows give
no rows. Any other column is carried along untouched in `row`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelsight.llm.common import key_text, n_words, running_start, stored

ORDER_CELLS = 3             # hexadecimal digits that cut a source into 4,096 cells
SHARDS = 64
BLOCKS_PER_SHARD = 64
LIMIT = 3
MAX_QUOTAS = 4_000_000      # sources times shards that the driver holds


@dataclass(frozen=True)
class Plan:
    """One source: its words, target, whole passes, words of the last pass, and block draws by shard."""
    group: str
    size: int
    target: float
    passes: int
    rest: int
    upto: list[int]


def group_key(source: str = "source") -> Column:
    """Never null; sorts by code point with null last, as Spark compares strings by their bytes."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))


def targets(sizes: Sequence[int], weights: Sequence[float], limit: float = LIMIT) -> list[float]:
    """Shares of sum(sizes) by weight, none above `limit` times its size.

    Reshared excess settles where every open source gets the same words per unit of weight, so sources are
    closed in the order of limit * size / weight until the next one stays below its limit.
    """
    total, goal = float(sum(sizes)), [0.0] * len(sizes)
    order = sorted((i for i in range(len(sizes)) if sizes[i] > 0), key=lambda i: (limit * sizes[i] / weights[i], i))
    open_weight, closed = float(sum(weights[i] for i in order)), 0.0
    for at, i in enumerate(order):
        level = (total - closed) / open_weight
        if limit * sizes[i] > level * weights[i]:
            for j in order[at:]:
                goal[j] = level * weights[j]
            break
        goal[i] = limit * float(sizes[i])
        closed += goal[i]
        open_weight -= weights[i]
    return goal


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources): block counts of every shard, columns summing to `quotas`.

    Row sums differ by at most one. Each node draws with a generator seeded by its own place, so a
    subtree can be drawn again without the others.
    """
    total = int(quotas.sum())
    ends = [total * i // shards for i in range(shards + 1)]
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    todo = [(0, shards, quotas.astype(np.int64))]
    while todo:
        low, high, held = todo.pop()
        if high - low == 1:
            out[low] = held
            continue
        middle = (low + high) // 2
        want = ends[middle] - ends[low]
        left = np.zeros_like(held)
        rng, pool = np.random.default_rng([seed, low, high]), int(held.sum())
        for i in np.flatnonzero(held):  # one source after another: the conditional draws of the joint law
            own = int(held[i])
            left[i] = want if pool == own else _draw(rng, own, pool - own, want)
            pool -= own
            want -= int(left[i])
        todo += [(low, middle, left), (middle, high, held - left)]
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Hypergeometric; numpy takes populations below 1e9, larger ones are drawn from the normal limit."""
    if n == 0:
        return 0
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    pool = good + bad
    spread = math.sqrt(n * good / pool * bad / pool * (pool - n) / max(1, pool - 1))
    return int(min(good, n, max(0, n - bad, round(rng.normal(n * good / pool, spread)))))


def plan_sources(sizes: Sequence[tuple[str, int]], weights: Sequence[float], limit: float, shards: int,
                 blocks_per_shard: int, seed: int) -> tuple[list[Plan], int]:
    """The plan of every source and the block length, from (group, words) in group order."""
    words = [n for _, n in sizes]
    goals = targets(words, [weights[i % len(weights)] for i in range(len(words))], limit)
    block = max(1, sum(words) // (shards * blocks_per_shard))
    rows, quotas = [], []
    for (group, size), goal in zip(sizes, goals):
        passes, rest = divmod(math.floor(goal + 0.5), size) if size else (0, 0)
        rows.append((group, size, goal, passes, rest))
        quotas.append(passes * -(-size // block) + -(-rest // block))
    dealt = split_quotas(np.array(quotas, dtype=np.int64), shards, seed) if rows else np.zeros((shards, 0), np.int64)
    upto = np.cumsum(dealt, axis=0)
    return [Plan(*row, upto[:, i].tolist()) for i, row in enumerate(rows)], block


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), limit: float = LIMIT,
                shards: int = SHARDS, blocks_per_shard: int = BLOCKS_PER_SHARD, seed: int = 0) -> DataFrame:
    """(row, size, source_size, target, taken, draws) for every document.

    `row` holds the document's columns. `draws` lists (pass, shard, words) for every time it is taken:
    whole, or cut to its first words where the source's quota ends. `taken` is the sum of these words.
    """
    spark = docs.sparkSession
    sized = docs.select(F.struct("*").alias("row"), group_key().alias("_group"), n_words().alias("size"),
                        F.md5(F.concat(F.lit(f"{seed}:"), key_text()).cast("binary")).alias("_order"))
    sized = sized.withColumn("_cell", F.left("_order", F.lit(ORDER_CELLS)))
    cells = stored(sized.groupBy("_group", "_cell").agg(F.sum("size").alias("total")), "mix-cells")
    per_source = cells.groupBy("_group").agg(F.sum("total").alias("n"))
    found = per_source.limit(MAX_QUOTAS // shards + 1).collect()
    if len(found) * shards > MAX_QUOTAS:
        raise ValueError(f"more than {MAX_QUOTAS // shards} sources for {shards} shards")
    plans, block = plan_sources(sorted((r["_group"], r["n"]) for r in found), weights, limit, shards,
                                blocks_per_shard, seed)
    table = spark.createDataFrame(
        [(p.group, p.size, p.target, p.passes, p.rest, max(1, -(-p.size // block)), p.upto) for p in plans],
        "_group string, source_size bigint, target double, _passes bigint, _rest bigint, _blocks bigint, "
        "_upto array<bigint>")
    # ties of one key are told apart by what decides the result: how many words they have
    lined = running_start(sized, "_group", "_cell", ["_order", "size"], F.col("size"), "_start", cells)
    lined = lined.join(F.broadcast(table), "_group")
    block_at = F.floor(F.col("_start") / F.lit(block)).cast("bigint")

    def draw(n: Column) -> Column:
        words = F.when(n < F.col("_passes"), F.col("size")).otherwise(
            F.least(F.greatest(F.col("_rest") - F.col("_start"), F.lit(0)), F.col("size")))
        place = n * F.col("_blocks") + block_at
        shard = F.size(F.filter("_upto", lambda end: end <= place))
        return F.struct(n.cast("int").alias("pass"), shard.alias("shard"), words.alias("words"))

    drawn = F.filter(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_passes")), draw),
                     lambda d: d["words"] > 0)
    taken = (F.col("_passes") * F.col("size")
             + F.least(F.greatest(F.col("_rest") - F.col("_start"), F.lit(0)), F.col("size")))
    return lined.select("row", "size", "source_size", "target", taken.cast("bigint").alias("taken"),
                        drawn.alias("draws"))


def first_words(n: Column, text: Column) -> Column:
    """The text up to the end of its n-th word, with the spaces as they are."""
    spaced = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(spaced, F.lit(1), n.cast("int")), "")


def mixed_documents(mixed: DataFrame, columns: Sequence[str], text: str = "text", chars: str = "n_chars") -> DataFrame:
    """One document per draw, with the given columns; a draw that is cut short cuts its text and counts its
    characters again."""
    out = mixed.select("row", "size", F.explode("draws").alias("draw"))
    cut, old = F.col("draw.words") < F.col("size"), F.col("row")
    out = out.select("row", F.when(cut, first_words(F.col("draw.words"), old[text])).alias("left"))
    left = F.col("left")
    return out.select(*[F.coalesce(left, old[c]).alias(c) if c == text else
                        F.coalesce(F.length(left).cast("bigint"), old[c]).alias(c) if c == chars else old[c].alias(c)
                        for c in columns])


def write_mix(mixed: DataFrame, path: str, seed: int = 0) -> None:
    """The drawn documents as files, one folder per shard, each file in an order drawn by hash."""
    out = mixed.select("row", F.explode("draws").alias("draw")).withColumn("mix_shard", F.col("draw.shard"))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.to_json("draw"), F.lit(":"), F.to_json("row")).cast("binary"))
    (out.withColumn("order", order).hint("rebalance", "mix_shard").sortWithinPartitions("mix_shard", "order")
     .select("row.*", "mix_shard", F.col("draw.pass").alias("mix_pass"), F.col("draw.words").alias("mix_words"))
     .write.partitionBy("mix_shard").parquet(path))
