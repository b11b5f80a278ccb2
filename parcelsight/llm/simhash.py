"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits have a value between them that is within half of r of both.
So every distinct fingerprint stands for the ball of all values within half the radius, fingerprints are shuffled on
these variants, and those that meet on a variant are linked. A ball has 2,081 values at r = 4: too many to ship
one by one. The shuffle key is therefore a part of the variant, some of its bits: most flips leave them alone, so of b
bits a ball touches only 1 + b + b (b - 1) / 2 values. A bucket gets the fingerprint once and makes there all of its
variants that belong to the bucket. The number of buckets follows the number of fingerprints, and with it the
variants that one task holds stay the same; a bucket that is fuller than the rest is gone through in parts.

All fingerprints on one variant are within r of each other (one of them within r // 2, if r is odd), so a group is
linked as a star around its least one, not as all pairs; every link is verified by its distance all the
same. Equal fingerprints are one node, so exact copies cost nothing. Components are found by alternating
large and small stars over tables in the shared scratch folder; labels never visit the driver.

Defined results: a null text, or one without words, has fingerprint zero and is linked like any other;
fewer words than a shingle are one shingle; a null id counts as a row but names a component only if the component has no
other id; repeated rows are copies; no rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelsight.llm.common import stored, text_of
from parcelsight.operators.skew import balanced_join

SHINGLE = 4
MAX_BITS = 4
SEED = 42
VARIANTS_PER_BUCKET = 1 << 21   # about 50 MB in a task
LEAST_BITS = 8                  # at least 256 buckets
CHUNK = 1 << 16                 # shingles, or fingerprints times buckets in units of 64, handled at once


def simhash(text: bytes, k: int = SHINGLE) -> int:
    """64-bit SimHash of the shingles, repeats included; a bit is set if it is set in over half of them."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - k + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[at:at + CHUNK], ends[at:at + CHUNK])]
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE,
                 marks: dict[str, Column] | None = None) -> DataFrame:
    """(key, fp, marks) with the fingerprint as a signed long; `marks` are further long columns to keep."""
    names = list(marks or {})
    rows = docs.select(F.col(key).cast("bigint").alias(key), text_of(text).cast("binary").alias("_text"),
                       *[c.alias(n) for n, c in (marks or {}).items()])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((simhash(t.as_py(), k) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]],
                                             [key, "fp", *names])

    return rows.mapInArrow(each, ", ".join(f"{c} bigint" for c in (key, "fp", *names)))


def hex_text(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# ---- variants and their buckets -----------------------------------------------------------------

def flips(radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All masks of at most ceil(radius / 2) bits, and whether they have at most radius // 2."""
    far = -(-radius // 2)
    masks = [sum(1 << i for i in c) for n in range(far + 1) for c in combinations(range(64), n)]
    weights = [n for n in range(far + 1) for _ in combinations(range(64), n)]
    return np.array(masks, dtype=np.uint64), np.array(weights) <= radius // 2


def syndrome_table(bits: int, finer: int = 0) -> np.ndarray:
    """(8, 256): the share of every byte value at every place in a linear hash of bits + finer bits.

    The first `bits` are just that many of the fingerprint's own bits, at scattered places: most flips do not touch
    them and stay in the bucket, so a fingerprint has variants in few buckets. The finer bits are parities of
    random halves of all places.
    """
    rng = np.random.default_rng(64)
    columns = np.zeros(64, dtype=np.uint64)
    columns[rng.permutation(64)[:bits]] = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    if finer:
        columns |= rng.integers(0, 1 << finer, size=64, dtype=np.uint64) << np.uint64(bits)
    table = np.zeros((8, 256), dtype=np.uint64)
    for place in range(8):
        for bit in range(8):
            table[place, (np.arange(256) >> bit) & 1 == 1] ^= columns[8 * place + bit]
    return table


def syndromes(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    octets = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    out = table[0][octets[:, 0]]
    for place in range(1, 8):
        out = out ^ table[place][octets[:, place]]
    return out


def to_buckets(values: np.ndarray, table: np.ndarray, steps: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, fingerprints) for every bucket that holds a variant of one of the fingerprints."""
    size = max(1, 64 * CHUNK // len(steps))
    for at in range(0, len(values), size):
        part = values[at:at + size]
        places = (syndromes(part, table)[:, None] ^ steps[None, :]).ravel()
        order = np.argsort(places, kind="stable")
        places, owners = places[order], part[order // len(steps)]
        cuts = np.flatnonzero(np.diff(places)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(places)]):
            yield int(places[a]), owners[a:b].tobytes()


def meet(values: np.ndarray, bucket: int, bits: int, masks: np.ndarray, near: np.ndarray,
         limit: int = VARIANTS_PER_BUCKET) -> np.ndarray:
    """(n, 2): for every variant of the bucket that several fingerprints share, the links of the others to the
    least one that is near. A bucket with more variants than `limit` is gone through in finer parts."""
    values = np.unique(values)
    table = syndrome_table(bits)
    own, steps = syndromes(values, table), np.sort(syndromes(masks, table))
    wanted = own ^ np.uint64(bucket)
    variants = int((np.searchsorted(steps, wanted, "right") - np.searchsorted(steps, wanted, "left")).sum())
    finer = max(0, int(np.ceil(np.log2(max(1, variants) / limit))))
    table = syndrome_table(bits, finer)
    found = [_meet(values, bucket | part << bits, table, masks, near) for part in range(1 << finer)]
    return np.unique(np.concatenate(found), axis=0)


def _meet(values: np.ndarray, bucket: int, table: np.ndarray, masks: np.ndarray, near: np.ndarray) -> np.ndarray:
    own, steps = syndromes(values, table), syndromes(masks, table)
    by_value, by_mask = np.argsort(own, kind="stable"), np.argsort(steps, kind="stable")
    own, steps = own[by_value], steps[by_mask]
    variants, owners, close = [], [], []
    for step in np.unique(steps):
        wanted = np.uint64(bucket ^ int(step))
        a, b = np.searchsorted(own, wanted, "left"), np.searchsorted(own, wanted, "right")
        if a == b:
            continue
        c, d = np.searchsorted(steps, step, "left"), np.searchsorted(steps, step, "right")
        held, flip = values[by_value[a:b]], by_mask[c:d]
        variants.append((held[:, None] ^ masks[flip][None, :]).ravel())
        owners.append(np.repeat(held, d - c))
        close.append(np.tile(near[flip], b - a))
    if not variants:
        return np.empty((0, 2), dtype=np.uint64)
    variants, owners, close = np.concatenate(variants), np.concatenate(owners), np.concatenate(close)
    order = np.argsort(variants)
    variants, top = variants[order], np.iinfo(np.uint64).max
    starts = np.flatnonzero(np.concatenate(([True], variants[1:] != variants[:-1])))
    lengths = np.diff(np.append(starts, len(variants)))
    shared = np.repeat(lengths > 1, lengths)
    if not shared.any():
        return np.empty((0, 2), dtype=np.uint64)
    owners, close, lengths = owners[order][shared], close[order][shared], lengths[lengths > 1]
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    centre = np.repeat(np.minimum.reduceat(np.where(close, owners, top), starts), lengths)
    none_near = np.repeat(~np.logical_or.reduceat(close, starts), lengths)
    links = np.stack([centre, owners], axis=1)[(centre != owners) & ~none_near]
    return np.unique(links, axis=0) if len(links) else links


def links(nodes: DataFrame, radius: int = MAX_BITS) -> DataFrame:
    """(a, b): verified links between distinct fingerprints (column fp) that connect exactly those that
    chains of at most `radius` differing bits connect."""
    masks, near = flips(radius)
    wanted = nodes.count() * len(masks) / VARIANTS_PER_BUCKET
    bits = min(40, max(LEAST_BITS, int(np.ceil(np.log2(max(wanted, 1))))))
    table = syndrome_table(bits)
    steps = np.unique(syndromes(masks, table))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.unique(batch.column(0).to_numpy().view(np.uint64))
            found = list(to_buckets(values, table, steps))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())],
                ["bucket", "values"])

    def join(group: pa.Table) -> pa.Table:
        held = np.frombuffer(b"".join(v.as_py() for v in group.column("values")), dtype=np.uint64)
        found = meet(held, group.column("bucket")[0].as_py(), bits, masks, near).view(np.int64)
        return pa.table({"a": np.ascontiguousarray(found[:, 0]), "b": np.ascontiguousarray(found[:, 1])})

    met = (nodes.select("fp").mapInArrow(emit, "bucket bigint, values binary")
           .groupBy("bucket").applyInArrow(join, "a bigint, b bigint"))
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


# ---- components ---------------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node that has an edge (a, b) with the least node of its component.

    A large star links the greater neighbours of a node to its least neighbour, a small star the lesser
    ones; alternated until nothing changes they leave one star per component, in a number of rounds that
    grows with the logarithm of the longest chain. Least neighbours are aggregated before the
    shuffle, and the joins are left to AQE, which splits a hub's rows.
    """
    current = stored(_ordered(edges), "links")
    state = _state(current)
    while True:
        wide = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = wide.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _ordered(wide.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "n")
        small = large.join(least, large["b"] == least["n"]).select("a", "b", "m")
        small = _ordered(small.select(F.col("a"), F.col("m").alias("b"))
                         .unionAll(small.select(F.col("b").alias("a"), F.col("m").alias("b"))))
        current = stored(small, "links")
        if (after := _state(current)) == state:
            return current.select(F.col("b").alias("node"), F.col("a").alias("root"))
        state = after


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges from the lesser to the greater node."""
    return (edges.where(F.col("a") != F.col("b"))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _state(edges: DataFrame) -> tuple:
    key = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(key.bitwiseAND(F.lit(0xFFFFFFFF))),
                           F.sum(F.shiftrightunsigned(key, 32))).first())


def roots(marked: DataFrame, radius: int = MAX_BITS, key: str = "doc_id") -> DataFrame:
    """(fp, first, root): every fingerprint with its least id and the least fingerprint that it is linked with."""
    nodes = stored(marked.groupBy("fp").agg(F.min(key).alias("first")), "simhash-nodes")
    found = components(links(nodes, radius))
    return stored(nodes.join(found, nodes["fp"] == found["node"], "left")
                  .select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-roots")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE,
                    radius: int = MAX_BITS) -> DataFrame:
    """(key, fp, component): the least id that is reachable over fingerprints within `radius` bits."""
    marked = stored(fingerprints(docs, key, text, k), "simhash")
    joined = roots(marked, radius, key)
    least = joined.groupBy("root").agg(F.min("first").alias("component"))
    labels = joined.join(least, "root").select("fp", "component")
    return balanced_join(marked, labels, "fp", key).select(key, "fp", "component")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, radius: int = MAX_BITS) -> DataFrame:
    """One row of every group, with all of its columns: the least id (a null one only where there is no other), of texts
    that share it the one with the least hash, of equal texts that share it one row.

    A group is known by its fingerprints, not by an id, so rows without an id and several texts under one id stay as
    often as there are groups. The choice is made on narrow rows that carry 128 bits of hash over id
    and text; the documents are joined with the hashes that stay.
    """
    row_key = [F.col(key).cast("bigint"), text_of(text)]
    marks = {"_h1": F.xxhash64(F.lit(1), *row_key), "_h2": F.xxhash64(F.lit(2), *row_key)}
    marked = stored(fingerprints(docs, key, text, k, marks), "simhash")
    order = F.struct(F.col(key).isNull().alias("missing"), F.col(key).alias("id"), "_h1", "_h2")
    least = marked.groupBy("fp").agg(F.min(order).alias("least"))
    firsts = (roots(marked, radius, key).select("fp", "root").join(least, "fp")
              .groupBy("root").agg(F.min("least").alias("least")).select("least._h1", "least._h2"))
    often = marked.groupBy("_h1", "_h2").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    firsts = stored(firsts.join(often, ["_h1", "_h2"], "left").select("_h1", "_h2", F.col("n").isNotNull().alias("again")),
                    "simhash-first")
    rows = docs.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in marks.items()])
    kept = rows.join(firsts.where(~F.col("again")), ["_h1", "_h2"], "left_semi").select("row")
    if not firsts.where("again").isEmpty():
        equal = rows.join(firsts.where("again"), ["_h1", "_h2"], "left_semi")
        kept = kept.unionAll(equal.groupBy("_h1", "_h2").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row"))
    return kept.select("row.*")
