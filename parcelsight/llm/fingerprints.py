"""One-permutation MinHash with optimal densification and packed low-order bits, in built-in functions.

Every shingle is hashed once. The top bits of the hash name a bin, and a bin keeps its least hash. An
empty bin borrows from the first filled bin of a fixed random order of its own, so that two texts
borrow from the same bin whenever both have filled it. Of every bin only low-order bits are stored, packed into
longs. Two bins agree by chance with probability 1 / 2^bits, and `likeness` takes that share off again.

A text is one array in one row: hashes and one sentinel per bin are sorted together, and the first value of every
bin is its least hash or, if the bin is empty, its sentinel. Nothing is exploded or shuffled for a
fingerprint.

Defined results: shingles are of five words, as written; a text of one to four words is one
shingle; a text without words (null, empty) has the fingerprint of zeros, is wholly like any other such text
(1.0) and not at all like a text with words (0.0). Equal texts have equal fingerprints. Repeated rows are
documents of their own; a single document is its own next one; no rows give no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parcelsight.llm.common import GAP, text_of

SHINGLE = 5
BIN_BITS = 8                # 256 bins
BITS = 4                    # low-order bits kept of every bin
NEAR_PROBES = 6             # borrowed bins tried one by one before the rest of the order is searched
BUCKET_ROWS = 8_000         # documents that one task sorts to find each one's next
MAX_BOUNDS = 100_000        # bucket bounds that the driver holds


def _mix(x: int) -> int:
    """splitmix64, which orders the bins below."""
    x = (x + 0x9E3779B97F4A7C15) & (2 ** 64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2 ** 64 - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2 ** 64 - 1)
    return x ^ (x >> 31)


def probe_orders(bins: int) -> list[list[int]]:
    """For every bin a fixed random order of the others."""
    return [sorted((j for j in range(bins) if j != i), key=lambda j: _mix(i * bins + j)) for i in range(bins)]


def constant(values: list, kind: str) -> Column:
    """A list as one literal. F.lit would make an expression of every element, and planning would walk
    them all; parsing a constant string is folded into one value."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def bound(value: Column, use) -> Column:
    """use(value), with value computed once per row: a lambda's body is evaluated for every element, so an
    array used in it has to be a variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingle_hashes(text: Column, k: int = SHINGLE) -> Column:
    """One hash per shingle, repeats included: words are hashed once, runs of 2, 4, 8 … words from two runs
    of half the length, and the shingle from the runs that make up k."""
    def joined(left: Column, right: Column, step: int) -> Column:
        return bound(right, lambda r: F.transform(left, lambda x, i: F.xxhash64(x, F.get(r, i + F.lit(step)))))

    def doubled(run: Column, size: int) -> Column:
        return bound(run, lambda r: joined(r, r, size))

    def runs(h: Column) -> Column:
        out, length, power, size = None, 0, h, 1
        while True:
            if k & size:
                out, length = (power, size) if out is None else (joined(out, power, length), length + size)
            if length == k:
                return F.slice(out, F.lit(1), F.size(h) - F.lit(k - 1))
            power, size = doubled(power, size), size * 2

    def hashed(w: Column) -> Column:
        words = F.transform(w, lambda x: F.xxhash64(x))
        whole = F.array(F.xxhash64(F.array_join(w, " ")))
        return (F.when(F.size(w) >= k, bound(words, runs)).when(F.size(w) > 0, whole)
                .otherwise(F.array().cast("array<bigint>")))

    return bound(F.filter(F.split(text, GAP), lambda w: w != ""), hashed)


def fingerprint(text: Column, k: int = SHINGLE, bin_bits: int = BIN_BITS, bits: int = BITS) -> Column:
    """array<bigint> of packed low-order bits; empty for a text without words."""
    bins, shift = 1 << bin_bits, 64 - bin_bits
    low = (1 << bits) - 1
    per_long = 64 // bits
    # the greatest hash of every bin, in signed order, marks it as empty
    sentinels = constant([((i - bins // 2 + 1) << shift) - 1 for i in range(bins)], "array<bigint>")
    table = probe_orders(bins)
    orders = constant(table, "array<array<int>>")
    probes = [constant([row[p] for row in table], "array<int>") for p in range(NEAR_PROBES)]

    def leasts(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(s, i - 1), shift)))

    def marked(least: Column) -> Column:
        """The least hash of every bin, null where it is empty."""
        return F.transform(least, lambda x, i: F.when(x != F.get(sentinels, i), x))

    def dense(b: Column) -> Column:
        near = F.transform(b, lambda x, i: F.coalesce(x, *[F.get(b, F.get(p, i)) for p in probes]))
        far = lambda d: F.transform(d, lambda x, i: F.coalesce(x, F.get(b, F.get(
            F.filter(F.get(orders, i), lambda j: F.get(b, j).isNotNull()), F.lit(0)))))
        return bound(near, lambda d: F.when(F.exists(d, lambda x: x.isNull()), far(d)).otherwise(d))

    def lowest(d: Column) -> Column:
        """Low bits, of a hash of the bin and its value: bins that borrowed one value must not agree or differ
        by chance all together."""
        return F.transform(d, lambda x, i: F.xxhash64(x, i).bitwiseAND(F.lit(low).cast("bigint")))

    def packed(d: Column) -> Column:
        starts = F.lit(list(range(0, bins, per_long)))
        return F.transform(starts, lambda at: F.aggregate(
            F.slice(d, at + 1, F.lit(per_long)), F.lit(0).cast("bigint"),
            lambda acc, x: F.shiftleft(acc, bits).bitwiseOR(x)))

    def whole(h: Column) -> Column:
        sorted_ = F.sort_array(F.concat(h, sentinels))
        full = bound(bound(bound(bound(bound(sorted_, leasts), marked), dense), lowest), packed)
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(full)

    return bound(shingle_hashes(text, k), whole)


def as_text(fp: Column, bin_bits: int = BIN_BITS, bits: int = BITS) -> Column:
    digits = (1 << bin_bits) * bits // 4
    return F.rpad(F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ""), digits, "0")


def likeness(a: Column, b: Column, bin_bits: int = BIN_BITS, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity of the shingle sets, from 0 to 1."""
    bins, chance = 1 << bin_bits, 1.0 / (1 << bits)
    ones = sum(1 << i for i in range(0, 64, bits))

    def differing(x: Column) -> Column:
        """Bins that differ in one long: every bin's bits are folded onto its lowest."""
        folded = x
        for i in range(1, bits):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, i))
        return F.bit_count(folded.bitwiseAND(F.lit(ones).cast("bigint")))

    apart = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda n, x: n + differing(x))
    same = F.lit(1.0) - apart / F.lit(float(bins))
    corrected = F.greatest(F.lit(0.0), (same - chance) / (1.0 - chance))
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
            .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(corrected))


def bucket_heads(ids: DataFrame, key: str, bucket_rows: int = BUCKET_ROWS) -> list[int]:
    """The greatest key of every bucket, ascending: keys that occur, about `bucket_rows` rows apart.

    Only keys are read. Approximate quantiles cut the range and exact maxima of the parts snap the cuts
    to keys that exist, so that outliers and gaps among the keys do not unbalance the buckets.
    """
    known = ids.where(F.col(key).isNotNull())
    n = known.count()
    if n == 0:
        return []
    parts = min(MAX_BOUNDS, -(-n // bucket_rows))
    cuts = known.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [1.0],
                                         max(10_000, 20 * parts))).first()[0]
    placed = known.select(F.col(key), bucket_of(F.col(key), sorted(set(cuts))).alias("b"))
    return sorted(r[0] for r in placed.groupBy("b").agg(F.max(key)).select(F.col(f"max({key})")).collect())


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are below the key: coarse steps first, then the few bounds of one step."""
    step = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    coarse = F.size(F.filter(constant([r[-1] for r in rows], "array<bigint>"), lambda b: b < key))
    fine = F.coalesce(F.get(constant(rows, "array<array<bigint>>"), coarse), F.array().cast("array<bigint>"))
    return coarse * step + F.size(F.filter(fine, lambda b: b < key))


def with_next(rows: DataFrame, key: str, carried: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds `next`, a struct of the carried columns of the next row in descending key order; after the
    last comes the first. Rows of equal keys follow each other by the carried columns; null keys come last.

    One shuffle by ranges of the key; the first row of every range is also sent to the range before it
    as the end marker, so that no task sees more than its own range.
    """
    heads = bucket_heads(rows.select(key), key, bucket_rows)
    top = len(heads) - 1
    own = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.least(bucket_of(F.col(key), heads), F.lit(top))) \
        if heads else F.lit(-1)
    placed = rows.withColumn("_own", own)
    if heads:
        is_head = F.col(key) == F.get(constant(heads, "array<bigint>"), F.greatest(F.col("_own"), F.lit(0)))
        has_null = bool(rows.where(F.col(key).isNull()).select(key).take(1))
        first = -1 if has_null else 0   # the range that is read last, after which the order starts again
        above = F.when(F.col("_own") == top, F.lit(first)).otherwise(F.col("_own") + 1)
        places = F.when((F.col("_own") >= 0) & is_head, F.array(
            F.struct(F.col("_own").alias("b"), F.lit(False).alias("g")),
            F.struct(above.alias("b"), F.lit(True).alias("g"))))
        if has_null:    # the range of the least keys is followed by the rows without a key
            null_place = F.when(F.col("_own") < 0, F.array(F.struct(F.col("_own").alias("b"), F.lit(False).alias("g")),
                                                           F.struct(F.lit(0).alias("b"), F.lit(True).alias("g"))))
            places = F.coalesce(places, null_place)
    else:               # no key at all: one range, whose first row is also its end marker
        places = F.array(F.struct(F.lit(-1).alias("b"), F.lit(False).alias("g")),
                         F.struct(F.lit(-1).alias("b"), F.lit(True).alias("g")))
        return _follow(placed.select("*", F.inline(places)), key, carried)
    places = F.coalesce(places, F.array(F.struct(F.col("_own").alias("b"), F.lit(False).alias("g"))))
    return _follow(placed.select("*", F.inline(places)), key, carried)


def _follow(placed: DataFrame, key: str, carried: list[str]) -> DataFrame:
    order = W.partitionBy("b").orderBy(F.col("g"), F.col(key).desc_nulls_last(), *carried)
    return (placed.withColumn("next", F.lead(F.struct(*carried)).over(order))
            .where(~F.col("g")).drop("b", "g", "_own"))


def edited_text(text: Column, following: Column) -> Column:
    """The last third of the text (code points, rounded down) replaced by as many of the following one."""
    n = F.length(text)
    cut = F.floor(n / F.lit(3)).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text",
                          bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    known = docs.select(F.col(key).cast("bigint").alias(key), text_of(text).alias("_text"))
    known = known.withColumn("_fp", fingerprint(F.col("_text")))
    rows = with_next(known, key, ["_text", "_fp"], bucket_rows)
    rows = rows.select(key, "_text", "_fp", F.col("next._fp").alias("_next_fp"),
                       edited_text(F.col("_text"), F.col("next._text")).alias("_edited"))
    rows = rows.withColumn("_edited_fp", fingerprint(F.col("_edited")))
    return rows.select(
        key, F.length("_text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("_fp")).alias("fingerprint"), as_text(F.col("_edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("_fp"), F.col("_edited_fp")).alias("near_edited"),
        likeness(F.col("_fp"), F.col("_next_fp")).alias("near_next"))
