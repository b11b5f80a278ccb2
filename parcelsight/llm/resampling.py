"""Importance resampling towards a target distribution.

Texts are seen as bags of one- and two-word features, hashed into buckets. A bucket's gain says how much more often it
comes in the target than in the corpus; a document's weight is the mean gain of its features, worked out over arrays: a
batch's words become numbers once, and the checksum of a pair is joined from those of its words. A weight
plus Gumbel noise that the document's id decides is its score, and the highest scores are a draw without replacement in
proportion to the weights' exponentials.

The draw is a distributed quickselect. A document's place is the composite key (score downwards, id, row number), unique
because of the row number. Each round takes some pivot keys of the open interval at random, counts in one pass how many
keys lie before, on and after each, and goes on with the interval that holds the k-th key, until a pivot is that key. Only
pivots and counts reach the driver. The winners alone are then dealt by range, sorted, and numbered by their
partition's start; the others are never sorted.

Defined results: a null text has no words; a text without words has no features and weight 0; a null id draws its noise as
an empty one and comes last among equal scores; repeated rows are documents of their own, and of equal keys any
come first; a target without words gives every bucket the gain of none; no rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelsight.llm.common import key_text, stored, text_of

BUCKETS = 10_000
SCALE = 1000
SEED = 7
LEAST_WORDS = 20
PERCENT = 25
PIVOTS = 31
CACHED_WORDS = 200_000
WORD_BYTES = 64             # longer words take the plain checksum
BATCH_WORDS = 1 << 19       # words numbered at once
# A-Z become a-z, every other ASCII character but letters and digits a space
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


# ---- features -----------------------------------------------------------------------------------

def zero_shifts() -> np.ndarray:
    """(length, byte place, byte value): what `length` zero bytes make of a checksum, by its four bytes."""
    step = np.empty(256, dtype=np.uint32)
    for b in range(256):
        v = b
        for _ in range(8):
            v = v >> 1 ^ (0xEDB88320 if v & 1 else 0)
        step[b] = v
    out = np.empty((WORD_BYTES + 1, 4, 256), dtype=np.uint32)
    out[0] = [[b << 8 * place for b in range(256)] for place in range(4)]
    for n in range(WORD_BYTES):
        out[n + 1] = step[out[n] & 0xFF] ^ out[n] >> 8
    return out


class Vocabulary(dict):
    """Word -> number, with the checksums of the word and of the word and a space; forgets all when it is full."""

    def __init__(self):
        super().__init__()
        self.shifts = zero_shifts()
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.words: list[bytes] = []
        self.alone, self.spaced, self.sizes = [], [], []

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self.words)
        self.words.append(word)
        checksum = zlib.crc32(word)
        self.alone.append(checksum)
        self.spaced.append(zlib.crc32(b" ", checksum))
        self.sizes.append(len(word))
        return found

    def buckets(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words per text, and of all words in a row the bucket of each and of each with the next; the
        last word of a text has no next one and its second bucket means nothing."""
        if len(self.words) >= CACHED_WORDS:
            self.clear()
        split = [t.translate(LETTERS).split() for t in texts]
        counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        ids = np.fromiter((self[w] for words in split for w in words), dtype=np.int64, count=int(counts.sum()))
        alone, sizes = np.array(self.alone, dtype=np.uint32), np.array(self.sizes, dtype=np.int64)
        ones = alone[ids]
        if len(ids) < 2:
            return counts, (ones % BUCKETS).astype(np.int64), np.zeros(len(ids), np.int64)
        first, second = ids[:-1], ids[1:]
        start, by = np.array(self.spaced, dtype=np.uint32)[first], np.minimum(sizes[second], WORD_BYTES)
        twos = np.empty(len(ids), dtype=np.uint32)
        twos[:-1] = ones[1:]
        for place in range(4):
            twos[:-1] ^= self.shifts[by, place, start >> np.uint32(8 * place) & np.uint32(0xFF)]
        for i in np.flatnonzero(sizes[second] > WORD_BYTES):
            twos[i] = zlib.crc32(self.words[second[i]], int(start[i]))
        twos[-1] = 0
        return counts, (ones % BUCKETS).astype(np.int64), (twos % BUCKETS).astype(np.int64)


def _slices(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of some megabytes each."""
    rows, start, size = [], 0, 0
    for i, t in enumerate(column):
        rows.append(t.as_py())
        size += len(rows[-1])
        if size >= 4 * BATCH_WORDS:
            yield start, rows
            rows, start, size = [], i + 1, 0
    if rows:
        yield start, rows


def bucket_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each bucket comes in all texts: a fixed number of sums, added up in tasks."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Vocabulary(), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, texts in _slices(batch.column(0)):
                counts, ones, twos = words.buckets(texts)
                total += np.bincount(ones, minlength=BUCKETS)
                paired = np.ones(len(ones), dtype=bool)
                paired[np.cumsum(counts[counts > 0]) - 1] = False
                total += np.bincount(twos[paired], minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["bucket", "n"])

    out = np.zeros(BUCKETS, dtype=np.int64)
    partial = docs.select(text_of(text).cast("binary").alias("_text")).mapInArrow(each, "bucket int, n bigint")
    for r in partial.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandfold log-ratios of the smoothed shares in target and corpus."""
    s_all, t_all = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(SCALE * math.log((t + 1) * s_all / ((s + 1) * t_all)))
                     for s, t in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def score_documents(docs: DataFrame, gains: np.ndarray, key: str = "doc_id", text: str = "text",
                    seed: int = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score) of every document."""
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key_text(key)).cast("binary"), 256), 1, 8), 16, 10)
    rows = docs.select(F.col(key).cast("bigint").alias(key), text_of(text).cast("binary").alias("_text"),
                       noise.cast("bigint").alias("_noise"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary()
        for batch in batches:
            n_words, sums = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for start, texts in _slices(batch.column(1)):
                counts, ones, twos = words.buckets(texts)
                before = np.concatenate(([0], np.cumsum(counts)))
                value, pair = np.append(0, np.cumsum(gains[ones])), gains[twos]
                pair[before[1:][counts > 0] - 1] = 0
                pair = np.append(0, np.cumsum(pair))
                place = slice(start, start + len(texts))
                n_words[place] = counts
                sums[place] = np.diff(value[before]) + np.diff(pair[before])
            n_features = np.maximum(2 * n_words - 1, 0)
            weight = np.where(n_features > 0, sums // np.maximum(n_features, 1), 0)
            gumbel = [math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296))) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n_features), pa.array(weight),
                 pa.array(weight + np.array(gumbel, dtype=np.int64))], [key, "n_words", "n_features", "weight", "score"])

    return rows.mapInArrow(each, f"{key} bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


# ---- quickselect --------------------------------------------------------------------------------

Place = tuple[int, bool, int, int]


def place_of(key: str) -> list[Column]:
    """The composite key, ascending: the lesser comes first."""
    return [-F.col("score"), F.col(key).isNull(), F.coalesce(F.col(key), F.lit(0).cast("bigint")), F.col("row_no")]


def is_before(columns: list[str], pivot: Place) -> Column:
    """Whether the key in `columns` comes before the pivot. The first term is a plain bound that scans can use."""
    out = F.lit(False)
    for name, value in zip(reversed(columns), reversed(pivot)):
        out = (F.col(name) < F.lit(value)) | ((F.col(name) == F.lit(value)) & out)
    return (F.col(columns[0]) <= F.lit(pivot[0])) & out


def kth_place(places: DataFrame, k: int, pivots: int = PIVOTS) -> Place:
    """The k-th least of the unique keys in the columns of `places`, which should be stored; 1 <= k <= rows."""
    columns, inside, need, turn = places.columns, F.lit(True), k, 0
    while True:
        turn += 1
        live = places.where(inside)
        drawn = live.orderBy(F.xxhash64(F.lit(turn), *columns), *columns).limit(pivots).collect()
        tried = sorted(tuple(r) for r in drawn)
        counts = live.agg(*[F.count_if(is_before(columns, p)).alias(f"before_{i}") for i, p in enumerate(tried)],
                          *[F.count_if(F.lit(True)).alias("all")]).first()
        before = [counts[f"before_{i}"] for i in range(len(tried))]     # keys are unique: one lies on its pivot
        if need - 1 in before:
            return tried[before.index(need - 1)]
        passed = sum(b < need for b in before)      # pivots that come before the wanted key
        narrowed = F.lit(True)
        if passed:
            narrowed = narrowed & ~is_before(columns, tried[passed - 1]) & ~_equals(columns, tried[passed - 1])
        if passed < len(tried):
            narrowed = narrowed & is_before(columns, tried[passed])
        inside, need = inside & narrowed, need - (before[passed - 1] + 1 if passed else 0)


def _equals(columns: list[str], pivot: Place) -> Column:
    out = F.lit(True)
    for name, value in zip(columns, pivot):
        out = out & (F.col(name) == F.lit(value))
    return out


def ranked(winners: DataFrame, order: list[str], label: str) -> DataFrame:
    """Adds `rank` from 1: rows are dealt by range and sorted in their partitions, and only the partitions'
    sizes are added up."""
    at = F.col("_at")
    numbered = stored(winners.repartitionByRange(*order).sortWithinPartitions(*order)
                      .withColumn("_at", F.monotonically_increasing_id()), label)
    numbered = numbered.select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"))
    starts, start = [], 0
    for r in numbered.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():
        starts.append((r["_part"], start))
        start += r["n"]
    offsets = winners.sparkSession.createDataFrame(starts, "_part bigint, _start bigint")   # one row per partition
    return (numbered.join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_start") + F.col("_row") + 1)
            .drop("_at", "_part", "_row", "_start"))


def draw(scored: DataFrame, key: str, eligible: Column, percent: int = PERCENT) -> DataFrame:
    """`scored` with the rank of the floor(percent * N / 100) best of its N eligible rows, null for the others."""
    rows = stored(scored.withColumn("row_no", F.monotonically_increasing_id())
                  .withColumn("_fit", F.coalesce(eligible, F.lit(False))), "scored")
    names = ["_p0", "_p1", "_p2", "_p3"]
    rows = rows.select("*", *[c.alias(n) for c, n in zip(place_of(key), names)])
    fit = rows.where("_fit")
    k = fit.count() * percent // 100
    none = F.lit(None).cast("bigint")
    if not k:
        return rows.drop("_fit", "row_no", *names).withColumn("rank", none)
    last = kth_place(fit.select(*names), k)
    won = F.col("_fit") & (is_before(names, last) | _equals(names, last))
    winners = ranked(rows.where(won), names, "winners")
    return winners.unionByName(rows.where(~won).withColumn("rank", none)).drop("_fit", "row_no", *names)


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
             percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank): every document, drawn ones with their rank."""
    gains = bucket_gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    return draw(score_documents(docs, gains, key, text, seed), key, F.col("n_words") >= least_words, percent)
