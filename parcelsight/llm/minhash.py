"""MinHash near-duplicates with sequential Bayesian verification.

Documents with the same shingle set are one node, so exact copies cost nothing. A node's signature is cut into bands, and
nodes that agree on a band share a bucket: a pair at the wanted similarity shares none with a chance below 1e-9. Candidates
are verified in two steps. First their signatures are compared a batch of hashes at a time, and a pair is
dropped as soon as the posterior chance that it reaches the similarity (uniform prior, binomial matches) is
below MISS. What survives is verified on the full sets.

A bucket's pairs are never all emitted. The first round takes one node of each bucket, that with most company over all its
buckets, as pivot and pairs it with the members of other components. After a round a pivot has been compared with everybody
it could still link, so it leaves the bucket; a bucket whose members are in one component is done. What the first round leaves
open are mostly sets that are alike, but less than wanted, and bands would pair each of them with its whole group. They go on
in buckets by their rarest shingles: in any order of all shingles two sets with an overlap of o share one of the first
size - o + 1 of either, and shingles that only one component holds come first in the order, for they pair nobody. Rounds go
on over these buckets, with more pivots each, until none is open: no link between components is lost, and a group of near
copies costs a multiple of its size. Components are found by alternating stars over stored tables.

Shingles are compared by 64-bit hashes: within a pair two of them collide with a chance below 1e-12. Everything
sent between tasks is per node, never per copy, but for the last join, which shares a hot set's rows out.

Defined results: a document without words (null, empty) has an empty set, is linked with nothing and is its own
component; fewer words than a shingle are one shingle; a null id counts as a row, takes the component of its set's group, and has
none (but is kept) if no row of the group has an id; repeated rows are copies, kept or not alike; no rows give no rows.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelsight.llm.common import stored, text_of
from parcelsight.llm.simhash import components
from parcelsight.operators.skew import balanced_join

SHINGLE = 3
PERCENT = 85                # similarity in hundredths
BANDS, ROWS = 36, 5         # (1 - 0.85^5)^36 is 7e-10
HASHES = BANDS * ROWS
MISS = 1e-9
BATCH_HASHES = 30
MOST_PIVOTS = 512           # per bucket and round; below the bound up to which Spark ranks before it shuffles
SIZE_STEP = 0.02            # logarithm of the step from one class of set sizes to the next
CHUNK = 512                 # shingles hashed at once
CACHED_WORDS = 200_000
GROUP_BYTES = 4 << 20

_rng = np.random.default_rng(85)
FACTORS = _rng.integers(0, 1 << 63, size=(HASHES, 1), dtype=np.uint64) << np.uint64(1) | np.uint64(1)
SHIFTS = _rng.integers(0, 1 << 64, size=(HASHES, 1), dtype=np.uint64)
MIXERS = _rng.integers(0, 1 << 63, size=16, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
BAND_SALTS = _rng.integers(0, 1 << 64, size=BANDS, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * MIXERS[0]
    x = (x ^ x >> np.uint64(29)) * MIXERS[1]
    return x ^ x >> np.uint64(32)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found

    def shingles(self, text: bytes, k: int) -> np.ndarray:
        """Sorted distinct hashes of the text's shingles."""
        words = text.lower().split()
        ids = np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
        if not len(ids):
            return ids
        size = min(k, len(ids))
        n = len(ids) - size + 1
        out = np.full(n, size, dtype=np.uint64)
        for i in range(size):
            out = _mixed(out * MIXERS[2] + ids[i:i + n])
        return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of every hash function over a set that is not empty."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(least, (FACTORS * hashes[None, at:at + CHUNK] + SHIFTS).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows, key = least.reshape(BANDS, ROWS), BAND_SALTS
    for i in range(ROWS):
        key = _mixed(key * MIXERS[3] + rows[:, i])
    return key.view(np.int64)


def cutoffs(percent: int = PERCENT, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, least matches): with fewer matches the posterior chance that the similarity reaches
    percent / 100 is below `miss`. It is a binomial tail, since a uniform prior gives a beta posterior."""
    t, out = percent / 100, []
    for n in range(BATCH_HASHES, HASHES + 1, BATCH_HASHES):
        chance, m = 0.0, 0
        while m <= n:
            chance += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
            if chance >= miss:
                break
            m += 1
        out.append((n, m))
    return out


# ---- passes over the texts ----------------------------------------------------------------------

def _groups(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts), some megabytes at a time."""
    texts, start, size = [], 0, 0
    for i, t in enumerate(batch.column(column)):
        texts.append(t.as_py())
        size += len(texts[-1])
        if size >= GROUP_BYTES:
            yield start, texts
            texts, start, size = [], i + 1, 0
    if texts:
        yield start, texts


def document_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """(key, n_shingles, digest, text_md5, bands): digest names the set and is null if it is empty."""
    rows = docs.select(F.col(key).cast("bigint").alias(key), text_of(text).cast("binary").alias("_text"))
    names = [key, "n_shingles", "digest", "text_md5", "bands"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for start, texts in _groups(batch, "_text"):
                known: dict[bytes, tuple] = {}
                found = []
                for t in texts:
                    md5 = hashlib.md5(t).digest()
                    if md5 not in known:
                        hashes = words.shingles(t, k)
                        known[md5] = (len(hashes), hashlib.md5(hashes.tobytes()).digest() if len(hashes) else None, md5,
                                      band_keys(signature(hashes)) if len(hashes) else np.empty(0, np.int64))
                    found.append(known[md5])
                ends = np.cumsum([0, *(len(f[3]) for f in found)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(found)), pa.array([f[0] for f in found], pa.int64()),
                     pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([f[3] for f in found])))], names)

    return rows.mapInArrow(each, f"{key} bigint, n_shingles bigint, digest binary, text_md5 binary, bands array<bigint>")


def node_facts(docs: DataFrame, wanted: DataFrame, text: str = "text", k: int = SHINGLE) -> DataFrame:
    """(node, n, signature, hashes) for the nodes of `wanted` (node, text_md5), from whole texts.

    A task sends each of its texts once, so a text with very many copies is one row per task.
    """
    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for _, texts in _groups(batch, "_text"):
                fresh = {}
                for t in texts:
                    md5 = hashlib.md5(t).digest()
                    if md5 not in seen:
                        seen.add(md5)
                        fresh[md5] = t
                yield pa.RecordBatch.from_arrays([pa.array(list(fresh), pa.binary()), pa.array(list(fresh.values()), pa.binary())],
                                                 ["text_md5", "_text"])

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = WordHashes(), set()
        for batch in batches:
            nodes = batch.column("node").to_pylist()
            for start, texts in _groups(batch, "_text"):
                out = []
                for node, t in zip(nodes[start:], texts):
                    if node not in seen:
                        seen.add(node)
                        hashes = words.shingles(t, k)
                        out.append((node, len(hashes), signature(hashes).astype("<u2").tobytes(), hashes.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                    ["node", "n", "signature", "hashes"])

    texts = docs.select(text_of(text).cast("binary").alias("_text")).mapInArrow(once, "text_md5 binary, _text binary")
    found = texts.join(wanted, "text_md5").select("node", "_text")
    return found.mapInArrow(facts, "node bigint, n bigint, signature binary, hashes binary").dropDuplicates(["node"])


# ---- candidates and their verification ----------------------------------------------------------

def open_buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node, degree, component) of all buckets with company; degree is a node's company over its buckets."""
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    shared = stored(balanced_join(members, sizes, "bucket", "node"), "minhash-members")
    degrees = shared.groupBy("node").agg(F.sum(F.col("n") - 1).alias("degree"))
    return stored(shared.join(degrees, "node").select("bucket", "node", "degree", F.col("node").alias("component")),
                  "minhash-buckets")


def pivots_of(members: DataFrame, n: int) -> DataFrame:
    """The first n nodes of each bucket, as `a` and a_ before their other columns; ranked in tasks before they are shuffled."""
    order = W.partitionBy("bucket").orderBy(F.desc("degree"), "node")
    first = members.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
    return first.select("bucket", F.col("node").alias("a"),
                        *[F.col(c).alias(f"a_{c}") for c in members.columns if c not in ("bucket", "node")])


def candidates(members: DataFrame, pivots: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Distinct (a, b): a pivot and a member of its bucket that comes after it and is in another component; in a bucket of
    a shingle the shingle must be early enough in both sets."""
    met = balanced_join(members, pivots, "bucket", "node")
    after = (F.col("degree") < F.col("a_degree")) | ((F.col("degree") == F.col("a_degree")) & (F.col("node") > F.col("a")))
    wanted = after & (F.col("component") != F.col("a_component"))
    if "place" in members.columns:
        common = _least_common(F.col("n"), F.col("a_n"), percent)
        wanted &= ((F.col("place") <= F.col("n") - common + 1) & (F.col("a_place") <= F.col("a_n") - common + 1)
                   & (F.col("own") | F.col("a_own")))
    return met.where(wanted).select("a", F.col("node").alias("b")).distinct()


def _least_common(m: Column, n: Column, percent: int) -> Column:
    """The overlap that sets of sizes m and n need for the similarity."""
    return F.ceil((m + n) * percent / (100 + percent) - 1e-6)


def shingle_buckets(members: DataFrame, facts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(bucket, node, degree, component, n, place, own): the members of open buckets, dealt anew by their first shingles.

    Shingles are ordered by the number of sets that hold them, those of one component only before all others. Buckets are
    by shingle and class of set sizes. A node is in those of its own class and, as the larger set of a pair, in
    those of the lesser sizes that it can be alike with, so the nearer the sizes the fewer its shingles that count. The
    degree is less the more nodes of the bucket are in the node's component: the few that stand beside a large component
    become pivots before it, and without them the bucket is done.
    """
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n").to_numpy()
            # a slice ends with the set that fills it
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) * 8 // GROUP_BYTES)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(lo, hi - lo)
                rows = pa.array(np.repeat(np.arange(part.num_rows), sizes[lo:hi]))
                tokens = np.frombuffer(b"".join(part.column("hashes").to_pylist()), dtype=np.int64)
                kept = part.select(["node", "component", "n"]).take(rows)
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(tokens)], [*kept.schema.names, "token"])

    still = members.select("node", "component").distinct()
    tokens = facts.select("node", "n", "hashes").join(still, "node").mapInArrow(
        each, "node bigint, component bigint, n bigint, token bigint")
    contested = (tokens.groupBy("token").agg(F.count("*").alias("sets"), F.min("component").alias("lo"), F.max("component").alias("hi"))
                 .where(F.col("lo") != F.col("hi")).select("token", "sets"))
    of_node = W.partitionBy("node")
    place = F.col("n") - F.count("*").over(of_node) + F.row_number().over(of_node.orderBy("sets", "token"))
    size_class = lambda n: F.floor(F.log(n) / SIZE_STEP)
    least = F.ceil(F.col("n") * percent / 100 - 1e-6)
    placed = tokens.join(contested, "token").withColumn("place", place).where(F.col("place") <= F.col("n") - least + 1)
    dealt = (placed.withColumn("class", F.explode(F.sequence(size_class(least), size_class(F.col("n")))))
             .withColumn("least", F.greatest(least, F.floor(F.exp(F.col("class") * SIZE_STEP)))))
    dealt = dealt.where(F.col("place") <= F.col("n") - _least_common(F.col("n"), F.col("least"), percent) + 1)
    own = F.col("class") == size_class(F.col("n"))
    dealt = stored(dealt.select(F.xxhash64("class", "token").alias("bucket"), "node", "component", "n", "place",
                                own.alias("own")), "minhash-shingles")
    several = _with_several(dealt)
    sizes = several.groupBy("bucket", "component").agg((-F.count("*")).alias("degree"))
    return stored(several.join(sizes, ["bucket", "component"]), "minhash-buckets")


def _with_facts(pairs: DataFrame, facts: DataFrame, *columns: str) -> DataFrame:
    """Both nodes' columns beside every pair; a pivot may have very many pairs."""
    side = lambda s: facts.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns])
    return balanced_join(pairs.join(side("b"), "b"), side("a"), "a", "b")


def prune(pairs: DataFrame, facts: DataFrame, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """The pairs whose signatures leave a chance of at least `miss` at every batch of hashes."""
    steps = cutoffs(percent, miss)
    alike = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(-1, HASHES)
                    for c in ("signature_a", "signature_b"))
            alive, matches, at = np.arange(len(a)), np.zeros(len(a), dtype=np.int64), 0
            for n, least in steps:
                matches[alive] += (a[alive, at:n] == b[alive, at:n]).sum(axis=1)
                alive, at = alive[matches[alive] >= least], n
            yield batch.select(["a", "b"]).take(pa.array(alive))

    known = _with_facts(pairs, facts, "n", "signature").where(alike)
    return known.select("a", "b", "signature_a", "signature_b").mapInArrow(each, "a bigint, b bigint")


def confirm(pairs: DataFrame, facts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column("hashes_a"), batch.column("hashes_b"))):
                a, b = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(a) + len(b) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    known = _with_facts(pairs, facts, "hashes").select("a", "b", "hashes_a", "hashes_b")
    return known.mapInArrow(each, "a bigint, b bigint")


def _with_several(members: DataFrame) -> DataFrame:
    """The members of the buckets that hold several components."""
    several = (members.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
               .where(F.col("lo") != F.col("hi")).select("bucket"))
    return stored(balanced_join(members, several, "bucket", "node"), "minhash-buckets")


def still_open(members: DataFrame, pivots: DataFrame, roots: DataFrame) -> DataFrame:
    """Members without the pivots, with their new components, of the buckets that hold several components."""
    rest = members.join(pivots.select("bucket", F.col("a").alias("node")), ["bucket", "node"], "left_anti")
    labelled = (rest.withColumnRenamed("component", "_old").join(roots, "node", "left")
                .withColumn("component", F.coalesce("root", "node")).select(*members.columns))
    return _with_several(stored(labelled, "minhash-rest"))


def linked_nodes(docs: DataFrame, nodes: DataFrame, text: str = "text", k: int = SHINGLE, percent: int = PERCENT,
                 miss: float = MISS) -> DataFrame:
    """(node, root) of every node that is linked with another one."""
    members = open_buckets(nodes)
    facts = stored(node_facts(docs, nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "text_md5"),
                              text, k), "minhash-facts")
    roots, turn = None, 1
    while True:
        pivots = stored(pivots_of(members, turn), "minhash-pivots")
        tried = prune(candidates(members, pivots, percent), facts.select("node", "n", "signature"), percent, miss)
        found = stored(confirm(tried, facts.select("node", "hashes"), percent), "minhash-links")
        # the stars so far have the components of all earlier links, in fewer edges and without long chains
        if roots is None:
            roots = components(found)
        elif not found.isEmpty():
            roots = components(found.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b"))))
        members = still_open(members, pivots, roots)
        if turn == 1:
            members = shingle_buckets(members, facts, percent)
        if members.isEmpty():
            return roots
        turn = min(8 * turn, MOST_PIVOTS)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT,
                    miss: float = MISS) -> DataFrame:
    """(key, n_shingles, component, kept): the least id that is reachable over links, itself included."""
    rows = stored(document_sets(docs, key, text, k).withColumn("row_no", F.monotonically_increasing_id()), "minhash-sets")
    filled = rows.where("digest is not null")
    nodes = stored(filled.groupBy("digest").agg(
        F.min("row_no").alias("node"), F.min(key).alias("first"), F.min("text_md5").alias("text_md5"),
        F.any_value("bands").alias("bands")), "minhash-nodes")
    roots = linked_nodes(docs, nodes, text, k, percent, miss)
    joined = stored(nodes.select("digest", "node", "first").join(roots, "node", "left")
                    .select("digest", "first", F.coalesce("root", "node").alias("root")), "minhash-roots")
    least = joined.groupBy("root").agg(F.min("first").alias("component"))
    labels = joined.join(least, "root").select("digest", "component")
    found = balanced_join(filled.select(key, "n_shingles", "digest", "row_no"), labels, "digest", "row_no")
    alone = rows.where("digest is null").withColumn("component", F.col(key))
    return (found.select(key, "n_shingles", "component").unionByName(alone.select(key, "n_shingles", "component"))
            .withColumn("kept", F.col(key).eqNullSafe(F.col("component"))))
