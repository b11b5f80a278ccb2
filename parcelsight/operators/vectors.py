"""Embedding and nearest neighbours: exact, batched, by cells (IVF) and on 8-bit codes."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from parcelsight.functions.vector_math import (
    DECIMALS, bucket_vectors, distance_to, hashed_words, rows_of, unit_rows,
)
from parcelsight.operators.enrich import iso_now, text_to_embed
from parcelsight.operators.feeds import search_filter
from parcelsight.session import scratch_dir

log = logging.getLogger(__name__)

MAX_QUERY_VALUES = 4_000_000      # values of the queries that one task holds: 32 MB as doubles, 16 as floats
TILE_ROWS = 8_192                 # corpus rows per matrix product
FIRST_ROWS = 256                  # corpus rows of a task's first product
QUERY_STRIPE = 256                # queries per matrix product; both bound a product
PAIRS = 65_536                    # pairs measured in double precision at a time
PAIRS_HELD = 500_000              # candidate pairs a task gathers before it keeps the best of them
HANDED_ON = 16_384                # pairs whose ids are handed on at a time
IDS_HELD = 200_000                # id lists a task holds before it drops those no longer needed
TASKS_PER_CORE = 2                # tasks of a batch search

INDEX_COLUMNS = ("id", "embedding", "is_ai_ready", "carrier", "scenario_type", "status", "risk_score")

Embedder = Callable[[list[str]], list]


# ---- embedding ----------------------------------------------------------------------------------

def hashed_embedding(text: Column, dim: int = 256) -> Column:
    """Deterministic stand-in for a model: hashed bag of words, unit length, null without words."""
    return bucket_vectors(dim)(hashed_words(text, dim))


def hosted_embedding(embedder: Embedder) -> Callable[[Column], Column]:
    """Column function around a batch callable. A batch it fails on is halved until the text at fault
    stands alone; that one gets null and its row stays not ready."""

    def found_for(batch: list[str]) -> list:
        try:
            return list(embedder(batch))
        except Exception:
            if len(batch) < 2:
                log.exception("embedding failed for a text")
                return [None] * len(batch)
            half = len(batch) // 2
            return found_for(batch[:half]) + found_for(batch[half:])

    @F.arrow_udf("array<float>")
    def vectors(texts: pa.Array) -> pa.Array:
        return pa.array([None if v is None else [float(x) for x in v] for v in found_for(texts.to_pylist())],
                        type=pa.list_(pa.float32()))

    return vectors


def embed(rows: DataFrame, embedder: Embedder | None = None, model: str = "hashed-words",
          dim: int = 256, generated_at: Column | None = None) -> DataFrame:
    """Add the vector and mark the row AI-ready; a row without a vector keeps is_ai_ready = false."""
    text = text_to_embed()
    vector = hashed_embedding(text, dim) if embedder is None else hosted_embedding(embedder)(text)
    done = F.col("embedding").isNotNull()
    stamp = iso_now() if generated_at is None else generated_at
    return rows.withColumn("embedding", vector).withColumns({
        "is_ai_ready": done,
        "embedding_model": F.when(done, F.lit(model)),
        "embedding_dimensions": F.when(done, F.size("embedding")),
        "embedding_generated_at": F.when(done, stamp),
    })


# ---- one query ----------------------------------------------------------------------------------

def _scored(hits: DataFrame) -> DataFrame:
    gap = F.coalesce(F.col("distance"), F.lit(0.0))
    return hits.withColumn("score", F.round(F.lit(1.0) - gap, 6))


def nearest(rows: DataFrame, query: list[float], k: int) -> DataFrame:
    """k rows with the smallest distance; each task keeps k before anything travels."""
    measured = rows.withColumn("distance", distance_to(query)(F.col("embedding")))
    return _scored(measured.orderBy(F.asc_nulls_last("distance"), "id").limit(k))


def with_rank(hits: DataFrame, *keys: str) -> DataFrame:
    """Rank inside a result list that is already cut to k."""
    order = W.partitionBy(*(keys or [F.lit(0)])).orderBy(F.asc_nulls_last("distance"), "id")
    return hits.withColumn("rank", F.row_number().over(order))


def filtered_topk(processed: DataFrame, query: list[float], k: int = 10, **filters: str) -> DataFrame:
    """Scalar filters first, ranking on what is left."""
    return nearest(search_filter(processed, **filters), query, k)


# ---- many queries -------------------------------------------------------------------------------

def _keep_best(owner, dist, seq, rows, k):
    """Which vectors (of a query, at a distance, `rows` ids each) can be among a query's k nearest rows, and the distance of
    its k-th row (infinite when it has fewer): (kept positions, queries, bars).

    `seq` orders vectors by their smallest id. Ahead of a vector's first row lie all rows at a smaller distance and, among
    its ties, at least the first row of each vector before it.
    """
    order = np.lexsort((seq, dist, owner))
    owner, dist = owner[order], dist[order]
    ends = np.cumsum(rows[order])
    begins = ends - rows[order]
    at = np.arange(len(order))
    fresh = np.append(True, owner[1:] != owner[:-1])
    first = np.maximum.accumulate(np.where(fresh, at, 0))
    tie = np.maximum.accumulate(np.where(fresh | np.append(True, dist[1:] != dist[:-1]), at, 0))
    ahead = begins[tie] - begins[first] + at - tie
    last = (ends - begins[first] >= k) & (begins - begins[first] < k)
    bars = np.full(fresh.sum(), np.inf)
    bars[np.cumsum(fresh)[last] - 1] = dist[last]
    return order[ahead < k], owner[fresh], bars


class _Best:
    """The nearest vectors of every query so far, as many as its k nearest rows can have, and per query the distance of the
    k-th row. Vectors come in the order of their smallest ids."""

    def __init__(self, units: np.ndarray, k: int):
        self.units, self.k = units, k
        self.rough = units.astype(np.float32)
        self.bar = np.full(len(units), np.inf)
        self.owner, self.seq, self.dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.ids = self.room = None
        # what a single-precision product of unit rows, and a rounded distance, can be off by
        self.slack = (units.shape[1] + 8) * 2.0 ** -23 + 10.0 ** -DECIMALS

    def _room(self, columns: int) -> tuple[np.ndarray, np.ndarray]:
        """Memory for a product and its comparison, taken once: new pages cost more than the comparison."""
        if self.room is None or len(self.room[0]) < QUERY_STRIPE * columns:
            self.room = np.empty(QUERY_STRIPE * columns, np.float32), np.empty(QUERY_STRIPE * columns, bool)
        return self.room

    def _candidates(self, units, rough, rows, counts):
        """Pairs (query, corpus row, distance) that can be among the k nearest; ties stay in. Single precision
        finds them, double precision measures them. No more than k a query leave a stripe when there are many."""
        for start in range(0, len(rows), QUERY_STRIPE):
            stripe = rows[start:start + QUERY_STRIPE]
            near, passed = (b[:len(stripe) * len(rough)].reshape(len(stripe), -1) for b in self._room(len(rough)))
            np.matmul(self.rough[stripe], rough.T, out=near)
            cut = 1.0 - self.bar[stripe] - self.slack
            free = np.flatnonzero(np.isinf(cut))
            if near.shape[1] > self.k and len(free):
                at = near.shape[1] - self.k
                cut[free] = np.partition(near[free], at, axis=1)[:, at] - 2 * self.slack
            hits = np.flatnonzero(np.greater_equal(near, cut[:, None].astype(np.float32), out=passed).ravel())
            if not len(hits):
                continue
            r, c = np.divmod(hits, near.shape[1])
            q, d = stripe[r], np.empty(len(r))
            for low in range(0, len(r), PAIRS):
                part = slice(low, low + PAIRS)
                d[part] = np.round(1.0 - np.einsum("ij,ij->i", self.units[q[part]], units[c[part]]), DECIMALS)
            inside = d <= self.bar[q]
            q, c, d = q[inside], c[inside], d[inside]
            if len(q) > 2 * self.k * len(stripe):
                kept, _, _ = _keep_best(q, d, c, counts[c], self.k)
                q, c, d = q[kept], c[kept], d[kept]
            yield q, c, d

    def add(self, units, ids: pa.ListArray, groups):
        """Corpus rows, their ids, and groups (rows, queries that are to be compared with them)."""
        rough, counts = units.astype(np.float32), ids.value_lengths().to_numpy(zero_copy_only=False)
        held = 0 if self.ids is None else len(self.ids)
        found, many = [], 0

        def keep():
            if len(self.ids or ()) == held:
                self.ids = pa.concat_arrays([*([self.ids] if held else []), ids])
            self._keep(*map(np.concatenate, zip(*found)))

        for pick, rows in groups:
            for q, c, d in self._candidates(units[pick], rough[pick], rows, counts[pick]):
                found.append((q, pick[c] + held, d))
                many += len(q)
                if many > PAIRS_HELD:
                    keep()
                    found, many = [], 0
        if many:
            keep()
        if self.ids is not None and len(self.ids) > IDS_HELD:
            self._forget()

    def _keep(self, owner, seq, dist):
        touched = np.zeros(len(self.units), bool)
        touched[owner] = True
        again = touched[self.owner]
        owner, seq, dist = (np.concatenate(x) for x in (
            (self.owner[again], owner), (self.seq[again], seq), (self.dist[again], dist)))
        rows = self.ids.value_lengths().to_numpy(zero_copy_only=False)[seq]
        kept, queries, bars = _keep_best(owner, dist, seq, rows, self.k)
        self.bar[queries] = bars
        self.owner, self.seq, self.dist = (np.concatenate(x) for x in (
            (self.owner[~again], owner[kept]), (self.seq[~again], seq[kept]), (self.dist[~again], dist[kept])))

    def _forget(self):
        """Ids of vectors that no query holds any more are dropped; the order stays."""
        used, self.seq = np.unique(self.seq, return_inverse=True)
        self.ids = self.ids.take(pa.array(used))

    def hits(self) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
        """(query, id, distance) of all rows held, in pieces."""
        for low in range(0, len(self.seq), HANDED_ON):
            part = slice(low, low + HANDED_ON)
            lists = self.ids.take(pa.array(self.seq[part]))
            many = lists.value_lengths().to_numpy(zero_copy_only=False)
            yield np.repeat(self.owner[part], many), lists.flatten(), np.repeat(self.dist[part], many)


def _fingerprint() -> list[Column]:
    """128 bits of hash that stand for a vector: as a grouping key, an array of floats is rebuilt value by value."""
    return [F.xxhash64("embedding"), F.xxhash64(F.lit("again"), "embedding")]


def by_vector(corpus: DataFrame, k: int, *columns: str) -> DataFrame:
    """(ids, embedding, columns): one row per distinct vector, with the k smallest ids that have it.

    Equal vectors are equally far from every query, so a query's k nearest rows have vectors among its k nearest
    (distance, smallest id), and of each no more than k rows: nothing else has to be measured. The ids are cut to k in tasks
    before they are shuffled, so that a very common vector is a few rows of each task.
    """
    keys = [*columns, "_a", "_b"]
    rows = (corpus.where(F.col("embedding").isNotNull())
            .select("id", "embedding", *columns, *[h.alias(n) for n, h in zip(keys[-2:], _fingerprint())]))
    first = rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("id"))).where(F.col("_n") <= k)
    return (first.groupBy(*keys).agg(F.collect_list(F.struct("id")).alias("_ids"), F.first("embedding").alias("embedding"))
            .select(F.sort_array("_ids.id").alias("ids"), "embedding", *columns))


def _pair_schema(queries: DataFrame, corpus: DataFrame) -> StructType:
    return StructType([StructField("query_id", queries.schema["query_id"].dataType),
                       StructField("id", corpus.schema["id"].dataType),
                       StructField("distance", DoubleType())])


def _merge(partial: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy("distance", "id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return _scored(ranked)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(part, is it of the corpus, rows) for each run of equal parts and sides."""
    part, side = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    turns = np.flatnonzero((part[1:] != part[:-1]) | (side[1:] != side[:-1])) + 1
    for low, high in zip([0, *turns], [*turns, len(part)]):
        if high > low:
            yield int(part[low]), bool(side[low]), batch.slice(low, high - low)


class _Block:
    """The queries of one part of the grid, and what has been found for them."""

    def __init__(self, k: int, dim: int, tile_rows: int, centres: np.ndarray | None, nprobe: int):
        self.k, self.dim, self.tile_rows, self.centres, self.nprobe = k, dim, tile_rows, centres, nprobe
        self.asked, self.best, self.seen = [], None, 0

    def _sound(self, batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
        """Unit vectors of the rows that have a direction, and which rows those are."""
        matrix, where = rows_of(batch.column("embedding"), self.dim)
        units = unit_rows(matrix)
        sound = ~np.isnan(units).any(axis=1)
        return units[sound], pa.array(where[sound])

    def ask(self, batch: pa.RecordBatch) -> None:
        units, where = self._sound(batch)
        self.asked.append((units, batch.column("query_id").take(where)))

    def _begin(self) -> None:
        self.names = pa.concat_arrays([names for _, names in self.asked])
        units = np.concatenate([u for u, _ in self.asked])
        self.asked, self.best = [], _Best(units, self.k)
        self.everybody, self.probes = np.arange(len(units)), {}
        if self.centres is not None:
            cells = _nearest_cells(self.centres, units, self.nprobe)
            self.probes = {int(c): np.flatnonzero((cells == c).any(axis=1)) for c in np.unique(cells)}

    def meet(self, batch: pa.RecordBatch) -> None:
        """The queries come first; a part without any has nothing to find."""
        if self.best is None:
            if not self.asked:
                return
            self._begin()
        low = 0
        while low < batch.num_rows:
            # small products first: until a query has k rows, every product has to be searched for its k best
            tile = batch.slice(low, min(self.tile_rows, max(FIRST_ROWS, 4 * self.k, self.seen)))
            low, self.seen = low + tile.num_rows, self.seen + tile.num_rows
            units, where = self._sound(tile)
            if self.centres is None:
                groups = [(np.arange(len(units)), self.everybody)]
            else:
                inside = tile.column("cell").take(where).to_numpy(zero_copy_only=False)
                groups = [(np.flatnonzero(inside == c), self.probes[c]) for c in np.unique(inside) if c in self.probes]
            if len(units) and len(self.everybody):
                self.best.add(units, tile.column("ids").take(where), groups)

    def found(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for owner, ids, dist in self.best.hits() if self.best is not None else ():
            yield pa.RecordBatch.from_arrays([self.names.take(pa.array(owner)), ids, pa.array(dist)], schema=schema)


def _search(queries: DataFrame, distinct: DataFrame, k: int, n_queries: int, dim: int, max_values: int, tile_rows: int,
            schema: StructType, centres: np.ndarray | None = None, nprobe: int = 0) -> DataFrame:
    """Queries of one width against the rows of `by_vector`: (query_id, id, distance), k or a few more a query and part.

    A grid of query blocks and corpus stripes, one task each. A task holds its block and what was found for it, and the
    vectors of its stripe pass by in the order of their smallest ids, so its memory does not grow with either table.
    """
    spark = distinct.sparkSession
    out = to_arrow_schema(schema)
    blocks = max(-(-n_queries // max(max_values // dim, 1)), 1)
    stripes = -(-TASKS_PER_CORE * spark.sparkContext.defaultParallelism // blocks)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    cell = [] if centres is None else ["cell"]
    part = (F.col("_block") * stripes + F.col("_stripe")).alias("_part")
    left = (queries.withColumns({"_block": dealt(blocks, "query_id", "embedding"), "_stripe": every(stripes)})
            .select(part, F.lit(False).alias("_side"), "embedding", "query_id"))
    right = (distinct.withColumns({"_stripe": dealt(stripes, "embedding"), "_block": every(blocks)})
             .select(part, F.lit(True).alias("_side"), "embedding", "ids", *cell))
    met = (left.unionByName(right, allowMissingColumns=True).repartitionById(blocks * stripes, "_part")
           .sortWithinPartitions("_part", "_side", F.get("ids", F.lit(0))))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None
        for batch in batches:
            for number, of_corpus, rows in _runs(batch):
                if number != now:
                    if block is not None:
                        yield from block.found(out)
                    now, block = number, _Block(k, dim, tile_rows, centres, nprobe)
                (block.meet if of_corpus else block.ask)(rows)
        if block is not None:
            yield from block.found(out)

    return met.mapInArrow(best, schema)


def topk_batch(queries: DataFrame, corpus: DataFrame, k: int = 10,
               max_values: int = MAX_QUERY_VALUES, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Exact k nearest corpus rows for every query: (query_id, id, distance, rank, score).

    Each task multiplies a block of queries, of `max_values` values, with a stripe of the distinct corpus vectors, at most
    `tile_rows` at a time, and hands on about k rows per query, so pairs are never materialised. Queries of several widths
    take a pass per width, each over the corpus rows of that width.
    """
    return _topk_distinct(queries, by_vector(corpus, k), k, _pair_schema(queries, corpus), max_values, tile_rows)


def _topk_distinct(queries: DataFrame, distinct: DataFrame, k: int, schema: StructType,
                   max_values: int = MAX_QUERY_VALUES, tile_rows: int = TILE_ROWS) -> DataFrame:
    queries = queries.select("query_id", "embedding").where(F.col("embedding").isNotNull())
    size = F.array_size("embedding")
    widths = sorted((r["d"], r["n"]) for r in
                    queries.where(size > 0).groupBy(size.alias("d")).agg(F.count("*").alias("n")).collect())
    passes = [_search(queries.where(size == d), distinct.where(size == d), k, n, d, max_values, tile_rows, schema)
              for d, n in widths]
    empty = distinct.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, [_merge(found, k) for found in passes]) if passes else _merge(empty, k)


# ---- cells (IVF) --------------------------------------------------------------------------------

def train_cells(corpus: DataFrame, n_cells: int, seed: int = 7, max_iter: int = 10) -> KMeansModel:
    """Cell centres, fitted on all rows: equal vectors are one point that weighs as much as its rows.

    The points are stored, because a fit reads its input several times before it keeps it.
    """
    context = corpus.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(scratch_dir(corpus.sparkSession, "points"))
    points = (corpus.where(F.array_size("embedding") > 0).groupBy("embedding").agg(F.count("*").alias("weight"))
              .select(array_to_vector("embedding").alias("features"), F.col("weight").cast("double").alias("weight")))
    return (KMeans(k=n_cells, distanceMeasure="cosine", seed=seed, maxIter=max_iter, weightCol="weight")
            .fit(points.checkpoint()))


def index_rows(processed: DataFrame) -> DataFrame:
    """What a search needs: id, vector and filter columns. Hits get their other columns by id."""
    return processed.select(*INDEX_COLUMNS)


def assign_cells(corpus: DataFrame, model: KMeansModel) -> DataFrame:
    rows = corpus.where(F.array_size("embedding") > 0)
    return (model.setPredictionCol("cell")
            .transform(rows.withColumn("features", array_to_vector("embedding"))).drop("features"))


def write_cells(assigned: DataFrame, path: str) -> None:
    """One folder per cell. The rebalance hint lets AQE cut an over-full cell into several files."""
    assigned.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(path)


def _nearest_cells(centres: np.ndarray, units: np.ndarray, nprobe: int) -> np.ndarray:
    return np.argsort(1.0 - units @ centres.T, axis=1, kind="stable")[:, :nprobe]


def _centres(model: KMeansModel) -> np.ndarray:
    return unit_rows(np.array(model.clusterCenters()))


def ann_topk(cells: DataFrame, model: KMeansModel, query: list[float], k: int = 10, nprobe: int = 4,
             **filters: str) -> DataFrame:
    """Search only the nearest cells; on a table written by `write_cells` the others are pruned."""
    q = unit_rows(np.asarray(query, dtype=np.float64)[None, :])
    probes = [int(c) for c in _nearest_cells(_centres(model), q, nprobe)[0]]
    return filtered_topk(cells.where(F.col("cell").isin(probes)), query, k, **filters)


def _probed(queries: DataFrame, centres: np.ndarray, nprobe: int) -> list[int]:
    """The cells that any of the queries probes."""
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = unit_rows(rows_of(batch.column(0), centres.shape[1])[0])
            near = _nearest_cells(centres, units[~np.isnan(units).any(axis=1)], nprobe)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(near), pa.int32())], ["cell"])

    return sorted(r["cell"] for r in queries.select("embedding").mapInArrow(cells, "cell int").distinct().collect())


def ann_topk_batch(queries: DataFrame, cells: DataFrame, model: KMeansModel, k: int = 10,
                   nprobe: int = 4, max_values: int = MAX_QUERY_VALUES) -> DataFrame:
    """Approximate `topk_batch`: every query meets the vectors of its nearest cells only."""
    centres = _centres(model)
    probed = cells.where(F.col("cell").isin(_probed(queries, centres, nprobe)))
    return _ann_distinct(queries, by_vector(probed, k, "cell"), centres, k, nprobe, _pair_schema(queries, cells), max_values)


def _ann_distinct(queries: DataFrame, distinct: DataFrame, centres: np.ndarray, k: int, nprobe: int, schema: StructType,
                  max_values: int = MAX_QUERY_VALUES) -> DataFrame:
    dim, size = centres.shape[1], F.array_size("embedding")
    queries = queries.select("query_id", "embedding").where(size == dim)
    found = _search(queries, distinct.where(size == dim), k, queries.count(), dim, max_values, TILE_ROWS, schema,
                    centres, nprobe)
    return _merge(found, k)


def recall_by_probes(queries: DataFrame, cells: DataFrame, model: KMeansModel, k: int,
                     nprobes: list[int]) -> DataFrame:
    """Share of the exact hits found per number of probed cells; the basis for choosing `nprobe`.

    The distinct vectors are stored once; every search reads them.
    """
    spark, schema, centres = cells.sparkSession, _pair_schema(queries, cells), _centres(model)
    path = scratch_dir(spark, "vectors")
    by_vector(cells, k, "cell").write.parquet(path)
    distinct = spark.read.parquet(path)
    found = reduce(DataFrame.unionByName, [
        _ann_distinct(queries, distinct, centres, k, n, schema).select(
            F.lit(n).alias("nprobe"), "query_id", "id", F.lit(1).alias("found")) for n in nprobes])
    exact = _topk_distinct(queries, distinct, k, schema).select(
        F.explode(F.array(*[F.lit(n) for n in nprobes])).alias("nprobe"), "query_id", "id")
    return (exact.join(found, ["nprobe", "query_id", "id"], "left").groupBy("nprobe")
            .agg(F.count("*").alias("pairs"), F.count("found").alias("hits"))
            .withColumn("recall", F.col("hits") / F.col("pairs")))


# ---- 8-bit codes --------------------------------------------------------------------------------

def sq8_ranges(corpus: DataFrame) -> tuple[list[float], list[float]]:
    """Smallest and largest value per dimension; reduced map-side to one row per dimension."""
    spread = corpus.select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(
        F.min("x").cast("double").alias("lo"), F.max("x").cast("double").alias("hi"))
    rows = spread.orderBy("pos").collect()
    return [r["lo"] for r in rows], [r["hi"] for r in rows]


def sq8_quantize(corpus: DataFrame, lo: list[float], hi: list[float]) -> DataFrame:
    """Adds `codes`, one signed byte per dimension."""
    low = F.lit([float(x) for x in lo])
    step = F.lit([(h - l) / 255 for l, h in zip(lo, hi)])
    code = lambda x, i: F.when(F.get(step, i) > 0, F.round((x - F.get(low, i)) / F.get(step, i))).otherwise(0)
    clipped = lambda x, i: (F.least(F.greatest(code(x, i), F.lit(0)), F.lit(255)) - 128).cast("tinyint")
    return corpus.withColumn("codes", F.transform("embedding", clipped))


def sq8_distance_to(query: list[float], lo: list[float], hi: list[float]):
    """Column function: distance of the decoded codes to one constant vector."""
    q = unit_rows(np.asarray(query, dtype=np.float64)[None, :])[0]
    low, step = np.array(lo), (np.array(hi) - np.array(lo)) / 255

    @F.arrow_udf("double")
    def distance(codes: pa.Array) -> pa.Array:
        matrix, where = rows_of(codes, len(q))
        units = unit_rows((matrix + 128) * step + low)
        out = np.full(len(codes), np.nan)
        out[where] = np.round(1.0 - np.einsum("ij,j->i", units, q), DECIMALS)
        return pa.array(out, mask=np.isnan(out))

    return distance


def sq8_topk(coded: DataFrame, query: list[float], lo: list[float], hi: list[float], k: int = 10,
             widen: int = 4) -> DataFrame:
    """Rank on the codes, keep `widen`·k, then order those by the exact distance."""
    rough = coded.withColumn("rough", sq8_distance_to(query, lo, hi)(F.col("codes")))
    short = rough.orderBy(F.asc_nulls_last("rough"), "id").limit(k * widen)
    return nearest(short, query, k)
