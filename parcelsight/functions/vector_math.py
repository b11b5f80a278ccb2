"""Vector expressions: plain columns for two columns, Arrow batches for one column against constants."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Distances are compared at this precision, so equal vectors tie whatever the order of summation.
DECIMALS = 9


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two vector columns; null for unequal lengths or a zero vector."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
    times = lambda x, y: x.cast("double") * y.cast("double")
    dot = total(F.zip_with(a, b, times))
    size = F.sqrt(total(F.transform(a, lambda x: times(x, x)))) * F.sqrt(total(F.transform(b, lambda x: times(x, x))))
    return F.when((F.size(a) == F.size(b)) & (size > 0), F.lit(1.0) - dot / size)


def rows_of(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of length `dim` as a float64 matrix, and which rows those are."""
    usable = pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False)
    flat = vectors.filter(usable).flatten()
    matrix = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return matrix, np.flatnonzero(usable.to_numpy(zero_copy_only=False))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; a zero row becomes NaN, which later reads as 'no distance'."""
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    with np.errstate(divide="ignore", invalid="ignore"):
        return matrix / norms[:, None]


def distance_to(query: list[float]):
    """Column function: cosine distance of a vector column to one constant vector."""
    q = unit_rows(np.asarray(query, dtype=np.float64)[None, :])[0]

    @F.arrow_udf("double")
    def distance(vectors: pa.Array) -> pa.Array:
        matrix, where = rows_of(vectors, len(q))
        out = np.full(len(vectors), np.nan)
        out[where] = np.round(1.0 - np.einsum("ij,j->i", unit_rows(matrix), q), DECIMALS)
        return pa.array(out, mask=np.isnan(out))

    return distance


def hashed_words(text: Column, dim: int) -> Column:
    """Word buckets of a text, hashed in the JVM."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))


def bucket_vectors(dim: int):
    """Column function: unit-length bucket counts of an int array column."""

    @F.arrow_udf("array<float>")
    def to_vectors(buckets: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(buckets), 0).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(buckets)), lengths)
        cells = buckets.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.bincount(owner * dim + cells, minlength=len(buckets) * dim).reshape(-1, dim)
        norms = np.sqrt((counts.astype(np.float64) ** 2).sum(axis=1))
        unit = (counts / np.maximum(norms, 1)[:, None]).astype(np.float32)
        offsets = pa.array(np.arange(len(buckets) + 1) * dim, type=pa.int32())
        empty = pa.array(norms == 0)
        lists = pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()))
        return pc.if_else(empty, pa.scalar(None, type=lists.type), lists)

    return to_vectors
