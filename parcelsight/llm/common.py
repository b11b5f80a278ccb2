"""What several operators of this folder share: words, folds, stored tables and running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parcelsight.session import scratch_dir

# A word is a run of anything but these bytes. bytes.split() cuts at exactly the same ones.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
FOLDS = 5


def text_of(c: str = "text") -> Column:
    """A missing text counts as an empty one."""
    return F.coalesce(F.col(c), F.lit(""))


def n_words(c: str = "text") -> Column:
    return F.regexp_count(text_of(c), F.lit(WORD)).cast("bigint")


def key_text(c: str = "doc_id") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def held_out(c: str = "doc_id") -> Column:
    """Rows of the fold that no model may learn labels from."""
    return (F.crc32(key_text(c).cast("binary")) % FOLDS) == 0


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written once into the shared scratch folder, so that later steps neither compute them
    again nor depend on the executors that made them."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_start(df: DataFrame, group: str, cell: str, order: list[str], weight: Column, out: str,
                  cells: DataFrame | None = None) -> DataFrame:
    """Adds `out`: the summed weight of all rows that come before a row of its group.

    Rows are ordered by (cell, order). `cell` cuts a group into parts that single tasks can sort, so
    that a group with a third of all rows is many small sorts: cell totals are summed first and only
    they are ordered per group. `group` and `cell` must not be null. `cells` may bring the totals as
    (group, cell, total), if the caller has them stored.
    """
    if cells is None:
        cells = df.groupBy(group, cell).agg(F.sum(weight).alias("total"))
    before = W.partitionBy(group).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    offsets = cells.select(group, cell, F.coalesce(F.sum("total").over(before), F.lit(0)).alias("_offset"))
    inside = (W.partitionBy(group, cell).orderBy(*order)
              .rowsBetween(W.unboundedPreceding, -1))
    return (df.join(offsets, [group, cell])
            .withColumn(out, F.col("_offset") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
            .drop("_offset"))
