"""Quality by hierarchical empirical Bayes: what a document shows, and what its site has shown.

A logistic classifier on a dozen simple measures of the text gives each document's own evidence. Sites are
two levels deep: hosts, and paths within hosts. Each level's mean is shrunk towards the level above by a Beta prior
whose strength is estimated from the data: the more the sites of a level differ beyond chance, the less they are shrunk,
and a site with few documents stays near its parent. A document's score joins its own log-odds with those of its path,
measured from the global mean; its own evidence is left out of its site's sums.

Sums per site are combined in every task before they are shuffled, a few numbers cross the driver, and
the join back splits the rows of a hot site. The classifier is fitted on at most PER_CLASS labelled rows of each
class (whole texts), chosen by hash outside the held-out fold.

Defined results: a document without a site has its own evidence only; one without a path stands under its
host alone; several pages of a document give it the first by (host, path); a null text has the measures of an empty one; without rows
of both labels the evidence is 0.5 throughout; a null id joins no site; repeated rows count and are scored each; no
rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelsight.llm.common import held_out, stored, text_of
from parcelsight.llm.quality_rules import (
    DIGIT, LINE, STOP, SYMBOL, UPPER, WIDE, class_counts, repeated_lines, repeated_words,
)
from parcelsight.llm.substrings import Words
from parcelsight.llm.training import fit_logistic, labelled_sample, prior_weights, sigmoid
from parcelsight.operators.skew import balanced_join

PER_CLASS = 3000
LEAST = 1e-3                # evidence is kept off 0 and 1 by this much
MOST_STRENGTH = 1e6         # documents that a prior may count for
FEATURES = 12


def features(data: bytes, memo: Words) -> list[float]:
    words, octets = data.split(), np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, classes = max(1, len(words)), class_counts(octets)
    chars = max(1, int(classes.sum()))
    hashes = memo.of(words)
    lines = max(1, int(classes[LINE]) + 1)
    return [np.log1p(len(words)), min(chars / n, 100.0), classes[UPPER] / chars, classes[DIGIT] / chars, classes[STOP] / chars,
            classes[SYMBOL] / chars, classes[WIDE] / chars, repeated_words(hashes) / n, repeated_lines(data) / lines,
            len(np.unique(hashes)) / n ** 0.9, int((hashes[1:] == hashes[:-1]).sum()) / n, min(n / lines, 100.0) / 100.0]


def _measured(rows: DataFrame, carried: list[str]) -> DataFrame:
    """The carried columns and the features of `_text`."""
    schema = rows.select(*carried).withColumn("x", F.array(F.lit(0.0))).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for batch in batches:
            x = [features(t.as_py(), memo) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], pa.array(x, pa.list_(pa.float64()))], schema.names)

    return rows.select(*carried, "_text").mapInArrow(each, schema)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          per_class: int = PER_CLASS) -> np.ndarray | None:
    """Coefficients of the features and of 1, or None without rows of both labels."""
    rows, sizes = labelled_sample(docs, labels.where(F.col(label).isin(0, 1)), key, label, per_class)
    rows = rows.select("id", F.col("label").cast("int").alias("label"), text_of(f"row.{text}").cast("binary").alias("_text"))
    found = sorted((r["id"], r["label"], *r["x"]) for r in _measured(rows, ["id", "label"]).collect())
    y = np.array([r[1] for r in found])
    if len(np.unique(y)) < 2:
        return None
    return fit_logistic(np.array([r[2:] for r in found]), y.astype(float), prior_weights(y, sizes))


def evidence(docs: DataFrame, curve: np.ndarray | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, own): every document's own probability of being good."""
    rows = docs.select(F.col(key).cast("bigint").alias(key), text_of(text).cast("binary").alias("_text"))
    if curve is None:
        return rows.select(key, F.lit(0.5).alias("own"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for batch in batches:
            x = np.array([features(t.as_py(), memo) for t in batch.column(1)]).reshape(-1, FEATURES)
            p = np.clip(sigmoid(x @ curve[:-1] + curve[-1]), LEAST, 1 - LEAST)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], [key, "own"])

    return rows.mapInArrow(each, f"{key} bigint, own double")


def page_sites(pages: DataFrame, key: str = "doc_id", url: str = "url") -> DataFrame:
    """(key, host, path) from addresses whose path ends in a document's number: the first site of each."""
    parts = pages.select(F.lower(F.regexp_extract(url, r"^\w+://(?:www\.)?([^/?#]+)", 1)).alias("host"),
                         F.regexp_extract(url, r"^\w+://[^/?#]+(/(?:[^/?#]*/)*)\d+", 1).alias("path"),
                         F.regexp_extract(url, r"^\w+://[^/?#]+/(?:[^/?#]*/)*(\d{1,18})", 1).alias("n"))
    site = F.struct("host", F.concat("host", "path").alias("path"))
    return (parts.where((F.col("n") != "") & (F.col("host") != ""))
            .groupBy(F.col("n").cast("bigint").alias(key)).agg(F.min(site).alias("site"))
            .select(key, "site.host", "site.path"))


def log_odds(p: Column) -> Column:
    return F.ln(p / (F.lit(1.0) - p))


def strength(between: float, within: float, groups: int, rows: int, squares: float, mean: float) -> float:
    """How many documents the prior of a level counts for, by the method of moments.

    between: sum of n (m - parent's mean)^2 over the groups, within: sum of squares inside the groups, squares: sum of
    n^2. A level whose groups differ no more than chance would have them is shrunk all the way.
    """
    if groups < 2 or rows <= groups:
        return MOST_STRENGTH
    noise = within / (rows - groups)
    spread = (between - (groups - 1) * noise) / max(1e-9, rows - squares / rows)
    return float(min(MOST_STRENGTH, max(1e-3, mean * (1 - mean) / spread - 1))) if spread > 0 else MOST_STRENGTH


def quality_scores(docs: DataFrame, labels: DataFrame, sites: DataFrame, key: str = "doc_id", text: str = "text",
                   label: str = "quality") -> DataFrame:
    """(key, held_out, host, path, own, host_score, path_score, score, predicted, kept) for every document.

    `sites` has (key, host, path) with one row per key.
    """
    own = stored(evidence(docs, train(docs, labels, key, text, label), key, text), "evidence")
    placed = stored(own.join(sites.select(key, "host", "path"), key, "left"), "placed")
    total = placed.agg(F.count("*").alias("n"), F.avg("own").alias("mean")).first()
    mean = min(1 - LEAST, max(LEAST, total["mean"])) if total["n"] else 0.5

    paths = stored(placed.where(F.col("host").isNotNull()).groupBy("host", "path")
                   .agg(F.count("*").alias("n"), F.sum("own").alias("s"), F.sum(F.col("own") * F.col("own")).alias("q")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("q").alias("hq"))
    top = hosts.agg(F.count("*").alias("g"), F.sum("hn").alias("n"), F.sum(F.col("hn") * F.col("hn")).alias("sq"),
                    F.sum(F.col("hn") * F.pow(F.col("hs") / F.col("hn") - mean, F.lit(2.0))).alias("between"),
                    F.sum(F.col("hq") - F.col("hs") * F.col("hs") / F.col("hn")).alias("within")).first()
    known = paths.where(F.col("path").isNotNull()).join(hosts, "host")
    low = known.agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("sq"),
                    F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("hs") / F.col("hn"), F.lit(2.0))).alias("between"),
                    F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within")).first()
    of_host, of_path = (strength(r["between"] or 0.0, r["within"] or 0.0, r["g"], r["n"] or 0, r["sq"] or 0.0, mean)
                        for r in (top, low))

    sums = (paths.join(hosts, "host").select(F.xxhash64("host", "path").alias("site"), "n", "s", "hn", "hs"))
    keyed = placed.withColumn("site", F.when(F.col("host").isNotNull(), F.xxhash64("host", "path")))
    joined = balanced_join(keyed, sums, "site", key, "left")
    # means of the others on the site: the document's own evidence is taken out
    host = F.when(F.col("hn").isNotNull(), (F.col("hs") - F.col("own") + F.lit(of_host * mean)) / (F.col("hn") - 1 + F.lit(of_host)))
    joined = joined.withColumn("host_score", F.coalesce(host, F.lit(mean)))
    path = F.when(F.col("path").isNotNull() & F.col("n").isNotNull(),
                  (F.col("s") - F.col("own") + F.lit(of_path) * F.col("host_score")) / (F.col("n") - 1 + F.lit(of_path)))
    joined = joined.withColumn("path_score", F.coalesce(path, F.col("host_score")))
    site = F.least(F.lit(1 - LEAST), F.greatest(F.lit(LEAST), F.col("path_score")))
    odds = log_odds(F.col("own")) + log_odds(site) - F.lit(float(np.log(mean / (1 - mean))))
    scored = joined.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-odds)))
    return scored.select(key, held_out(key).alias("held_out"), "host", "path", "own", "host_score", "path_score", "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= 0.5).alias("kept"))
