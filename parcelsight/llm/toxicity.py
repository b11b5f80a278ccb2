"""Toxicity by class-conditional Kneser-Ney models.

Each class has a bigram model over lower-cased words. Its word level counts contexts, not tokens (in how many
different words' company a word was seen in the class), so that a repeated line or a copied document counts once. Class
counts are used only where the two classes differ significantly; all other expressions, rare
ones above all, get the counts of both classes together, which cancel in the comparison. What remains is discounted and
backed off to the shared continuation counts.

A text's score compares the two log-likelihoods per word. A logistic curve, fitted on labelled rows that
the counts have not seen, turns it into a probability at the true label frequencies.

The models are fitted on at most PER_CLASS labelled rows of each class (whole texts), chosen by hash outside the
held-out fold; words are hashed to 2^WORD_BITS numbers, so the tables have a fixed size. Scoring is
one pass without a shuffle.

Defined results: a text without words (null, empty) gets the score of a text that favours neither class;
without rows of both labels every score is 0; repeated rows get equal scores; a null id is kept; a label
other than 0 and 1 is ignored; no rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelsight.llm.common import held_out, text_of
from parcelsight.llm.training import fit_logistic, labelled_sample, prior_weights, sigmoid

PER_CLASS = 3000
WORD_BITS = 18
DISCOUNT = 0.75
SIGNIFICANT = 6.0           # standard errors between the classes
CACHED_WORDS = 200_000
CHUNK = 1 << 20             # words scored at once
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 or c == 39 else 32
                for c in range(256))


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word) & ((1 << WORD_BITS) - 1)
        return found

    def ids(self, text: bytes) -> np.ndarray:
        words = text.translate(LETTERS).split()
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


@dataclass
class Model:
    word: np.ndarray            # log-likelihood ratio of every word number
    pairs: np.ndarray           # sorted significant bigrams, and their ratios
    pair: np.ndarray
    curve: np.ndarray           # of the ratio per word, per root of words, and 1

    def ratio(self, ids: np.ndarray) -> float:
        """Toxic minus ordinary log-likelihood."""
        total = 0.0
        for at in range(0, len(ids), CHUNK):
            part = ids[max(0, at - 1):at + CHUNK]
            ratios = self.word[part]
            if len(self.pairs) and len(part) > 1:
                keys = part[:-1] << WORD_BITS | part[1:]
                place = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
                ratios[1:] = np.where(self.pairs[place] == keys, self.pair[place], ratios[1:])
            total += float(ratios[1 if at else 0:].sum())
        return total


def measures(ratio: float, n: int) -> tuple[float, float]:
    return ratio / max(1, n), ratio / max(1, n) ** 0.5


def _apart(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """Whether the split of a + b is significantly different from `share`."""
    n = a + b
    return np.abs(a - n * share) > SIGNIFICANT * np.sqrt(np.maximum(n * share * (1 - share), 1e-9))


def fit_counts(toxic: list[np.ndarray], ordinary: list[np.ndarray]) -> Model:
    size, classes = 1 << WORD_BITS, []
    for texts in (toxic, ordinary):
        pairs = [np.unique(t[:-1] << WORD_BITS | t[1:]) for t in texts if len(t) > 1]
        classes.append(np.unique(np.concatenate(pairs or [np.empty(0, np.int64)]), return_counts=True))
    # word level: contexts per class, and the shared continuation counts that both back off to
    words = [np.bincount(p & (size - 1), minlength=size).astype(float) for p, _ in classes]
    sums = [max(1.0, w.sum()) for w in words]
    every = np.union1d(classes[0][0], classes[1][0])
    shared = np.bincount(every & (size - 1), minlength=size) + 0.5
    shared /= shared.sum()
    own = _apart(words[0], words[1], sums[0] / (sums[0] + sums[1]))
    left = DISCOUNT * max((w > 0).sum() / n for w, n in zip(words, sums))
    logs = [np.log(np.maximum(w - DISCOUNT, 0) / n + left * shared) for w, n in zip(words, sums)]
    word = np.where(own, logs[0] - logs[1], 0.0)
    # bigram level: documents per class that have the pair, where the classes differ
    counts = []
    for pairs, n in classes:
        at = np.searchsorted(pairs, every)
        at = np.minimum(at, max(0, len(pairs) - 1))
        counts.append(np.where(pairs[at] == every, n[at], 0).astype(float) if len(pairs) else np.zeros(len(every)))
    first, heads = every >> WORD_BITS, []
    for n in counts:
        heads.append(np.maximum(1.0, np.bincount(first, weights=n, minlength=size)))
    totals = [max(1.0, n.sum()) for n in counts]
    own = _apart(counts[0], counts[1], totals[0] / (totals[0] + totals[1]))
    probabilities = []
    for n, head, log in zip(counts, heads, logs):
        kinds = np.bincount(first, weights=(n > 0), minlength=size)
        back = DISCOUNT * kinds / head
        probabilities.append(np.maximum(n[own] - DISCOUNT, 0) / head[first[own]]
                             + np.where(kinds[first[own]] > 0, back[first[own]], 1.0) * np.exp(log[every[own] & (size - 1)]))
    pair = np.log(probabilities[0]) - np.log(probabilities[1]) if own.any() else np.empty(0)
    return Model(word, every[own], pair, np.zeros(3))


def fit(texts: list[np.ndarray], y: np.ndarray, sizes: dict) -> Model | None:
    """Counts from two thirds of the rows (dealt by place), the curve from the rest."""
    if len(np.unique(y)) < 2:
        return None
    place = np.empty(len(y), dtype=np.int64)
    for label in (0, 1):
        place[y == label] = np.arange((y == label).sum())
    seen = place % 3 != 2
    model = fit_counts([t for t, s, c in zip(texts, seen, y) if s and c == 1],
                       [t for t, s, c in zip(texts, seen, y) if s and c == 0])
    rest = ~seen if len(np.unique(y[~seen])) == 2 else np.ones(len(y), dtype=bool)
    x = np.array([measures(model.ratio(t), len(t)) for t, r in zip(texts, rest) if r])
    model.curve = fit_logistic(x, y[rest].astype(float), prior_weights(y[rest], sizes))
    return model


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          per_class: int = PER_CLASS) -> Model | None:
    usable = labels.where(F.col(label).isin(0, 1))
    rows, sizes = labelled_sample(docs, usable, key, label, per_class)
    rows = rows.select("id", "label", text_of(f"row.{text}").cast("binary").alias("_text"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for batch in batches:
            blobs = [memo.ids(t.as_py()).astype(np.uint32).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(blobs, pa.binary())],
                                             ["id", "label", "words"])

    found = sorted((r["id"], r["label"], bytes(r["words"])) for r in
                   rows.mapInArrow(numbered, "id bigint, label int, words binary").collect())
    return fit([np.frombuffer(w, dtype=np.uint32).astype(np.int64) for _, _, w in found],
               np.array([y for _, y, _ in found], dtype=np.int64), sizes)


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every column of `docs` as a struct `row`, its `score`, and the log-likelihood ratio per word."""
    rows = docs.select(F.struct("*").alias("row"), text_of(text).cast("binary").alias("_text"))
    return _scored(rows, model, "row")


def _scored(rows: DataFrame, model: Model | None, carried: str) -> DataFrame:
    schema = rows.drop("_text").withColumns({"score": F.lit(0.0), "ratio": F.lit(0.0)}).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for batch in batches:
            x = np.zeros((batch.num_rows, 2))
            for i, t in enumerate(batch.column("_text")):
                if model is not None:
                    ids = memo.ids(t.as_py())
                    x[i] = measures(model.ratio(ids), len(ids))
            p = sigmoid(x @ model.curve[:2] + model.curve[2]) if model is not None else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([batch.column(carried), pa.array(p), pa.array(x[:, 0])], schema.names)

    return rows.mapInArrow(each, schema)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted, ratio) for every document."""
    model = train(docs, labels, key, text)
    rows = docs.select(F.col(key).cast("bigint").alias(key), text_of(text).cast("binary").alias("_text"))
    return _scored(rows, model, key).select(key, held_out(key).alias("held_out"), "score",
                                            (F.col("score") >= 0.5).cast("int").alias("predicted"), "ratio")


def keep_ordinary(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with all of their columns."""
    return score(docs, train(docs, labels, key, text), key, text).where(F.col("score") < 0.5).select("row.*")
