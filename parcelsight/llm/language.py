"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its character n-grams within words (word ends count as a
character). The n-grams are hashed to a fixed number of buckets. Embeddings and the softmax are trained together by stochastic gradient
descent in numpy. A temperature, fitted on rows that training has not seen, makes the highest
probability an honest score; below a threshold, set on the same rows so that what is accepted is right often
enough, the answer counts as rejected.

The model is fitted on at most PER_CLASS labelled rows of each language (whole texts), chosen by hash outside the
held-out fold. Since both layers are linear, it is shipped as one table of buckets by languages. Prediction is one
pass without a shuffle, over whole texts.

Defined results: a text that is null or has no letter is `und` with score 0 and rejected; without any
labelled row all texts are; with one language that is always the answer; repeated rows get equal answers; a null id is
kept; no rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelsight.llm.common import held_out, text_of
from parcelsight.llm.training import labelled_sample

PER_CLASS = 600
BUCKETS = 1 << 14
SIZES = (1, 2, 3)
WIDTH = 16
EPOCHS = 8
RATE = 0.5
ACCEPTED_RIGHT = 0.99
CHUNK = 1 << 19             # characters hashed at once
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x10000)])


def characters(text: str) -> np.ndarray:
    """Lower-cased letters as code points, one 0 for every run of other characters and at both ends; empty
    if there is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    letter = _letters()[np.minimum(points, 0xFFFF)]
    astral = points > 0xFFFF
    if astral.any():
        letter[astral] = [chr(p).isalpha() for p in points[astral]]
    if not letter.any():
        return np.empty(0, dtype=np.int64)
    points = np.concatenate(([0], np.where(letter, points, 0), [0]))
    return points[np.concatenate(([True], (points[1:] != 0) | (points[:-1] != 0)))]


def subwords(points: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams that do not reach over a word's end, a chunk at a time."""
    for at in range(0, len(points), CHUNK):
        for n in SIZES:
            part = points[at:at + CHUNK + n - 1]
            runs = len(part) - n + 1
            if runs <= 0:
                continue
            number, inside = np.full(runs, n, dtype=np.uint64), np.ones(runs, dtype=bool)
            for i in range(n):
                own = part[i:i + runs]
                number = (number ^ own.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                number ^= number >> np.uint64(29)
                if n == 1 or 0 < i < n - 1:
                    inside &= own != 0
            yield (number[inside] % np.uint64(BUCKETS)).astype(np.int64)


def counts(points: np.ndarray) -> np.ndarray:
    out = np.zeros(BUCKETS, dtype=np.int64)
    for part in subwords(points):
        out += np.bincount(part, minlength=BUCKETS)
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray           # (buckets, languages): embeddings times the softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, averages: np.ndarray) -> np.ndarray:
        """From rows of averaged table rows."""
        x = (averages + self.bias) / self.temperature
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def average(self, points: np.ndarray) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for part in subwords(points):
            total += self.table[part].sum(axis=0)
            n += len(part)
        return total / max(1, n)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], languages: list[str], seed: int = 7) -> Model:
    """From (language, buckets, counts): every fifth row of a language is kept for the calibration."""
    place, train, rest = dict.fromkeys(languages, 0), [], []
    for lang, at, n in rows:
        place[lang] += 1
        (rest if place[lang] % 5 == 0 else train).append((languages.index(lang), at, n / n.sum()))
    rng = np.random.default_rng(seed)
    embed, weights = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)), np.zeros((WIDTH, len(languages)))
    bias = np.zeros(len(languages))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(train)):
            y, at, share = train[i]
            mean = share @ embed[at]
            x = mean @ weights + bias
            g = np.exp(x - x.max())
            g /= g.sum()
            g[y] -= 1
            back = weights @ g
            weights -= rate * np.outer(mean, g)
            bias -= rate * 0.1 * g
            # averaging spreads a step over many buckets, so their rate is raised by their number
            embed[at] -= (rate * len(at)) * share[:, None] * back[None, :]
    model = Model(languages, embed @ weights, bias)
    if rest:
        x = np.array([share @ model.table[at] for _, at, share in rest])
        y = np.array([c for c, _, _ in rest])
        # n right answers out of n still leave a chance of about 1 / (n + 2) of the next being wrong
        miss = 1.0 / (len(y) + 2)
        goal = np.full((len(y), len(languages)), miss / max(1, len(languages) - 1))
        goal[np.arange(len(y)), y] = 1.0 - miss
        grid = np.exp(np.linspace(np.log(0.05), np.log(5000), 241))
        losses = []
        for t in grid:
            model.temperature = t
            p = np.log(np.maximum(model.probabilities(x), 1e-300))
            losses.append(-(p * goal).sum(axis=1).mean())
        model.temperature = float(grid[int(np.argmin(losses))])
        p = model.probabilities(x)
        top, right = p.max(axis=1), p.argmax(axis=1) == y
        order = np.argsort(-top)
        good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(y) + 1) >= ACCEPTED_RIGHT)
        model.threshold = float(top[order[good[-1]]]) if len(good) else 1.0
    return model


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
          per_class: int = PER_CLASS) -> Model | None:
    rows, _ = labelled_sample(docs, docs, key, lang, per_class)
    rows = rows.select("id", F.col("label").cast("string").alias("label"), text_of(f"row.{text}").alias("_text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = [], []
            for t in batch.column(2):
                found = counts(characters(t.as_py()))
                used = np.flatnonzero(found)
                at.append(used.astype(np.int32).tobytes())
                n.append(found[used].astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.binary()), pa.array(n, pa.binary())],
                                             ["id", "label", "at", "n"])

    found = sorted((r["id"], r["label"], bytes(r["at"]), bytes(r["n"])) for r in
                   rows.mapInArrow(counted, "id bigint, label string, at binary, n binary").collect())
    usable = [(y, np.frombuffer(at, np.int32), np.frombuffer(n, np.int64)) for _, y, at, n in found if at]
    return fit(usable, sorted({y for y, _, _ in usable})) if usable else None


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, lang_pred, score, rejected) for every document."""
    rows = docs.select(F.col(key).cast("bigint").alias(key), text_of(text).alias("_text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x, known = np.zeros((n, len(model.languages) if model else 1)), np.zeros(n, dtype=bool)
            for i, t in enumerate(batch.column(1)):
                points = characters(t.as_py())
                if model is not None and len(points):
                    x[i], known[i] = model.average(points), True
            p = model.probabilities(x) if model is not None else x
            best, top = p.argmax(axis=1), np.where(known, p.max(axis=1), 0.0)
            names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
            rejected = top < model.threshold if model is not None else np.ones(n, dtype=bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(top), pa.array(rejected | ~known)],
                                             [key, "lang_pred", "score", "rejected"])

    found = rows.mapInArrow(each, f"{key} bigint, lang_pred string, score double, rejected boolean")
    return found.select(key, held_out(key).alias("held_out"), "lang_pred", "score", "rejected")


def identify_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    return identify(docs, train(docs, key, text, lang), key, text)
