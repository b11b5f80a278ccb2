"""Quality rules by distribution divergence.

Every language has two references, counted over all documents that name it: how its characters spread over a few
classes, and how its words spread over its most common words and the rest. A document is compared with the
language it is nearest to, by Jensen-Shannon distance (base 2, so from 0 to 1): prose of any known
language is near one of them, while shouted, symbol-ridden or listed text is near none. Short texts are noisy, so each distance
counts only from a minimum length on, and the limit for words is wider the fewer there are.

References are sums over all rows: partial counts per task, one shuffle of (language, word, count), and the
top words per language. What reaches the driver is bounded by MAX_LANGUAGES times COMMON words. Judging is one
pass without a shuffle, over whole texts.

Defined results: a null text has no words and fails the base rules, as does any text under 20 words; documents without a
language are judged but not counted; without any language only the base rules decide; repeated rows
are judged alike; a null id is kept; no rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parcelsight.llm.common import text_of
from parcelsight.llm.substrings import Words, run_hashes

COMMON = 64
MAX_LANGUAGES = 200
HELD_WORDS = 100_000        # distinct words that a task counts before it passes the counts on
MIN_WORDS = 40              # from here on the word distance counts
MIN_CHARS = 100             # from here on the character distance counts
WORD_LIMIT, WORD_SLACK = 0.20, 2.2      # a text of n words may be LIMIT + SLACK / sqrt(n) away
CHAR_LIMIT, CHAR_SLACK = 0.20, 1.2      # likewise for n characters
RUN = 8                     # words that make a repeated run
SYMBOLS = b"#*$%&|<>"
CHARS, WORDS, TOTAL = range(3)  # kinds of counts
# classes of bytes: a character beyond ASCII counts by its first byte
LOWER, UPPER, DIGIT, SPACE, LINE, STOP, SYMBOL, OTHER, WIDE, INNER = range(10)


def _classes() -> np.ndarray:
    out = np.full(256, OTHER)
    for c in range(256):
        if 97 <= c <= 122:
            out[c] = LOWER
        elif 65 <= c <= 90:
            out[c] = UPPER
        elif 48 <= c <= 57:
            out[c] = DIGIT
        elif c in b" \t\r\x0b\x0c":
            out[c] = SPACE
        elif c == 10:
            out[c] = LINE
        elif c in b".,;:'!?\"()-":
            out[c] = STOP
        elif c in SYMBOLS:
            out[c] = SYMBOL
        elif c >= 0xC0:
            out[c] = WIDE
        elif c >= 0x80:
            out[c] = INNER
    return out


CLASS = _classes()
SPACES = np.array([c in b" \t\n\r\x0b\x0c" for c in range(256)])


def class_counts(octets: np.ndarray) -> np.ndarray:
    return np.bincount(CLASS, weights=octets, minlength=10)[:INNER].astype(np.int64)


@dataclass
class References:
    languages: list[str]
    classes: np.ndarray         # (languages, classes): shares
    words: list[bytes]          # all common words
    picks: list[np.ndarray]     # per language the places of its words in `words`
    shares: list[np.ndarray]    # per language the shares of its words, and of the rest


def references(docs: DataFrame, text: str = "text", lang: str = "lang", common: int = COMMON) -> References:
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"),
                                                      text_of(text).cast("binary").alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(seen)
            out = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                 pa.array([k[2] for k in keys], pa.binary()), pa.array(list(seen.values()), pa.int64())],
                ["lang", "kind", "token", "n"])
            seen.clear()
            return out

        for batch in batches:
            for name, body in zip(batch.column(0), batch.column(1)):
                name, data = name.as_py(), body.as_py()
                for i, n in enumerate(class_counts(np.bincount(np.frombuffer(data, np.uint8), minlength=256)).tolist()):
                    seen[name, CHARS, bytes([i])] += n
                own = Counter(data.lower().split())
                seen[name, TOTAL, b""] += own.total()
                for word, n in own.items():
                    seen[name, WORDS, word] += n
                if len(seen) > HELD_WORDS:
                    yield flush()
        if seen:
            yield flush()

    counted = (rows.mapInArrow(count, "lang string, kind int, token binary, n bigint")
               .groupBy("lang", "kind", "token").agg(F.sum("n").alias("n")))
    order = W.partitionBy("lang", "kind").orderBy(F.desc("n"), "token")
    found = (counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= common)
             .limit(MAX_LANGUAGES * (common + INNER + 2) + 1).collect())
    if len(found) > MAX_LANGUAGES * (common + INNER + 2):
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    by: dict[str, dict] = {}
    for r in found:
        by.setdefault(r["lang"], {})[r["kind"], bytes(r["token"])] = r["n"]
    languages = sorted(k for k, v in by.items() if v.get((TOTAL, b""), 0) > 0)
    words = sorted({t for k in languages for kind, t in by[k] if kind == WORDS})
    at = {w: i for i, w in enumerate(words)}
    classes, picks, shares = np.zeros((len(languages), INNER)), [], []
    for i, name in enumerate(languages):
        own = by[name]
        for c in range(INNER):
            classes[i, c] = own.get((CHARS, bytes([c])), 0)
        top = [(t, n) for (kind, t), n in own.items() if kind == WORDS]
        picks.append(np.array([at[t] for t, _ in top], dtype=np.int64))
        counts = np.array([n for _, n in top], dtype=float)
        total = float(own[TOTAL, b""])
        shares.append(np.append(counts, total - counts.sum()) / total)
    return References(languages, classes / np.maximum(1.0, classes.sum(axis=1, keepdims=True)), words, picks, shares)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row; rows of zeros are at distance 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=-1)
        right = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=-1)
    out = np.sqrt(np.clip((left + right) / 2, 0.0, 1.0))
    return np.where(p.sum(axis=-1) > 0, out, 1.0)


def repeated_words(hashes: np.ndarray, run: int = RUN) -> int:
    """Words inside runs of `run` words that occur twice or more."""
    found = run_hashes(hashes, run)
    if len(found) < 2:
        return 0
    _, back, n = np.unique(found, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(n[back] > 1)
    cover = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + run, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def repeated_lines(data: bytes) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


MEASURES = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
            "base_failed boolean, nearest string, word_distance double, char_distance double, kept boolean")


def judge(docs: DataFrame, refs: References, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, the base counts, base_failed, nearest language, both distances, kept) for every document."""
    rows = docs.select(F.col(key).cast("bigint").alias(key), text_of(text).cast("binary").alias("_text"))
    names = [key] + [m.split()[0] for m in MEASURES.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, at = Words(), {w: i for i, w in enumerate(refs.words)}
        for batch in batches:
            n = batch.num_rows
            base, common = np.zeros((n, 5), dtype=np.int64), np.zeros((n, len(at)), dtype=np.int32)
            classes = np.zeros((n, INNER), dtype=np.int64)
            for i, body in enumerate(batch.column(1)):
                data = body.as_py()
                octets = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
                words = data.split()
                base[i] = (len(words), octets.sum() - octets[0x80:0xC0].sum() - octets[SPACES].sum(),
                           octets[list(SYMBOLS)].sum(), repeated_lines(data), repeated_words(memo.of(words)))
                classes[i] = class_counts(octets)
                places = np.fromiter(map(at.get, data.lower().split(), repeat(len(at))), dtype=np.int64)
                common[i] = np.bincount(places, minlength=len(at) + 1)[:len(at)]
            yield _verdicts(batch.column(0), base, classes, common, refs, names)

    return rows.mapInArrow(each, f"{key} bigint, {MEASURES}")


def _verdicts(keys: pa.Array, base: np.ndarray, classes: np.ndarray, common: np.ndarray, refs: References,
              names: list[str]) -> pa.RecordBatch:
    n_words, chars = base[:, 0], classes.sum(axis=1)
    failed = (n_words < 20) | (100 * base[:, 4] > 30 * n_words)
    by_word, by_char = np.ones((len(base), max(1, len(refs.languages)))), np.ones((len(base), max(1, len(refs.languages))))
    spread = classes / np.maximum(1, chars)[:, None]
    for i in range(len(refs.languages)):
        own = common[:, refs.picks[i]].astype(float)
        own = np.column_stack([own, n_words - own.sum(axis=1)]) / np.maximum(1, n_words)[:, None]
        by_word[:, i] = js_distance(own, refs.shares[i][None, :])
        by_char[:, i] = js_distance(spread, refs.classes[i][None, :])
    best = np.argmin(by_word + by_char, axis=1)
    word, char = by_word[np.arange(len(base)), best], by_char[np.arange(len(base)), best]
    odd = ((n_words >= MIN_WORDS) & (word > WORD_LIMIT + WORD_SLACK / np.sqrt(np.maximum(1, n_words)))
           | (chars >= MIN_CHARS) & (char > CHAR_LIMIT + CHAR_SLACK / np.sqrt(np.maximum(1, chars))))
    kept = ~failed & ~(odd if refs.languages else np.zeros(len(base), dtype=bool))
    nearest = [refs.languages[b] if refs.languages else None for b in best]
    return pa.RecordBatch.from_arrays(
        [keys, *[pa.array(base[:, i]) for i in range(5)], pa.array(failed), pa.array(nearest, pa.string()), pa.array(word),
         pa.array(char), pa.array(kept)], names)


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    return judge(docs, references(docs, text, lang), key, text)
