"""Exact substring dedup by fixed-block anchors.

A window of w words holds, wherever it starts, a whole block of a = (w + 1) // 2 words that starts at a
multiple of a in its document. So documents are cut into blocks of a words, which are the index, and every
rolling run of a words probes it. A block that some other run equals is an anchor; a window can only be
repeated if it holds one. Windows around anchors are then compared whole, by a longer hash of all of their
words, and the repeated ones, laid over each other, are the maximal repeats.

A run goes into the shuffle as a few bytes inside a packed array, one array per task batch and
hash range; only blocks carry their place. What a batch repeats within itself is settled there, and one
representative goes on, so a passage that a third of all documents share sends one entry per
batch and never makes pairs.

Defined results: words are compared as they are; a null text has no words; a document shorter than a
window keeps everything; repeated rows repeat each other and lose every word that a window covers; a null id is a document like
others; no rows give no rows. Other columns are ignored.
"""

from __future__ import annotations


from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelsight.llm.common import text_of

WINDOW = 35
BATCH_WORDS = 1 << 20           # words whose hashes are held at once
PART_ENTRIES = 1 << 22          # entries of one hash range, about 100 MB in a task
CHARS_PER_WORD = 5              # a low guess, for the number of hash ranges only
CACHED_WORDS = 200_000
ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class Words(dict):
    """word -> 64-bit hash; forgets all when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def run_hashes(words: np.ndarray, length: int, base: int = ODD[0]) -> np.ndarray:
    """Hash of every run of `length` words. Differences of weighted prefix sums give all runs at once; an odd
    base has an inverse modulo 2^64, which takes the place in the text out again."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * _powers(base, len(words)), dtype=np.uint64)))
    return mixed((sums[length:] - sums[:-length]) * _powers(pow(base, -1, 1 << 64), n))


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """(n, 2): 128 bits per window, from two bases over words that are hashed twice."""
    return np.stack([run_hashes(words, length), run_hashes(mixed(words ^ np.uint64(ODD[1])), length, ODD[1])], axis=1)


def anchor_length(window: int) -> int:
    return (window + 1) // 2


PROBES = "part bigint, hashes binary, more binary, twice binary, keys binary, counts binary, places binary, done boolean"
FOUND = "key bigint, places binary"


def _row(part=0, hashes=b"", more=b"", twice=b"", keys=b"", counts=b"", places=b"", done=False) -> tuple:
    return part, hashes, more, twice, keys, counts, places, done


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.binary()] * 6, pa.bool_()]
    names = [f.split()[0] for f in PROBES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _by_key(docs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, how many places each has, and the places key by key."""
    order = np.argsort(docs, kind="stable")
    keys, counts = np.unique(docs, return_counts=True)
    return keys, counts, places[order]


def _parts_of(keys: np.ndarray, hashes: list[np.ndarray], docs: np.ndarray, places: np.ndarray, parts: int,
              placed: np.ndarray) -> Iterator[tuple]:
    """Rows for the shuffle from one batch's hashes (one array of 64 bits, or two for windows).

    `placed` marks the entries that carry a place. Per distinct hash one entry goes on: whether it was
    seen twice or more here, and the place if there is just one. Places of hashes that were seen
    more often here are known to be repeated and go on as done.
    """
    wide = len(hashes) > 1
    order = np.lexsort(hashes[::-1]) if wide else np.argsort(hashes[0], kind="stable")
    hashes = [h[order] for h in hashes]
    docs, places, placed = docs[order], places[order], placed[order]
    if not len(docs):
        return
    new = np.zeros(len(docs), dtype=bool)
    for h in hashes:
        new[1:] |= h[1:] != h[:-1]
    new[0] = True
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(docs)))
    known = np.repeat(lengths > 1, lengths) & placed
    if known.any():
        found, counts, at = _by_key(docs[known], places[known])
        yield _row(part=int(hashes[0][0] % np.uint64(parts)), keys=keys[found].tobytes(),
                   counts=counts.astype(np.uint32).tobytes(), places=at.astype(np.uint32).tobytes(), done=True)
    first = [h[starts] for h in hashes]
    twice, docs, places = lengths > 1, docs[starts], places[starts]
    block = placed[starts] & ~twice
    part = (first[0] % np.uint64(parts)).astype(np.int64)
    # in a range the entries with a place come first, document by document, so that a key is sent once
    order = np.lexsort((docs, ~block, part))
    for a, b in _runs(part[order]):
        at = order[a:b]
        own = at[:np.count_nonzero(block[at])]
        found, counts = np.unique(docs[own], return_counts=True)
        yield _row(part=int(part[at[0]]), hashes=(first[0][at] if wide else _short(first[0][at])).tobytes(),
                   more=_short(first[1][at]).tobytes() if wide else b"", twice=np.packbits(twice[at]).tobytes(),
                   keys=keys[found].tobytes(), counts=counts.astype(np.uint32).tobytes(),
                   places=places[own].astype(np.uint32).tobytes())


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(values)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)])


def _short(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32)


def repeated(group: pa.Table, wide: bool) -> pa.Table:
    """(key, places) of the placed entries of a hash range whose hash was seen more than once.

    Anchors only choose candidates: 32 bits beside the range tell them apart. Windows, which decide, have 96.
    """
    keys, at, hashes, more, twice, placed, own_keys, own_places = [], [], [], [], [], [], [], []
    for row in group.to_pylist():
        owners = np.repeat(np.frombuffer(row["keys"], dtype=np.int64), np.frombuffer(row["counts"], dtype=np.uint32))
        places = np.frombuffer(row["places"], dtype=np.uint32)
        if row["done"]:
            keys.append(owners)
            at.append(places)
            continue
        h = np.frombuffer(row["hashes"], dtype=np.uint64 if wide else np.uint32)
        hashes.append(h)
        more.append(np.frombuffer(row["more"], dtype=np.uint32))
        twice.append(np.unpackbits(np.frombuffer(row["twice"], dtype=np.uint8), count=len(h)))
        placed.append(np.arange(len(h)) < len(places))
        own_keys.append(owners)
        own_places.append(places)
    if hashes:
        h, twice, placed = np.concatenate(hashes), np.concatenate(twice), np.concatenate(placed)
        more = np.concatenate(more)
        order = np.lexsort((more, h)) if wide else np.argsort(h, kind="stable")
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[order][1:] != h[order][:-1]
        if wide:
            new[1:] |= more[order][1:] != more[order][:-1]
        number = np.cumsum(new) - 1
        seen = np.bincount(number) + np.bincount(number, weights=twice[order])
        again = np.zeros(len(h), dtype=bool)
        again[order] = seen[number] > 1
        hit = again[placed]
        keys.append(np.concatenate(own_keys)[hit])
        at.append(np.concatenate(own_places)[hit])
    keys = np.concatenate(keys) if keys else np.empty(0, np.int64)
    at = np.concatenate(at) if at else np.empty(0, np.uint32)
    found, counts, at = _by_key(keys, at)
    ends = np.cumsum(counts)
    return pa.table({"key": pa.array(found, pa.int64()),
                     "places": pa.array([at[e - c:e].astype(np.uint32).tobytes() for c, e in zip(counts, ends)], pa.binary())})


def _places(blobs: list[bytes] | None) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(blobs or []), dtype=np.uint32)).astype(np.int64)


def _probe(window: int, parts: int):
    """Every run of a block's length, and the blocks among them with their number."""
    length = anchor_length(window)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held, size = Words(), [], 0

        def flush() -> pa.RecordBatch | None:
            keys = np.array([k for k, _ in held], dtype=np.int64)
            docs = np.repeat(np.arange(len(held)), [len(h) for _, h in held])
            starts = np.concatenate([np.arange(len(h)) for _, h in held])
            return _rows(list(_parts_of(keys, [np.concatenate([h for _, h in held])], docs, starts // length, parts,
                                        starts % length == 0)))

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                found = run_hashes(memo.of(text.as_py().split()), length)
                if len(found):
                    held.append((key.as_py(), found))
                    size += len(found)
                if size >= BATCH_WORDS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return each


def _candidates(window: int, parts: int):
    """Whole windows around anchors; the column `blobs` lists the anchors' block numbers. (The id is not used: with
    the same columns as the later read of the dealt rows, both use one shuffle.)"""
    length = anchor_length(window)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held, size = Words(), [], 0

        def flush() -> pa.RecordBatch:
            keys = np.array([k for k, _, _ in held], dtype=np.int64)
            docs = np.repeat(np.arange(len(held)), [len(s) for _, s, _ in held])
            hashes, starts = np.concatenate([h for _, _, h in held]), np.concatenate([s for _, s, _ in held])
            return _rows(list(_parts_of(keys, [hashes[:, 0], hashes[:, 1]], docs, starts, parts, np.ones(len(docs), dtype=bool))))

        for batch in batches:
            for key, text, blobs in zip(batch.column(0), batch.column(1), batch.column(2)):
                words = memo.of(text.as_py().split())
                n = len(words) - window + 1
                if n <= 0:
                    continue
                near = np.zeros(n + 1, dtype=np.int64)
                blocks = _places(blobs.as_py()) * length
                np.add.at(near, np.clip(blocks + length - window, 0, n), 1)
                np.add.at(near, np.clip(blocks + 1, 0, n), -1)
                starts = np.flatnonzero(np.cumsum(near)[:n] > 0)
                if len(starts):
                    held.append((key.as_py(), starts, window_hashes(words, window)[starts]))
                    size += len(starts)
                if size >= BATCH_WORDS // 2:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return each


def repeated_windows(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text",
                     carried: Sequence[str] = ()) -> DataFrame:
    """(id, key, text, starts) and the carried columns: every row with the starts of its windows that also start
    elsewhere, as binary arrays of 32-bit numbers, or null.

    `key` tells rows apart within the operator; rows of one id and one text share it, and so their windows.
    """
    body = text_of(text)
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.xxhash64(F.col(key), body).alias("key"),
                       body.cast("binary").alias("text"), *carried)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(16, int(total / CHARS_PER_WORD / PART_ENTRIES) + 1)
    probes = rows.select("key", "text").mapInArrow(_probe(window, parts), PROBES)
    anchors = probes.groupBy("part").applyInArrow(lambda t: repeated(t, False), FOUND)
    anchors = anchors.groupBy("key").agg(F.collect_list("places").alias("blobs"))
    # the text is dealt by key once; the second join below reads the same shuffle again
    dealt = rows.repartition("key")
    candidates = dealt.join(anchors, "key").select("key", "text", "blobs", "id", *carried).mapInArrow(_candidates(window, parts), PROBES)
    spans = candidates.groupBy("part").applyInArrow(lambda t: repeated(t, True), FOUND)
    spans = spans.groupBy("key").agg(F.collect_list("places").alias("starts"))
    return dealt.join(spans, "key", "left").select("id", "key", "text", "starts", *carried)


def kept(words: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which words no repeated window covers."""
    cover = np.zeros(words + 1, dtype=np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return np.cumsum(cover)[:words] == 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept): every document with the words that no repeated window covers, joined by
    one space, as text."""
    found = repeated_windows(docs, window, key, text).select("id", "text", "starts")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, texts = [], [], []
            for body, starts in zip(batch.column(1), batch.column(2)):
                words = body.as_py().split()
                keep = kept(len(words), _places(starts.as_py()), window)
                counts.append(len(words))
                removed.append(int(len(words) - keep.sum()))
                texts.append(b" ".join([w for w, k in zip(words, keep.tolist()) if k] if removed[-1] else words).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(texts, pa.string())], [key, "n_words", "n_removed", "kept"])

    return found.mapInArrow(each, f"{key} bigint, n_words bigint, n_removed bigint, kept string")




def without_repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text",
                    chars: str = "n_chars") -> DataFrame:
    """The documents with all of their columns; where words went, the text is what is left, joined by one space,
    and the column `chars`, if there is one, is its length. A text that loses nothing stays as it is."""
    others = F.struct(F.col(text).isNull().alias("no_text"), F.struct(*[c for c in docs.columns if c != text]).alias("columns"))
    rows = docs.select(others.alias("others"), F.col(key).alias("_id"), F.col(text).alias("_text"))
    found = repeated_windows(rows, window, "_id", "_text", ["others"]).select("others", "text", "starts")
    schema = found.select("others", F.lit(None).cast("string").alias("left"), F.lit(None).cast("boolean").alias("cut")).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, cut = [], []
            for body, starts in zip(batch.column(1), batch.column(2)):
                data, at = body.as_py(), _places(starts.as_py())
                if len(at):
                    words = data.split()
                    keep = kept(len(words), at, window)
                    data = b" ".join([w for w, k in zip(words, keep.tolist()) if k])
                left.append(data.decode("utf-8"))
                cut.append(len(at) > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.string()), pa.array(cut)], ["others", "left", "cut"])

    out = found.mapInArrow(each, schema)
    body = F.when(~F.col("others.no_text"), F.col("left"))
    length = F.when(F.col("cut"), F.length("left").cast("bigint"))
    return out.select(*[body.alias(c) if c == text else F.coalesce(length, F.col("others.columns")[c]).alias(c) if c == chars
                        else F.col("others.columns")[c].alias(c) for c in docs.columns])
