"""Best-fit packing of tokenised documents with large-item matching.

The plan needs only how many pieces of each length there are: at most `capacity` numbers, whatever the corpus.
Lengths above a third of the capacity go at most twice into one sequence, so they are matched greedily: the
longest first, each with the longest partner that still fits. All shorter lengths then go, longest
first, into the tightest gap that holds them, and into new sequences when no gap does. Equal sequences are planned together as one
pattern and a count, so the plan is as small as the histogram.

A piece finds its place by its rank among the pieces of its length. Ranks are running counts over hash cells, so a
length that a third of all pieces share is many small sorts.

Defined results: a null or empty text is the end token alone; only documents longer than the capacity are
cut; repeated rows are packed as documents of their own; no rows give no rows. Added tokens inside a text count as the tokenizer
counts them, in their own letter case only.
"""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelsight.llm.common import running_start, stored, text_of

CAPACITY = 4096
END = 1
RANK_CELLS = 4096
CACHED_CHUNKS = 400_000
CACHED_CORES = 500_000
STOPS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
GROUP_BYTES = 1 << 21
GATHERED_WORDS = 1 << 20
MARKS = "\u2665\u2605\u2022\u20ac\u00a3\u2026"    # symbols of which the tokenizer has one as a single id
# holds what the chunk-wise way relies on: letter case, stops, white space and marks of several kinds
PROBE = "Plain WORDS, mixed!? \u00dcn\u00efcode\u00a0gap 12.5 (x) a\tb\nc It's e.g.: <|X|> \u6771\u4eac caf\u00e9,*** End."


# ---- tokens -------------------------------------------------------------------------------------

class Chunks(dict):
    """Chunk between ASCII white space -> its ids as little-endian bytes; forgets all when it is full.

    The tokenizer drops white space and never joins across it, so a text's ids are its chunks' ids in a row. Chunks
    that are not known yet are encoded together, hundreds to a text, with a mark between them whose one id
    shows where each ends. Chunks with an added token in any letter case are encoded as they are and alone, for the
    tokenizer looks for these before it lower-cases. A tokenizer that treats the probe text otherwise gets whole texts.
    """

    def __init__(self, path: str):
        super().__init__()
        self.cores: dict[bytes, bytes] = {}
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        single = [(m, self._alone(m)[0]) for m in MARKS if len(self._alone(m)) == 1]
        if not single:
            raise ValueError(f"the tokenizer has no single id for any of {MARKS}")
        self.mark, self.mark_id = single[0]
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = False
        self.whole = self.ids(pa.array([PROBE]))[0] != np.array(self._alone(PROBE), dtype="<u4").tobytes()

    def _alone(self, chunk: str) -> list[int]:
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def __missing__(self, chunk: bytes) -> bytes:
        found = self[chunk] = np.array(self._alone(chunk.decode("utf-8")), dtype="<u4").tobytes()
        return found

    def learn(self, chunks: list[bytes]) -> None:
        """Chunks are lower-cased, and ASCII stops after a letter are tokens of their own: so most chunks are a known
        core and stops."""
        low = b" ".join(chunks).lower()
        if any(t in low for t in self.added):
            chunks = [c for c in chunks if not any(t in c.lower() for t in self.added)]
            low = b" ".join(chunks).lower()
        parts, cores = [], self.cores
        for chunk in low.split(b" ") if chunks else ():
            core = chunk.rstrip(STOPS)
            if len(core) == len(chunk) or not _ends_in_letter(core):
                parts.append((chunk, b""))
            else:
                parts.append((core, chunk[len(core):]))
        self._encode(list({x for p in parts for x in p if x}.difference(cores)))
        for chunk, (core, stops) in zip(chunks, parts):
            if core in cores and (not stops or stops in cores):
                self[chunk] = cores[core] + cores[stops] if stops else cores[core]

    def _encode(self, cores: list[bytes]) -> None:
        mark = self.mark.encode()
        cores = [c for c in cores if mark not in c]         # the others are encoded alone, when they are met
        runs = [cores[i:i + 256] for i in range(0, len(cores), 256)]
        between = b" " + mark + b" "
        encoded = self.tokenizer.encode_batch_fast([between.join(r).decode("utf-8") for r in runs], add_special_tokens=False)
        for run, e in zip(runs, encoded):
            ids = np.array(e.ids, dtype="<u4")
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids)).tolist()
            if len(ends) != len(run):
                continue                                    # some core has the mark's id after all
            data, start = ids.tobytes(), 0
            for core, end in zip(run, ends):
                self.cores[core] = data[4 * start:4 * end]
                start = end + 1

    def ids(self, texts: pa.StringArray) -> list[bytes]:
        """Distinct chunks are found by Arrow, their ids put in place by numpy."""
        if self.whole:
            encoded = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            return [np.array(e.ids, dtype="<u4").tobytes() for e in encoded]
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        if len(self) >= CACHED_CHUNKS:
            self.clear()
        if len(self.cores) >= CACHED_CORES:
            self.cores.clear()
        distinct = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        self.learn([w for w in distinct if w and w not in self])
        found = [self[w] for w in distinct]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        firsts, known = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(found), dtype="<u4")
        places, parts, ends = words.indices.to_numpy(), [], [np.zeros(1, np.int64)]
        for at in range(0, len(places), GATHERED_WORDS):
            place = places[at:at + GATHERED_WORDS]
            n = sizes[place]
            end = np.cumsum(n)
            parts.append(known[np.repeat(firsts[place] - (end - n), n) + np.arange(end[-1])])
            ends.append(end + ends[-1][-1])
        ids = np.concatenate(parts) if parts else known[:0]
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        cuts = np.concatenate(ends)[np.concatenate(([0], np.cumsum(counts)))]
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def _ends_in_letter(core: bytes) -> bool:
    return bool(core) and (97 <= core[-1] <= 122 or core[-1] >= 128 and core.decode("utf-8")[-1].isalpha())


@cache
def chunks_of(path: str) -> Chunks:
    """One cache per worker process: what one task has learned serves the next."""
    return Chunks(path)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[list, pa.StringArray]]:
    """Keys and texts, some megabytes at a time."""
    group = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)) // GROUP_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a)


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END,
                    key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids): every document's ids and the end id, cut at `capacity`.

    `ids` holds little-endian unsigned 32-bit numbers. `tokenizer` is a file that every node has.
    """
    rows = docs.select(F.col(key).cast("bigint").alias(key), text_of(text).alias("_text"))
    last, step = np.array([end], dtype="<u4").tobytes(), 4 * capacity

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunks_of(tokenizer)
        for batch in batches:
            for ids_of, texts in _groups(batch):
                keys, pieces, starts, lengths, blobs = [], [], [], [], []
                for k, ids in zip(ids_of, chunks.ids(texts)):
                    ids += last
                    for piece, at in enumerate(range(0, len(ids), step)):
                        blob = ids[at:at + step]
                        keys.append(k), pieces.append(piece), starts.append(at // 4)
                        lengths.append(len(blob) // 4), blobs.append(blob)
                yield _piece_batch(key, keys, pieces, starts, lengths, blobs)

    return rows.mapInArrow(each, f"{key} bigint, piece int, start bigint, length bigint, ids binary")


def _piece_batch(key, keys, pieces, starts, lengths, blobs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()),
         pa.array(lengths, pa.int64()), pa.array(blobs, pa.binary())], [key, "piece", "start", "length", "ids"])


# ---- the plan -----------------------------------------------------------------------------------

@dataclass
class Pattern:
    """`count` equal sequences: the lengths in them, in order, and the room left."""
    count: int
    lengths: list[int]
    gap: int


@dataclass
class Plan:
    """By length: the ranks at which a new slot begins, and that slot's first sequence and offset."""
    sequences: int = 0
    slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)


def match_large(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Greedy matching of the lengths above a third of the capacity; takes them out of `counts`."""
    large = sorted(x for x in counts if 3 * x > capacity)
    left = {x: counts.pop(x) for x in large}
    out = []
    while large:
        longest = large[-1]
        at = bisect_left(large, capacity - longest + 1) - 1
        if at < 0:
            lengths, n = [longest], left[longest]
        elif large[at] == longest:
            lengths, n = ([longest, longest], left[longest] // 2) if left[longest] > 1 else (None, 0)
            if lengths is None:     # one is left: its partner is the next shorter, if there is one
                lengths, n = ([longest, large[at - 1]] if at > 0 else [longest]), 1
        else:
            lengths, n = [longest, large[at]], min(left[longest], left[large[at]])
        out.append(Pattern(n, lengths, capacity - sum(lengths)))
        for x in lengths:
            left[x] -= n
        large = [x for x in large if left[x] > 0] if any(left[x] == 0 for x in lengths) else large
    return out


def fill_gaps(patterns: list[Pattern], counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit, longest first, over all patterns of one gap at a time."""
    by_gap: dict[int, list[Pattern]] = defaultdict(list)
    for p in patterns:
        by_gap[p.gap].append(p)
    gaps = sorted(by_gap)
    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                full, rest = divmod(todo, each)
                fresh = [Pattern(n, [length] * k, capacity - k * length) for n, k in ((full, each), (1, rest)) if n and k]
                todo = 0
            else:
                old = by_gap[gaps[at]].pop()
                if not by_gap[old.gap]:
                    del by_gap[old.gap], gaps[at]
                n = min(todo, old.count)
                fresh = [Pattern(n, [*old.lengths, length], old.gap - length)]
                if n < old.count:
                    fresh.append(Pattern(old.count - n, old.lengths, old.gap))
                todo -= n
            for p in fresh:
                if p.gap not in by_gap:
                    insort(gaps, p.gap)
                by_gap[p.gap].append(p)
    return [p for same in by_gap.values() for p in same]


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    counts = dict(counts)
    patterns = fill_gaps(match_large(counts, capacity), counts, capacity)
    plan, slots = Plan(), defaultdict(list)
    for p in patterns:
        offset = 0
        for length in p.lengths:
            slots[length].append((p.count, plan.sequences, offset))
            offset += length
        plan.sequences += p.count
    for length, rows in slots.items():
        n, first, offset = (np.array(x, dtype=np.int64) for x in zip(*rows))
        plan.slots[length] = np.concatenate(([0], np.cumsum(n)[:-1])), first, offset
    return plan


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Adds (sequence_id, offset) to rows with a `length` from 1 to `capacity`.

    The rows are read twice, so they should be stored. `order` names the columns that tell rows apart; rows equal in
    all of them take each other's places at will.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 1 <= x <= capacity for x in counts):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    plan = plan_packing(counts, capacity)
    celled = pieces.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(RANK_CELLS)).cast("int"))
    ranked = running_start(celled, "length", "_cell", order, F.lit(1).cast("bigint"), "_rank").drop("_cell")
    schema = pieces.withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")}).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            length, rank = table.column("length").to_numpy(), table.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            by_length = np.argsort(length, kind="stable")
            for at in np.split(by_length, np.flatnonzero(np.diff(length[by_length])) + 1) if len(rank) else []:
                starts, first, where = plan.slots[int(length[at[0]])]
                slot = np.searchsorted(starts, rank[at], side="right") - 1
                sequence[at], offset[at] = first[slot] + rank[at] - starts[slot], where[slot]
            table = table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
            yield from table.select(schema.names).to_batches()

    return ranked.mapInArrow(each, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, key: str = "doc_id",
                   text: str = "text", digest: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(key, piece, start, length, ids, sequence_id, offset) for every piece of every document.

    `digest` may replace the ids by something shorter before the pieces are stored and shuffled.
    """
    pieces = tokenize_pieces(docs, tokenizer, capacity, end, key, text)
    pieces = stored(digest(pieces) if digest else pieces, "pieces")
    return pack(pieces, [key, "piece", "start"], capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences; a sequence has at most `capacity` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
