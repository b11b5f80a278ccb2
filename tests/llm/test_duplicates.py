"""SimHash near-duplicates and substring dedup against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from odd_cases import odd_rows, prose, sorted_rows

from parcelsight.llm import simhash, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Sets(dict):
    def __missing__(self, x):
        self[x] = x
        return x

    def find(self, x):
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def brute_fingerprint(text, k=4):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(rows, radius=4):
    """Per row the fingerprint and the least id of its component."""
    marks = [brute_fingerprint(r[1]) for r in rows]
    sets, distinct = Sets(), sorted(set(marks))
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= radius:
                sets.join(a, b)
    least = {}
    for r, m in zip(rows, marks):
        if r[0] is not None:
            least[sets.find(m)] = min(r[0], least.get(sets.find(m), r[0]))
    return [(m, least.get(sets.find(m))) for m in marks]


def test_near_duplicates_of_odd_rows(odd, clashing):
    found = simhash.near_duplicates(odd)
    want = Counter((r[0], m, c) for r, (m, c) in zip(odd_rows(), brute_components(odd_rows())))
    assert Counter((r.doc_id, r.fp % 2 ** 64, r.component) for r in found.collect()) == want
    assert sorted_rows(simhash.near_duplicates(clashing)) == sorted_rows(found)


def test_near_duplicates_of_a_table(small):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    want = {(r[0], m, c) for r, (m, c) in zip(rows, brute_components(rows))}
    assert {(r.doc_id, r.fp % 2 ** 64, r.component) for r in simhash.near_duplicates(small).collect()} == want
    assert len({c for _, _, c in want}) < len(rows)


def test_first_of_each_group_stays(odd, clashing, empty):
    kept = simhash.keep_first(odd)
    comps = brute_components(odd_rows())
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in comps})
    assert kept.columns == odd.columns
    assert sorted_rows(simhash.keep_first(clashing).select(*odd.columns)) == sorted_rows(kept)
    assert simhash.keep_first(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def test_groups_without_ids_of_their_own_stay(spark):
    """Different texts stay, whether they have no id or share one; copies go."""
    texts = [prose(100 + i, 80) for i in range(7)]
    rows = [(None, t) for t in texts[:4]] + [(5, t) for t in texts[4:6]] + [(6, texts[6])]
    rows += [(None, texts[0]), (9, texts[1]), (5, texts[4]), (5, texts[4]), (7, texts[6])]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    want = [(None, texts[0]), (9, texts[1]), (None, texts[2]), (None, texts[3]), (5, texts[4]), (5, texts[5]), (6, texts[6])]
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, want))


@pytest.mark.parametrize("radius", [2, 3, 4])
@pytest.mark.parametrize("bits,limit", [(0, 1 << 30), (0, 20_000), (5, 1 << 30), (9, 1 << 30)])
def test_every_close_pair_meets(radius, bits, limit):
    rng = random.Random(radius)
    values = [rng.getrandbits(64) for _ in range(30)]
    for v in values[:12]:
        for _ in range(4):
            values.append(v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius + 1))))
    values = np.unique(np.array(values, dtype=np.uint64))
    masks, near = simhash.flips(radius)
    table = simhash.syndrome_table(bits)
    steps = np.unique(simhash.syndromes(masks, table))
    buckets: dict = {}
    for bucket, blob in simhash.to_buckets(values, table, steps):
        buckets.setdefault(bucket, []).append(np.frombuffer(blob, dtype=np.uint64))
    found, true = Sets(), Sets()
    for bucket, held in buckets.items():
        for a, b in simhash.meet(np.concatenate(held), bucket, bits, masks, near, limit).tolist():
            assert (a ^ b).bit_count() <= radius
            found.join(a, b)
    plain = values.tolist()
    for i, a in enumerate(plain):
        for b in plain[:i]:
            if (a ^ b).bit_count() <= radius:
                true.join(a, b)
    assert [found.find(v) for v in plain] == [true.find(v) for v in plain]


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)]
    edges += [(5000 + rng.randrange(200), 5000 + rng.randrange(200)) for _ in range(150)]
    rng.shuffle(edges)
    sets = Sets()
    for a, b in edges:
        sets.join(a, b)
    found = simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    want = {(v, sets.find(v)) for v in list(sets) if sets.find(v) != v}
    assert {(r.node, r.root) for r in found} == want and len(found) == len(want)
    assert simhash.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---- substrings ---------------------------------------------------------------------------------

def brute_kept(rows, window):
    texts = [(r[1] or "").encode().split() for r in rows]
    seen = Counter(tuple(t[i:i + window]) for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        keep = [True] * len(t)
        for i in range(len(t) - window + 1):
            if seen[tuple(t[i:i + window])] > 1:
                keep[i:i + window] = [False] * window
        out.append((len(t), keep.count(False), b" ".join(w for w, k in zip(t, keep) if k).decode()))
    return out


def test_repeats_of_odd_rows(odd, clashing, empty):
    found = substrings.remove_repeats(odd)
    want = Counter((r[0], *k) for r, k in zip(odd_rows(), brute_kept(odd_rows(), 35)))
    assert Counter(map(tuple, found.collect())) == want
    assert sorted_rows(substrings.remove_repeats(clashing)) == sorted_rows(found)
    assert substrings.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("window", [1, 2, 5, 8])
def test_repeats_for_any_window(spark, window):
    rng = random.Random(window)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(40))) + f" t{i} " + (prose(3, 12) if i % 3 else "")) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = Counter((r[0], *k) for r, k in zip(rows, brute_kept(rows, window)))
    assert Counter(map(tuple, substrings.remove_repeats(df, window).collect())) == want


def test_repeats_across_batches(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BATCH_WORDS", 100)
    passage = prose(9, 50)
    rows = [(i, prose(100 + i, 30) + " " + passage + " " + prose(200 + i, i)) for i in range(40)]
    probes = list(substrings._probe(35, 4)(iter([pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].encode() for r in rows], pa.binary())], ["key", "text"])])))
    assert len(probes) > 10
    parts = pa.Table.from_batches(probes)
    found: dict = {}
    for p in set(parts.column("part").to_pylist()):
        for r in substrings.repeated(parts.filter(pa.compute.equal(parts.column("part"), p)), False).to_pylist():
            found.setdefault(r["key"], set()).update(np.frombuffer(r["places"], np.uint32).tolist())
    # the passage covers words 30 to 79: its whole blocks are 2 and 3
    assert all({2, 3} <= found[i] <= {2, 3} for i in range(40))


def test_one_text_shuffle_serves_both_reads(odd):
    df = substrings.remove_repeats(odd)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_documents_without_repeats(odd, clashing):
    rows = {r.doc_id: r for r in substrings.without_repeats(odd).where("doc_id is not null").collect()}
    want = dict(zip([r[0] for r in odd_rows()], brute_kept(odd_rows(), 35)))
    before = {r[0]: r for r in odd_rows()}
    for key, row in rows.items():
        n, removed, left = want[key]
        assert row.text == (left if removed else before[key][1])
        assert row.n_chars == (len(left) if removed else before[key][4])
    again = substrings.without_repeats(clashing)
    assert again.columns == clashing.columns
    assert sorted_rows(again.select(*odd.columns)) == sorted_rows(substrings.without_repeats(odd))


def test_hashes_of_runs():
    words = np.array([hash(w) & (2 ** 64 - 1) for w in prose(1, 200).split()], dtype=np.uint64)
    words[150:190] = words[20:60]
    h = substrings.run_hashes(words, 7)
    same = {(i, j) for i in range(len(h)) for j in range(i) if h[i] == h[j]}
    assert {(i + 150, i + 20) for i in range(34)} <= same
    for i, j in same:
        assert (words[i:i + 7] == words[j:j + 7]).all()
