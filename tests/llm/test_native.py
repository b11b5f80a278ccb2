"""Fingerprints, mixing and sharding: built-in functions only, held against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd_cases import odd_rows, prose, sorted_rows
from pyspark.sql import functions as F

from parcelsight.llm import fingerprints, mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def native(df) -> bool:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


# ---- sharding -----------------------------------------------------------------------------------

def test_shards_follow_the_scores(spark, odd):
    weights = [1.0, 2.0, 0.0, 1.0]
    found = sharding.shard_records(odd, weights, grown_weight=2.0)
    assert native(found)

    def best(key, ws):
        def score(i, w):
            u = (int(hashlib.md5(f"{i}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 16.0 ** 13
            return -math.log(u) / w
        return min((score(i, w), i) for i, w in enumerate(ws) if w > 0)[1]

    rows = found.collect()
    assert len(rows) == len(odd_rows())
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.shard == best(key, weights) and r.grown_shard == best(key, [*weights, 2.0])
        assert r.grown_shard in (r.shard, 4) and r.shard != 2
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_nothing_and_clashes(odd, empty, clashing):
    assert sharding.shard_records(empty, [1.0] * 4).count() == 0
    drop = lambda df: df.drop("slot")  # noqa: E731  identical rows get slots in any order
    assert sorted_rows(drop(sharding.shard_records(clashing, [1.0] * 4))) == sorted_rows(drop(sharding.shard_records(odd, [1.0] * 4)))
    with pytest.raises(ValueError):
        sharding.shard_records(odd, [0.0])


def test_weights_and_moves(spark):
    keys = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    n = Counter(r.shard for r in sharding.shard_records(keys, [1.0, 3.0]).collect())
    assert abs(n[1] / 20_000 - 0.75) < 0.02


def test_shard_files(spark, odd, tmp_path):
    sharding.write_shards(odd, [1.0] * 3, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == len(odd_rows())


# ---- mixing -------------------------------------------------------------------------------------

def brute_targets(sizes, weights, limit):
    """Step by step: share, cut what is above the limit, share the excess again."""
    goal, open_ = [0.0] * len(sizes), {i for i in range(len(sizes)) if sizes[i]}
    left = float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > limit * sizes[i]}
        if not over:
            for i in open_:
                goal[i] = left * weights[i] / total
            break
        for i in over:
            goal[i] = limit * sizes[i]
            left -= goal[i]
        open_ -= over
    return goal


def test_targets():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(0, 12)
        sizes = [rng.choice([0, 1, 5, rng.randint(1, 10_000)]) for _ in range(n)]
        weights = [i % 3 + 1 for i in range(n)]
        assert mixing.targets(sizes, weights) == pytest.approx(brute_targets(sizes, weights, 3))


def test_quotas_are_exact():
    rng = np.random.default_rng(1)
    for shards in (1, 2, 7, 64):
        quotas = rng.integers(0, 500, 9)
        dealt = mixing.split_quotas(quotas, shards, 3)
        assert (dealt.sum(axis=0) == quotas).all() and (dealt >= 0).all()
        assert dealt.sum(axis=1).max() - dealt.sum(axis=1).min() <= 1
        assert (dealt == mixing.split_quotas(quotas, shards, 3)).all()
    assert mixing._draw(rng, 3_000_000_000, 5_000_000_000, 1_000_000_000) == pytest.approx(3.75e8, rel=0.01)


def test_mix_takes_what_it_should(odd):
    found = mixing.mix_sources(odd, shards=4, blocks_per_shard=8)
    assert native(found)
    rows, docs = found.collect(), odd_rows()
    assert len(rows) == len(docs)
    sizes = defaultdict(int)
    for d in docs:
        sizes[d[3]] += len(WORD.findall(d[1] or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    goal = dict(zip(names, brute_targets([sizes[s] for s in names], [1, 2, 3, 1], 3)))
    taken, spans = defaultdict(int), defaultdict(set)
    for r in rows:
        s = r["row"]["source"]
        assert r["size"] == len(WORD.findall(r["row"]["text"] or "")) and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(goal[s]) and 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] == sum(d["words"] for d in r["draws"]) and all(0 <= d["shard"] < 4 for d in r["draws"])
        taken[s] += r["taken"]
        spans[s] |= {d["shard"] for d in r["draws"]}
    assert all(taken[s] == math.floor(goal[s] + 0.5) for s in names)
    assert sorted_rows(found) == sorted_rows(mixing.mix_sources(odd.repartition(5), shards=4, blocks_per_shard=8))


def test_mixed_documents_are_cut_at_words(odd):
    mixed = mixing.mix_sources(odd)
    out = mixing.mixed_documents(mixed, odd.columns).collect()
    assert sum(len(WORD.findall(r.text or "")) for r in out) == mixed.agg(F.sum("taken")).first()[0]
    whole = Counter(r[1] for r in odd_rows())
    cut = [r for r in out if r.text not in whole]
    assert all(any((t or "").startswith(r.text) for t in whole) and r.n_chars == len(r.text) for r in cut)


def test_mix_of_nothing_and_clashes(empty, clashing, odd, spark, tmp_path):
    assert mixing.mix_sources(empty).count() == 0
    picked = lambda df: df.select("row.doc_id", "size", "target", "taken", "draws")
    assert sorted_rows(picked(mixing.mix_sources(clashing))) == sorted_rows(picked(mixing.mix_sources(odd)))
    mixing.write_mix(mixing.mix_sources(clashing), f"{tmp_path}/mix")
    assert spark.read.parquet(f"{tmp_path}/mix").agg(F.sum("mix_words")).first()[0] == mixing.mix_sources(odd).agg(F.sum("taken")).first()[0]
    nothing = odd.where(F.col("text").isNull())
    assert [r.taken for r in mixing.mix_sources(nothing).collect()] == [0, 0]


# ---- fingerprints -------------------------------------------------------------------------------

def shingles(text):
    w = WORD.findall(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(text, following):
    n = len(text)
    return text[:n - n // 3] + following[:n // 3]


def test_fingerprints_of_odd_rows(odd):
    found = fingerprints.fingerprint_documents(odd)
    assert native(found)
    rows = found.collect()
    docs = sorted(((r[0], r[1] or "") for r in odd_rows()), key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert [r.n_chars for r in sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))] is not None
    order = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = Counter()
    for at, (key, text) in enumerate(order):
        new = edited(text, order[(at + 1) % len(order)][1])
        want[key, len(text), hashlib.sha256(new.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    by_text = defaultdict(set)
    texts = dict(order)
    for r in rows:
        by_text[texts[r.doc_id] if r.doc_id is not None else None].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == 256
    assert all(len(f) == 1 for t, f in by_text.items() if t is not None)


def test_buckets_do_not_matter(odd):
    assert sorted_rows(fingerprints.fingerprint_documents(odd)) == sorted_rows(fingerprints.fingerprint_documents(odd, bucket_rows=2))


def test_likeness_is_near_jaccard(small):
    texts = {r.doc_id: r.text for r in small.collect()}
    rows = fingerprints.fingerprint_documents(small, bucket_rows=30).collect()
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    apart = []
    for r in rows:
        new = edited(texts[r.doc_id], texts[after[r.doc_id]])
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        apart += [r.near_edited - jaccard(texts[r.doc_id], new), r.near_next - jaccard(texts[r.doc_id], texts[after[r.doc_id]])]
    assert np.abs(apart).mean() < 0.03 and abs(np.mean(apart)) < 0.01 and np.quantile(np.abs(apart), 0.99) < 0.15


def test_bias_correction(spark):
    words = [prose(i, 900) for i in range(40)]
    pairs = spark.createDataFrame([(a, b) for a, b in zip(words, words[1:])], "a string, b string")
    near = pairs.select(fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b")))).collect()
    assert np.mean([r[0] for r in near]) < 0.02


def test_no_rows_one_row_no_keys(spark, empty, odd, clashing):
    assert fingerprints.fingerprint_documents(empty).count() == 0
    one = fingerprints.fingerprint_documents(odd.where("doc_id = 8")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    keyless = fingerprints.fingerprint_documents(odd.where("doc_id is null")).collect()
    assert len(keyless) == 2 and {r.near_next for r in keyless} == {0.0}
    assert sorted_rows(fingerprints.fingerprint_documents(clashing)) == sorted_rows(fingerprints.fingerprint_documents(odd))
