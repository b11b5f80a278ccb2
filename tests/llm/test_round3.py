"""The filter audit, the resampling and the MinHash groups: oracles over a whole small table, brute force on odd rows."""

from __future__ import annotations

import random
import re

import pytest
from compare import compare, oracle_connection
from odd_cases import odd_rows, sorted_rows

from parcelsight.llm import filter_audit, minhash, queries, resampling

SMALL_DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_filter_interaction_audit", "op12_target_resampling", "op13_minhash_near_dedup"])
def test_queries_equal_their_oracles(spark, name):
    problem = compare(oracle_connection(SMALL_DIR), queries.QUERIES[name](spark, SMALL_DIR), queries.ORACLES[name])
    assert problem is None, problem


def brute_groups(rows):
    """(id, set size, least id reachable) by comparing every pair of shingle sets."""
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(LOWER))
        sets.append({tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for i, r in enumerate(rows):
        ids = [q[0] for q, g in zip(rows, group) if g == group[i] and q[0] is not None]
        out.append((r[0], len(sets[i]), min(ids, default=None)))
    return sorted(map(repr, out))


def test_minhash_groups_of_odd_rows(odd, clashing, empty):
    found = minhash.near_duplicates(clashing).select("doc_id", "n_shingles", "component")
    assert sorted_rows(found) == sorted_rows(minhash.near_duplicates(odd).select("doc_id", "n_shingles", "component"))
    with_id = lambda rows: [r for r in rows if not r.startswith("(None")]
    assert with_id(sorted_rows(found)) == with_id(brute_groups(odd_rows()))
    assert minhash.near_duplicates(empty).count() == 0


def alike_rows():
    """Copies of three texts with words replaced, dropped and appended, so that most pairs are just below the similarity."""
    rng, rows = random.Random(3), []
    for g, size in enumerate((40, 90, 150)):
        base = [f"g{g}w{i}" for i in range(size)]
        for c in range(60):
            words = list(base)
            for e in range(rng.randint(0, size // 15)):
                at = rng.randrange(len(words))
                words[at:at + 1] = [[f"x{rng.randrange(12)}"], [f"u{g}.{c}.{e}"], []][rng.randrange(3)]
            words += [f"t{i}" for i in range(rng.choice((0, 0, 0, size // 12)))]
            rows.append((len(rows) + 1, " ".join(words), None, "a"))
    return rows


def test_minhash_does_not_pair_whole_groups_of_unlinked_texts(spark, monkeypatch):
    pairs, candidates = [], minhash.candidates

    def counted(*given):
        found = candidates(*given)
        pairs.append(found.count())
        return found

    monkeypatch.setattr(minhash, "candidates", counted)
    schema = "doc_id bigint, text string, lang string, source string"
    rows = alike_rows()
    found = minhash.near_duplicates(spark.createDataFrame(rows, schema)).select("doc_id", "n_shingles", "component")
    assert sorted_rows(found) == brute_groups(rows)
    pairs.clear()
    apart = [(n, " ".join(f"u{n}.{i}" if i % 13 == n % 13 else f"w{i}" for i in range(100)), None, "a") for n in range(1, 101)]
    found = minhash.near_duplicates(spark.createDataFrame(apart, schema)).select("doc_id", "n_shingles", "component")
    assert sorted_rows(found) == brute_groups(apart)
    assert sum(pairs) < 1000


def test_resampling_of_odd_rows(spark, odd, clashing, empty):
    target = spark.createDataFrame([(1, "one two three"), (2, None), (3, "")], "item_id bigint, text string")
    cols = ["doc_id", "n_features", "weight", "score", "rank"]
    found = resampling.resample(odd, target).select(*cols)
    assert sorted_rows(resampling.resample(clashing, target).select(*cols)) == sorted_rows(found)
    rows = found.collect()
    fit = sum(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r[1] or "").translate(LOWER))) >= 20 for r in odd_rows())
    ranks = sorted(r["rank"] for r in rows if r["rank"] is not None)
    assert len(rows) == len(odd_rows()) and ranks == list(range(1, 25 * fit // 100 + 1))
    assert all(r["weight"] == 0 for r in rows if r["n_features"] == 0)
    assert resampling.resample(empty, target).count() == 0


def test_audit_of_odd_rows(spark, odd, clashing, labels, tmp_path):
    """Every part counts all its rows at every step, and orders agree on what is left at the end."""
    results = []
    for name, docs in (("odd", odd), ("clashing", clashing)):
        path = f"{tmp_path}/{name}.parquet"
        docs.write.parquet(path)
        results.append(sorted_rows(filter_audit.audit(filter_audit.stream_files(spark, path), labels)))
    assert results[0] == results[1]
    rows = filter_audit.audit(filter_audit.stream_files(spark, f"{tmp_path}/odd.parquet"), labels).collect()
    parts = {}
    for r in odd_rows():
        parts[r[3] or ""] = parts.get(r[3] or "", 0) + 1
    assert len(rows) == 600 * len(parts)
    left = {}
    for r in rows:
        if r["step"] == 1:
            assert r["kept"] + r["removed"] == parts[r["part"]] and r["redundant"] == 0
        if r["step"] == 5:
            left.setdefault(r["part"], set()).add(r["kept"])
    assert all(len(v) == 1 for v in left.values())


def test_audit_retracts_when_smaller_ids_arrive(spark, labels, tmp_path):
    """Ids fall from file to file and texts share state rows, so earlier holders are retracted again and again."""
    rows = [(100 - i, f"text {i % 7} " * 60, f"part {i % 3}") for i in range(60)] + [(50, "text 0 " * 60, "part 0")]
    path = f"{tmp_path}/falling.parquet"
    for i in range(0, len(rows), 16):
        spark.createDataFrame(rows[i:i + 16], "doc_id bigint, text string, source string").coalesce(1).write.mode("append").parquet(path)
    least = {}
    for doc_id, text, _ in rows:
        least[text] = min(doc_id, least.get(text, doc_id))
    wanted = {}
    for doc_id, text, part in rows:
        wanted[part] = wanted.get(part, 0) + (doc_id > least[text])
    for buckets in (1, 3, 4096):
        found = filter_audit.audit(filter_audit.stream_files(spark, path), labels, buckets=buckets).where(
            "step = 1 and filter_order = 'EABCD'").collect()
        assert {r["part"]: r["removed"] for r in found} == wanted
