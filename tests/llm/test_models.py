"""Classifiers, rules, packing and the pipeline: odd rows, brute force, held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from odd_cases import odd_rows, sorted_rows
from test_duplicates import brute_components, brute_kept

import corpus_pipeline
from parcelsight.llm import language, packing, quality_classifier, quality_rules, toxicity

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def thousand(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def no_labels(labels):
    return labels.limit(0)


def is_held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


# ---- language -----------------------------------------------------------------------------------

def test_languages_of_odd_rows(odd, clashing, empty):
    found = language.identify_languages(odd).collect()
    assert len(found) == len(odd_rows())
    assert {r["lang_pred"] for r in found} == {"en", "und"}
    texts = {r[0]: r[1] for r in odd_rows()}
    for r in found:
        assert r["held_out"] == is_held_out(r["doc_id"]) and 0 <= r["score"] <= 1
        if r["doc_id"] is not None:
            letters = any(c.isalpha() for c in texts[r["doc_id"]] or "")
            assert (r["lang_pred"] != "und") == letters and (letters or r["score"] == 0)
    assert sorted_rows(language.identify_languages(clashing)) == sorted_rows(language.identify_languages(odd))
    assert language.identify_languages(empty).count() == 0


def test_languages_without_labels(odd):
    found = language.identify_languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in found} == {("und", 0.0, True)}


def test_languages_held_out(thousand):
    found = language.identify_languages(thousand).where("held_out").join(thousand.select("doc_id", "lang"), "doc_id").collect()
    known = [r for r in found if r["lang"] is not None and r["lang_pred"] != "und"]
    assert len(known) > 100 and sum(r["lang"] == r["lang_pred"] for r in known) >= 0.97 * len(known)


def test_subwords_do_not_depend_on_chunks(monkeypatch):
    points = language.characters("Über die Straße, 東京 und zurück " * 20)
    whole = language.counts(points)
    monkeypatch.setattr(language, "CHUNK", 7)
    assert (language.counts(points) == whole).all()


# ---- toxicity -----------------------------------------------------------------------------------

def test_toxicity_of_odd_rows(odd, clashing, empty, labels, no_labels):
    found = toxicity.toxicity(odd, labels).collect()
    assert len(found) == len(odd_rows())
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == is_held_out(r["doc_id"])
    assert len({r["score"] for r in found if r["doc_id"] in (0, 1, 2)}) == 1
    assert sorted_rows(toxicity.toxicity(clashing, labels)) == sorted_rows(toxicity.toxicity(odd, labels))
    assert {r["score"] for r in toxicity.toxicity(odd, no_labels).collect()} == {0.0}
    assert toxicity.toxicity(empty, labels).count() == 0


def test_toxicity_held_out(spark, thousand):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = toxicity.toxicity(thousand, labels).where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    wrong = sum(r["predicted"] != r["toxic"] for r in found)
    assert len(found) > 50 and wrong <= 0.06 * len(found)    # not every document has labels
    # clean documents are left alone
    clean = [r for r in found if r["toxic"] == 0]
    assert sum(r["predicted"] for r in clean) <= 0.01 * len(clean)


def test_toxic_documents_go(odd, labels, clashing):
    kept = toxicity.keep_ordinary(clashing, labels)
    assert kept.columns == clashing.columns
    scores = Counter(r["doc_id"] for r in toxicity.toxicity(odd, labels).where("score < 0.5").collect())
    assert Counter(r["doc_id"] for r in kept.collect()) == scores


# ---- packing ------------------------------------------------------------------------------------

def brute_pieces(rows, capacity):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    out = []
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [packing.END]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start:start + capacity], dtype="<u4")
            out.append((r[0], piece, start, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=repr)


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing_of_odd_rows(odd, clashing, capacity):
    packed = packing.pack_documents(clashing, TOKENIZER, capacity).collect()
    found = [(r["doc_id"], r["piece"], r["start"], r["length"], zlib.crc32(bytes(r["ids"]))) for r in packed]
    assert sorted(found, key=repr) == brute_pieces(odd_rows(), capacity)
    n = check_packed(packed, capacity)
    assert n <= math.ceil(11 / 9 * sum(r["length"] for r in packed) / capacity) + 1


def test_packing_of_a_table(small):
    packed = packing.pack_documents(small, TOKENIZER).collect()
    rows = [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], zlib.crc32(bytes(r["ids"]))) for r in packed],
                  key=repr) == brute_pieces(rows, 4096)
    n, least = check_packed(packed, 4096), math.ceil(sum(r["length"] for r in packed) / 4096)
    assert n <= least + 1 + least // 50


def test_ids_of_added_tokens_and_stops(spark):
    """Added tokens count in their own letter case only; runs of stops end a word after any letter."""
    texts = ["a <|ENDOFTEXT|> b", "a <|endoftext|> b", "x<|EndOfText|>y <|STARTOFTEXT|>", "<|startoftext|>'s", "caf\u00e9.*** It's ll' we'LL'' $%&",
             "\u6771\u4eac,. \u00e9\u0301! 5.. _a_ a_'. ''", "  lead \x0b\x0c trail  ", "\x1c a\x1db \u00a0 c\u2003d", "\u2665 \u2605\u2665. \u2022"]
    rng = random.Random(4)
    texts += ["".join(rng.choice("abXZ '.,*#_<|>5\u00e9\u00df\u6771\u0301\t\n") for _ in range(60)) for _ in range(300)]
    rows = list(enumerate(texts))
    pieces = packing.tokenize_pieces(spark.createDataFrame(rows, "doc_id bigint, text string"), TOKENIZER).collect()
    found = [(r["doc_id"], r["piece"], r["start"], r["length"], zlib.crc32(bytes(r["ids"]))) for r in pieces]
    assert sorted(found, key=repr) == brute_pieces(rows, 4096)


def test_sequences_hold_all_ids(odd, empty):
    packed = packing.pack_documents(odd, TOKENIZER)
    total = packed.agg(F.sum("length")).first()[0]
    assert packing.sequences(packed).agg(F.sum(F.length("ids"))).first()[0] == 4 * total
    assert packing.pack_documents(empty, TOKENIZER).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_piece_once(seed):
    rng, capacity = random.Random(seed), 30
    counts = Counter(rng.randint(1, capacity) for _ in range(rng.choice([1, 7, 400])))
    plan = packing.plan_packing(counts, capacity)
    used = {}
    for length, (starts, first, offset) in plan.slots.items():
        for rank in range(counts[length]):
            slot = int(np.searchsorted(starts, rank, side="right")) - 1
            used.setdefault(int(first[slot] + rank - starts[slot]), []).append((int(offset[slot]), length))
    rows = [{"sequence_id": s, "offset": o, "length": n} for s, parts in used.items() for o, n in parts]
    assert Counter(r["length"] for r in rows) == counts
    assert check_packed(rows, capacity) == plan.sequences
    assert plan.sequences <= 1.25 * math.ceil(sum(x * n for x, n in counts.items()) / capacity) + 1


# ---- quality rules ------------------------------------------------------------------------------

def brute_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    runs = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    twice = {r for r, n in Counter(runs).items() if n > 1}
    covered = {i + j for i, r in enumerate(runs) if r in twice for j in range(8)}
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if WORDS.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered), failed)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_rules_of_odd_rows(odd, clashing, empty):
    found = quality_rules.quality_rules(odd).collect()
    assert (sorted(repr((r["doc_id"], *[r[c] for c in BASE])) for r in found)
            == sorted(repr((r[0], *brute_counts(r[1]))) for r in odd_rows()))
    assert not any(r["kept"] and r["base_failed"] for r in found)
    assert sorted_rows(quality_rules.quality_rules(clashing)) == sorted_rows(quality_rules.quality_rules(odd))
    assert quality_rules.quality_rules(empty).count() == 0


def test_rules_of_a_table(small):
    found = {r["doc_id"]: r for r in quality_rules.quality_rules(small).collect()}
    for r in small.select("doc_id", "text").collect():
        assert tuple(found[r["doc_id"]][c] for c in BASE) == brute_counts(r["text"])


def test_rules_without_languages(odd):
    found = quality_rules.quality_rules(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert all(r["kept"] == (not r["base_failed"]) and r["nearest"] is None for r in found)


def test_rules_tell_prose_from_noise(spark, thousand):
    rng = random.Random(3)
    noise = [" ".join("".join(rng.choice("#$%&<>|*0123456789XQ") for _ in range(6)) for _ in range(200)) for _ in range(5)]
    rows = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(noise)], "doc_id bigint, text string")
    refs = quality_rules.references(thousand)
    assert not any(r["kept"] for r in quality_rules.judge(rows, refs).collect())
    sound = quality_rules.judge(thousand, refs).where("not base_failed").collect()
    assert sum(r["kept"] for r in sound) >= 0.8 * len(sound)


def test_js_distance():
    p, q = np.array([[1.0, 0.0], [0.5, 0.5], [0.0, 0.0]]), np.array([0.0, 1.0])
    far = quality_rules.js_distance(p, q)
    assert far[0] == 1 and 0 < far[1] < 1 and far[2] == 1 and quality_rules.js_distance(q, q) == 0


# ---- quality classifier -------------------------------------------------------------------------

SITES = [(3, "a.org", "a.org/x/"), (5, "a.org", "a.org/x/"), (6, "a.org", "a.org/y/"), (7, "b.org", None), (8, "c.org", "c.org/"), (99, "d.org", "d.org/")]


def test_quality_of_odd_rows(spark, odd, clashing, empty, labels, no_labels):
    sites = spark.createDataFrame(SITES, "doc_id bigint, host string, path string")
    found = quality_classifier.quality_scores(odd, labels, sites).collect()
    assert len(found) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in found)
    for r in found:
        assert r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == is_held_out(r["doc_id"])
        assert (r["host"] is not None) == (r["doc_id"] in {s[0] for s in SITES})
        if r["host"] is None:
            assert r["score"] == pytest.approx(r["own"], abs=1e-9)
    again = quality_classifier.quality_scores(clashing, labels, sites)
    assert (sorted((str(r["doc_id"]), round(r["score"], 9)) for r in again.collect())
            == sorted((str(r["doc_id"]), round(r["score"], 9)) for r in found))
    assert {r["own"] for r in quality_classifier.quality_scores(odd, no_labels, sites).collect()} == {0.5}
    assert quality_classifier.quality_scores(empty, labels, sites).count() == 0


def test_quality_against_plain_sums(spark, thousand):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    sites = quality_classifier.page_sites(spark.read.parquet(f"{SF}/pages.parquet"))
    found = quality_classifier.quality_scores(thousand, labels, sites).collect()
    n, mean = len(found), sum(r["own"] for r in found) / len(found)
    groups = {level: {} for level in ("host", "path")}
    for r in found:
        for level, at in (("host", r["host"]), ("path", (r["host"], r["path"]))):
            if r["host"] is not None and (level == "host" or r["path"] is not None):
                groups[level].setdefault(at, []).append(r["own"])

    def strength(level):
        parts = groups[level]
        total, squares = sum(map(len, parts.values())), sum(len(x) ** 2 for x in parts.values())
        parent = {h: sum(x) / len(x) for h, x in groups["host"].items()}
        between = sum(len(x) * (sum(x) / len(x) - (mean if level == "host" else parent[at[0]])) ** 2 for at, x in parts.items())
        within = sum((v - sum(x) / len(x)) ** 2 for x in parts.values() for v in x)
        return quality_classifier.strength(between, within, len(parts), total, squares, mean)

    of_host, of_path = strength("host"), strength("path")
    for r in found[:300]:
        host, path = mean, None
        if r["host"] is not None:
            own = groups["host"][r["host"]]
            host = (sum(own) - r["own"] + of_host * mean) / (len(own) - 1 + of_host)
        path = host
        if r["path"] is not None:
            own = groups["path"][r["host"], r["path"]]
            path = (sum(own) - r["own"] + of_path * host) / (len(own) - 1 + of_path)
        odds = [math.log(p / (1 - p)) for p in (r["own"], min(0.999, max(0.001, path)), mean)]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(odds[0] + odds[1] - odds[2]))), abs=1e-6)
    assert n == thousand.count()


def test_strength_shrinks_levels_without_differences():
    assert quality_classifier.strength(0.0, 10.0, 5, 100, 2000.0, 0.5) == quality_classifier.MOST_STRENGTH
    assert quality_classifier.strength(20.0, 1.0, 5, 100, 2000.0, 0.5) < 10


# ---- pipeline -----------------------------------------------------------------------------------

def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash near-dedup", "substring dedup", "mixing sources to target weights", "best-fit packing"]


def test_pipeline_of_odd_rows(spark, odd, empty, tmp_path, labels):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, empty):
        columns = docs.columns
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            if i < 4:
                assert docs.columns == columns
                where = f"{tmp_path}/{hashlib.md5(repr((i, columns, docs.count())).encode()).hexdigest()}"
                docs.write.parquet(where)
                docs = spark.read.parquet(where)
        rows = docs.collect()
        check_packed(rows, 4096)
    assert rows == []


def test_pipeline_of_a_table(spark, tmp_path):
    """Every stage on the stored rows of the one before, against brute force; then run() against the last."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        docs = stage(spark, docs, sf)
        if i < 4:
            docs.write.parquet(f"{tmp_path}/{i}")
            docs = spark.read.parquet(f"{tmp_path}/{i}")
            rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        if name == "toxicity":
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            predicted = toxicity.toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels)
            assert sorted(d for d, _ in rows) == sorted(r["doc_id"] for r in predicted.where("score < 0.5").collect())
        elif name == "simhash near-dedup":
            assert sorted(rows) == sorted((d, t) for (d, t), (_, c) in zip(before, brute_components(before)) if c == d)
        elif name == "substring dedup":
            assert sorted(rows) == sorted((d, left if n else t) for (d, t), (_, n, left) in zip(before, brute_kept(before, 35)))
        elif i == 3:
            words = {d: len(WORDS.findall(t)) for d, t in before}
            taken = Counter()
            for d, t in rows:
                taken[d] += len(WORDS.findall(t))
            assert all(taken[d] <= 3 * words[d] for d in taken) and abs(taken.total() - sum(words.values())) <= 20
        else:
            found = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in docs.collect()]
            assert sorted(found, key=repr) == brute_pieces(before, 4096)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).drop("sequence_id", "offset").collect()) == sorted(found)
