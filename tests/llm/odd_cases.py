"""Rows that operators must not trip over."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# columns that the operators use themselves
CLASHING = ("size", "score", "row", "key", "fp", "label", "starts", "rank", "component", "length", "shard", "_key", "id", "x", "taken")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows, shared passages."""
    passage, base = prose(1, 60), prose(2, 120)
    near = base.split()
    near[60] = "zzz"
    texts = [None, "", " \n\t ", "one", "One two three", base, base, " ".join(near), prose(3, 40) + " " + passage + "\nend",
             passage.replace(" ", "\t") + " tail", prose(4, 30_000), "Ünïcode ß straße 東京 \x0b x\x0cy 😀 a\x85b", "same line\nsame line\nsame line",
             "rep " * 50, "A" * 5000, prose(5, 34), prose(6, 35) + " " + prose(6, 35)]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, base, None, None, None), (None, None, None, None, None), (-7, passage, "en", "s1", 1)]


def sorted_rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))
