from __future__ import annotations

import random

from parcelsight.operators import feeds


def three_passes(items, total):
    """The pick written as plain loops."""
    picked, scenarios = [], set()
    for d in items:
        if d["scenario_type"] not in scenarios:
            picked.append(d["id"]), scenarios.add(d["scenario_type"])
    streets = {d["address"] for d in items if d["id"] in picked}
    second = []
    for d in items:
        if d["id"] not in picked and d["address"] not in streets:
            second.append(d["id"]), streets.add(d["address"])
    rest = [d["id"] for d in items if d["id"] not in picked and d["id"] not in second]
    return (picked + second + rest)[:total]


def test_diverse_pick_equals_three_passes(spark):
    rng, rows, expected = random.Random(5), [], {}
    for g in range(300):
        items = [{"id": f"{g}-{i}", "scenario_type": rng.choice("abcd"), "address": rng.choice("uvwxyz")}
                 for i in range(rng.randint(1, 20))]
        total = 6
        expected[g] = three_passes(items, total)
        rows += [(g, i, d["id"], d["scenario_type"], d["address"]) for i, d in enumerate(items)]
    df = spark.createDataFrame(rows, "g int, pos int, id string, scenario_type string, address string")
    got: dict[int, list[str]] = {}
    for r in feeds.diverse_pick(df, 6, "g").orderBy("g", "pick").collect():
        got.setdefault(r["g"], []).append(r["id"])
    assert got == expected


def test_balanced_keeps_severity_order_on_ties(spark):
    rows = [(f"{sev}{i}", sev, "2024-01-01T00:00:00Z") for sev in ("low", "critical", "medium", "high") for i in range(9)]
    df = spark.createDataFrame(rows, "id string, severity string, triggered_at string")
    got = [r["severity"] for r in feeds.balanced_alerts(df, 10).collect()]
    assert got == ["critical"] * 3 + ["high"] * 3 + ["medium"] * 3 + ["low"]
