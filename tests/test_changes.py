from __future__ import annotations

import json

from parcelsight.operators import joins, metrics
from parcelsight.sources import changes, readers


def keyed(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, v string, seq int")


def test_last_write_wins_then_delete(spark):
    log = changes.as_changes(keyed(spark, ("a", "1", 1), ("a", "2", 2), ("b", "1", 1)))
    assert {(r["id"], r["v"]) for r in changes.current_rows(log, "id", ["seq"]).collect()} == {("a", "2"), ("b", "1")}
    gone = log.unionByName(changes.as_changes(keyed(spark, ("a", None, 3)), changes.DELETE))
    assert [r["id"] for r in changes.current_rows(gone, "id", ["seq"]).collect()] == ["b"]
    back = gone.unionByName(changes.as_changes(keyed(spark, ("a", "4", 4))))
    assert changes.current_rows(back, "id", ["seq"]).count() == 2


def test_merging_twice_changes_nothing(spark):
    state = keyed(spark, ("a", "1", 1), ("b", "1", 1))
    new = changes.as_changes(keyed(spark, ("a", "2", 2), ("c", "1", 1)))
    once = changes.merge_changes(state, new, "id", ["seq"])
    twice = changes.merge_changes(once, new, "id", ["seq"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [
        ("a", "2", 2), ("b", "1", 1), ("c", "1", 1)]


def test_tombstone_without_row_is_ignored(spark):
    left = changes.apply_deletes(keyed(spark, ("a", "1", 1)), keyed(spark, ("a", "", 0), ("z", "", 0)))
    assert left.count() == 0


def test_json_lines_keep_their_types_and_bad_lines(spark, tmp_path):
    good = {"id": "e1", "type": "door_open", "home_id": "h", "timestamp": "2024-05-01T10:00:00Z",
            "raw_data": {"door_angle": 91.5}}
    (tmp_path / "a.json").write_text(json.dumps(good) + "\n{not json\n")
    rows = {r["id"]: r for r in readers.read_raw(spark, "events", str(tmp_path)).collect()}
    assert rows["e1"]["raw_data"]["door_angle"] == 91.5 and rows["e1"]["raw_data"]["signal_strength"] is None
    assert str(rows["e1"]["event_ts"]) == "2024-05-01 10:00:00" and rows["e1"]["device_id"] is None
    assert rows[None][readers.CORRUPT] == "{not json"


def test_lookup_by_few_many_and_frame(spark):
    df = keyed(spark, *[(f"k{i}", "x", i) for i in range(50)])
    assert joins.lookup_by_id(df, ["k1", "k7", "none"]).count() == 2
    assert joins.lookup_by_id(df, [f"k{i}" for i in range(25, 2000)]).count() == 25
    assert joins.lookup_by_id(df, df.where("seq < 3").unionByName(df.where("seq < 3"))).count() == 3


def test_collection_that_is_not_there_counts_zero(spark, tmp_path):
    there = keyed(spark, ("a", "x", 1))
    gone = readers.try_read(spark, "homes", str(tmp_path / "nothing"))
    assert gone is None
    rows = metrics.collection_counts({"homes": gone, "deliveries": there}).collect()
    assert {(r["collection"], r["row_count"]) for r in rows} == {("homes", 0), ("deliveries", 1)}


def test_compacted_log_gives_the_same_state(spark, tmp_path):
    log = changes.as_changes(keyed(spark, ("a", "1", 1), ("b", "1", 1), ("a", "2", 2))).unionByName(
        changes.as_changes(keyed(spark, ("b", None, 3)), changes.DELETE))
    changes.compact(log, "id", ["seq"], str(tmp_path / "snap"))
    more = changes.as_changes(keyed(spark, ("c", "1", 4)))
    pick = lambda df: sorted(map(tuple, changes.current_rows(df, "id", ["seq"]).collect()))
    snapshot = spark.read.parquet(str(tmp_path / "snap"))
    assert pick(snapshot.unionByName(more)) == pick(log.unionByName(more))
    late = changes.as_changes(keyed(spark, ("b", "2", 2)))
    assert pick(snapshot.unionByName(late)) == pick(log.unionByName(late)) == pick(log)


def test_documents_that_no_collection_takes(spark):
    rows = [("events", "1", '{"id": "1"}'), ("events", "2", "{broken"), ("events", "3", None), ("homes", "4", "{}"), (None, "5", "{}"), ("events", "6", "[1]")]
    mixed = spark.createDataFrame(rows, "collection string, key string, value string")
    assert [r["id"] for r in changes.route_by_collection(mixed, "events", "id string").collect()] == ["1"]
    found = {r["key"]: r["reason"] for r in changes.unroutable(mixed, ["events"]).collect()}
    assert found == {k: "malformed value" for k in "236"} | {k: "unknown collection" for k in "45"}


def test_ties_keep_the_same_row(spark):
    rows = [("a", str(i), 1) for i in range(50)]
    kept = {changes.upsert_latest(keyed(spark, *order).repartition(n), "id", ["seq"]).first()["v"]
            for n, order in ((1, rows), (3, rows[::-1]), (7, rows))}
    assert len(kept) == 1
