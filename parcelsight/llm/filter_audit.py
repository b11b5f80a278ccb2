"""Filter interaction audit by an incremental stream with retractions.

Five filters judge a document; what they do to a corpus in any order follows from how many documents fail
which of them together. Four look at one text. The fifth (an exact copy of a text with a smaller id) needs the whole table,
so the files are processed as available-now micro-batches and a text's state holds the smallest id so far with the rows that
have it: those pass. When a smaller id arrives, their earlier mask is retracted from their part's counters
and they are counted again as copies. The counters are sums of such changes; each micro-batch writes its own,
overwritten if the batch runs again, so that they are counted once.

Texts never leave the first step: there each becomes a checksum (128 bits of SHA-256) and four bits. A text that very many
rows share is cut down before it is shuffled: within an Arrow batch only the rows with its smallest id can still
pass, all others are counted by part. State is kept in RocksDB, on disk; a state row holds the texts of one
bucket of checksums, and `buckets` grows with the table, so that a row stays at some tens of kilobytes.

Conditions of failure: A under 50 words; B fewer than 65 distinct words in a hundred; C over 5 capitals A-Z in a hundred code
points; D any of #$%&*|; E a smaller id has the identical text.

Defined results: a null text counts as empty; a null source is the part ''; a null id has no order, so its row neither fails
E nor makes others fail; repeated rows share an id and pass or fail together; of repeated labels one that says 1
wins, other values and null ids count as nothing; no rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parcelsight.llm.common import stored, text_of
from parcelsight.session import scratch_dir

LETTERS = "ABCDE"
COPY = 16                   # E's bit; A to D have 1, 2, 4 and 8
BATCHES = 4                 # micro-batches that the files are dealt over
TEXTS_IN_STATE = 512        # per state row, on average
BUCKETS = 4096              # state rows, unless the caller knows the table's size
CAPITALS = bytes(range(65, 91))
FOLLOWING = bytes(range(0x80, 0xC0))    # bytes that do not begin a code point
SYMBOLS = b"#$%&*|"
# state on disk, a bounded share of memory, changes instead of whole snapshots in the checkpoint
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",       # else every small store reserves megabytes
}


def text_mask(text: bytes) -> int:
    """The bits of A to D."""
    words = text.split()
    size, points = len(words), len(text.translate(None, FOLLOWING))
    return ((size < 50) | (100 * len(set(words)) < 65 * size) << 1
            | (100 * (len(text) - len(text.translate(None, CAPITALS))) > 5 * points) << 2
            | (len(text.translate(None, SYMBOLS)) < len(text)) << 3)


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to checksums and bits; equal rows of a batch become one with a count."""
    for batch in batches:
        rows: Counter = Counter()
        for doc_id, part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            text = text.as_py()
            rows[hashlib.sha256(text).digest()[:16], text_mask(text), doc_id, part] += 1
        yield _columns([(*k, n) for k, n in rows.items()], MASKED)


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a batch, only a text's smallest id may pass; the others are copies for certain."""
    for batch in batches:
        rows = list(zip(*[c.to_pylist() for c in batch.columns]))
        least: dict[bytes, int] = {}
        for key, _, doc_id, *_ in rows:
            if doc_id is not None and doc_id < least.get(key, doc_id + 1):
                least[key] = doc_id
        out: Counter = Counter()
        for key, mask, doc_id, part, n, good, toxic in rows:
            if doc_id is not None and doc_id > least[key]:
                out[key, mask | COPY, None, part, good, toxic] += n
            else:
                out[key, mask, doc_id, part, good, toxic] += n
        yield _columns([(*k, n) for k, n in out.items()], NARROW)


def _columns(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [f for f, _ in fields])


MASKED = [("key", pa.binary()), ("mask", pa.int32()), ("id", pa.int64()), ("part", pa.string()), ("n", pa.int64())]
NARROW = [("key", pa.binary()), ("mask", pa.int32()), ("id", pa.int64()), ("part", pa.string()), ("good", pa.int32()),
          ("toxic", pa.int32()), ("n", pa.int64())]
CHANGES = "part string, mask int, good int, toxic int, n bigint"
CHANGE_COLUMNS = ["part", "mask", "good", "toxic", "n"]


HELD = [("key", pa.binary()), ("least", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("good", pa.int32()),
        ("toxic", pa.int32()), ("n", pa.int64())]


def _packed(held: dict[bytes, tuple[int, dict]]) -> bytes:
    """Texts' smallest ids and the rows that have them, as Arrow columns."""
    sink = pa.BufferOutputStream()
    batch = _columns([(key, least, *row, n) for key, (least, holders) in held.items() for row, n in holders.items()], HELD)
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> dict[bytes, tuple[int, dict]]:
    held: dict[bytes, tuple[int, dict]] = {}
    for key, least, *row, n in zip(*[c.to_pylist() for c in pa.ipc.open_stream(packed).read_all().columns]):
        held.setdefault(key, (least, {}))[1][tuple(row)] = n
    return held


def changes_of(bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The rows of some texts in a micro-batch to changes of their parts' counters. The state has each text's
    smallest id and the rows that have it: (part, mask, good, toxic) and their number."""
    held = _unpacked(bytes(state.get[0])) if state.exists else {}
    out: Counter = Counter()
    for frame in frames:
        columns = [frame[c].tolist() for c in ("key", "order", "n", "part", "mask", "good", "toxic")]
        for known, key, doc_id, n, *row in zip(frame["id"].notna().tolist(), *columns):
            if not known:
                out[tuple(row)] += n
                continue
            if key not in held or doc_id < held[key][0]:
                for (part, mask, good, toxic), m in held[key][1].items() if key in held else ():
                    out[part, mask, good, toxic] -= m
                    out[part, mask | COPY, good, toxic] += m
                held[key] = doc_id, {}
            least, holders = held[key]
            if doc_id == least:
                holders[tuple(row)] = holders.get(tuple(row), 0) + n
                out[tuple(row)] += n
            else:
                part, mask, good, toxic = row
                out[part, mask | COPY, good, toxic] += n
    if held:
        state.update((_packed(held),))
    rows = [(*k, n) for k, n in out.items() if n]
    if rows:
        yield pd.DataFrame(rows, columns=CHANGE_COLUMNS)


def label_facts(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(id, good, toxic): one row per id with a label that counts."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    return (labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("bigint").alias("id"))
            .agg(one("quality").alias("good"), one("toxic").alias("toxic")).where("good = 1 or toxic = 1"))


def counter_changes(docs: DataFrame, facts: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source",
                    buckets: int = BUCKETS) -> DataFrame:
    """A stream of documents and their label facts to a stream of counter changes (part, mask, good, toxic, n)."""
    ddl = lambda fields: ", ".join(f"{f} {kinds[str(t)]}" for f, t in fields)
    kinds = {"binary": "binary", "int32": "int", "int64": "bigint", "string": "string"}
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"),
                       text_of(text).cast("binary").alias("text"))
    masked = rows.mapInArrow(_masked, ddl(MASKED)).join(facts, "id", "left").select(
        "key", "mask", "id", "part", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    # pandas turns a column with nulls into doubles: the id's order goes beside it, whole
    narrow = masked.mapInArrow(_firsts, ddl(NARROW)).withColumn("order", F.coalesce("id", F.lit(0).cast("bigint")))
    # a call of Python costs as much as some hundred rows, so a state row holds the texts of a bucket
    # and rows that cannot pass need no state: those of a text with very many copies are shared out by what they count
    spread = F.when(F.col("id").isNull(), F.xxhash64("part", "mask", "good", "toxic", "n"))
    held = narrow.withColumn("bucket", F.pmod(F.xxhash64("key", spread), F.lit(buckets).cast("bigint")))
    return held.groupBy("bucket").applyInPandasWithState(
        changes_of, CHANGES, "held binary", "update", GroupStateTimeout.NoTimeout)


def counters(docs: DataFrame, labels: DataFrame, root: str, key: str = "doc_id", text: str = "text",
             part: str = "source", buckets: int = BUCKETS) -> DataFrame:
    """(part, mask, good, toxic, n): the sums of all changes, once every file that is there has been processed. `root`
    is a shared folder; a second call on it, with the same `buckets`, goes on with the files that came since."""
    spark = docs.sparkSession
    facts = stored(label_facts(labels), "audit-labels")

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*CHANGE_COLUMNS[:4]).agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{root}/changes/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    try:
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        running = (counter_changes(docs, facts, key, text, part, buckets).writeStream.foreachBatch(write).outputMode("update")
                   .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    running.awaitTermination()
    try:
        changes = spark.read.schema(CHANGES).parquet(f"{root}/changes")
    except Exception:       # no batch ran: there were no files
        changes = spark.createDataFrame([], CHANGES)
    return changes.groupBy(*CHANGE_COLUMNS[:4]).agg(F.sum("n").alias("n")).where(F.col("n") != 0)


def steps() -> str:
    """Every filter at every place of every order, with its bit and the bits of those before it, as JSON."""
    bit = {f: 1 << i for i, f in enumerate(LETTERS)}
    return json.dumps([{"filter_order": "".join(p), "step": i + 1, "own": bit[p[i]], "before": sum(bit[f] for f in p[:i])}
                       for p in permutations(LETTERS) for i in range(len(LETTERS))])


def interactions(counted: DataFrame) -> DataFrame:
    """Counters to one row per part, order and step."""
    cells = (counted.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
        .groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")))     # at most 32
    step = "array<struct<filter_order: string, step: int, own: int, before: int>>"
    rows = cells.select("part", "cells", F.explode(F.from_json(F.lit(steps()), step)).alias("s")).select("part", "cells", "s.*")
    own, before = F.col("own"), F.col("before")

    def total(value, holds):
        picked = F.filter("cells", lambda c: holds(c["mask"]))
        return F.aggregate(F.transform(picked, value), F.lit(0).cast("bigint"), lambda a, x: a + x)

    removed = lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) == 0)
    orders = math.factorial(len(LETTERS))
    return rows.select(
        "part", "filter_order", "step",
        total(lambda c: c["n"], lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total(lambda c: c["n"], removed).alias("removed"),
        total(lambda c: c["n"], lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total(lambda c: c["n"], lambda m: m == own).alias("unique_fails"),
        total(lambda c: c["good"], removed).alias("good_lost"), total(lambda c: c["toxic"], removed).alias("toxic_lost"),
        # of all orders, a document is removed by each of its filters equally often
        total(lambda c: c["n"] * (F.lit(orders) / F.bit_count(c["mask"])).cast("bigint"), lambda m: m.bitwiseAND(own) != 0).alias("shapley"))


def stream_files(spark: SparkSession, path: str, batches: int = BATCHES) -> DataFrame:
    """The files of a table as a stream, dealt over at most so many micro-batches."""
    table = spark.read.parquet(path)
    each = max(1, -(-len(table.inputFiles()) // batches))
    as_glob = f"{path[:-1]}[{path[-1]}]"        # only a pattern may name a single file as well as a folder
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", str(each)).parquet(as_glob)


def buckets_of(rows: int) -> int:
    """State rows for so many documents: each holds about TEXTS_IN_STATE texts, at any size of the table."""
    return max(1, rows // TEXTS_IN_STATE)


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source",
          buckets: int = BUCKETS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of a stream of
    documents that ends when all its files are processed."""
    return interactions(counters(docs, labels, scratch_dir(docs.sparkSession, "filter-audit"), key, text, part, buckets))
