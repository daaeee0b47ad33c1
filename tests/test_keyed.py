"""Keyed tables that merge, and requests as keyed state: streams against batches, in one file and in many."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.streaming import stages as G
from tessera.streaming import windows as W
from tessera.streaming.keyed import keyed_table

KIND = "k long, at long, a string, b string"


def table_of(spark, tmp_path, **options):
    return keyed_table(spark, spark.createDataFrame([], KIND).schema, ["k"], "at", at=f"file://{tmp_path}/t", **options)


def content(table):
    return {r.k: (r.at, r.a, r.b) for r in table.rows().collect()}


def test_late_columns_join_their_row(spark, tmp_path):
    table = table_of(spark, tmp_path)
    table.upsert(spark.createDataFrame([(1, 5, "x", None), (2, 5, "y", None), (2, 4, "old", "kept")], KIND), 0)
    table.upsert(spark.createDataFrame([(1, 3, None, "late"), (1, 2, "older", None), (3, 1, None, None)], KIND), 1)
    assert content(table) == {1: (5, "x", "late"), 2: (5, "y", "kept"), 3: (1, None, None)}


def test_whole_rows(spark, tmp_path):
    table = table_of(spark, tmp_path, whole=True)
    table.upsert(spark.createDataFrame([(1, 5, "x", "z")], KIND), 0)
    table.upsert(spark.createDataFrame([(1, 6, None, "n"), (1, 4, "late", "l")], KIND), 1)
    assert content(table) == {1: (6, None, "n")}


def size_of(folder):
    return sum(os.path.getsize(f) for f in glob.glob(f"{folder}/**/*.parquet", recursive=True))


def test_a_batch_writes_its_keys_only_and_once(spark, tmp_path):
    table = table_of(spark, tmp_path)
    table.upsert(spark.range(20_000).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("at"), F.sha2(F.col("id").cast("string"), 256).alias("a"), F.lit("b").alias("b")), 0)
    whole = size_of(f"{tmp_path}/t")
    one = spark.createDataFrame([(7, 2, "new", None)], KIND)
    table.upsert(one, 1)
    after = size_of(f"{tmp_path}/t")
    assert after - whole < 20_000 and whole > 500_000
    table.upsert(one, 1)
    table.upsert(spark.createDataFrame([(7, 9, "replayed", None)], KIND), 0)
    assert size_of(f"{tmp_path}/t") == after and table.manifest()[0] == 2
    assert [(r.a, r.b) for r in table.rows(spark.createDataFrame([(7,)], "k long")).collect()] == [("new", "b")]


def test_commits_that_did_not_end_are_not_there(spark, tmp_path):
    table = table_of(spark, tmp_path)
    table.upsert(spark.createDataFrame([(1, 1, "a", "b")], KIND), 0)
    os.makedirs(f"{tmp_path}/t/manifest/2")  # without its mark
    os.makedirs(f"{tmp_path}/t/delta/batch-1/_bucket=3")
    assert table.manifest()[0] == 1
    table.upsert(spark.createDataFrame([(1, 2, "c", None)], KIND), 1)
    assert content(table) == {1: (2, "c", "b")}


def test_compaction_and_vacuum_change_nothing(spark, tmp_path):
    rng = random.Random(1)
    table, want = table_of(spark, tmp_path, buckets=4, most_deltas=3), {}
    for n in range(9):
        rows = [(rng.randrange(12), rng.randrange(10_000), rng.choice([None, "p", "q"]), rng.choice([None, "r"])) for _ in range(rng.randint(1, 6))]
        table.upsert(spark.createDataFrame(rows, KIND), n)
        for k, at, *values in rows:
            old = want.setdefault(k, [-1, (-1, None), (-1, None)])
            old[0] = max(old[0], at)
            for i, v in enumerate(values, 1):
                if v is not None:
                    old[i] = max(old[i], (at, v))
    flat = {k: (at, a[1], b[1]) for k, (at, a, b) in want.items()}
    assert content(table) == flat and max(len(f) for f in table.manifest()[1].values()) <= 3
    assert table.vacuum() > 0 and content(table) == flat and table.vacuum() == 0


EVENTS = "u long, event_id long, ts timestamp, event_type string, value double"
RULES = G.Rules(("hit", "error"), ("late",), 60, 10)


def plain(rows):
    """Each key's events in turn, as lists of requests."""
    out = []
    newest = max(r[2] for r in rows)
    for u in {r[0] for r in rows}:
        requests, before = [], None
        for _, _, ts, kind, value in sorted((r for r in rows if r[0] == u), key=lambda r: (r[2], r[1])):
            if before is not None and ts - before >= 60 and requests and requests[-1]:
                requests.append(None)  # an idle gap: nothing of before is enriched
            before = ts
            now = requests[-1] if requests else None
            if kind == "late":
                if now:
                    now["events"].append((ts, value, False))
                    if now["ended"]:
                        now["shown"].append(list(now["events"]))
                continue
            if not now or now["ended"]:
                now = {"events": [], "ended": None, "shown": []}
                requests.append(now)
            now["events"].append((ts, value, True))
            if kind in ("hit", "error"):
                now["ended"] = kind
                now["shown"].append(list(now["events"]))
        real = [r for r in requests if r]
        for n, r in enumerate(real, 1):
            if not r["ended"]:
                if r is not real[-1] or requests[-1] is None or newest - before >= 70:
                    r["shown"].append(r["events"])
            for v, events in enumerate(r["shown"], 1):
                out.append((u, n, v, min(e[0] for e in events), max(e[0] for e in events), sum(e[2] for e in events), round(sum(e[1] for e in events), 6), r["ended"] or "idle"))
    return sorted(out)


def seen(rows):
    return sorted((r.u, r.request, r.version, int(r.first.timestamp()), int(r.last.timestamp()), r.stages, r.total, r.ended) for r in rows.withColumn("first", F.to_timestamp("first")).collect())


@pytest.mark.parametrize("files", [1, 7])
def test_stages_of_a_stream_are_those_of_the_batch(spark, tmp_path, files):
    rng = random.Random(5)
    moments = sorted(rng.sample(range(1_000_000, 1_004_000), 700))
    rows = [(rng.randrange(9), n, ts, rng.choice(["a", "b", "hit", "error", "late", "late"]), float(rng.randrange(8))) for n, ts in enumerate(moments)]
    table = spark.createDataFrame(rows, "u long, event_id long, ts long, event_type string, value double").withColumn("ts", F.timestamp_seconds("ts"))
    want = plain(rows)
    assert seen(G.staged(table, "u", RULES)) == want and {"idle", "hit", "error"} <= {r[7] for r in want} and max(r[2] for r in want) > 2
    size = -(-len(rows) // files)
    for k in range(files):
        part = table.where(f"event_id >= {k * size} AND event_id < {(k + 1) * size}").coalesce(1)
        part.write.mode("append").parquet(f"{tmp_path}/events")
    stream = W.file_stream(spark, f"{tmp_path}/events", table.schema, 1)
    assert seen(W.run_to_end(G.staged_stream(stream, "u", RULES), f"stages-{files}")) == want
