"""Streaming operators driven by parquet files, one micro-batch per file."""

import datetime as dt
import re

from pyspark.sql import functions as F

from chronoloom.core.timeline import Timeline
from chronoloom.streaming import jobs as R

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def feed(spark, tmp_path, batches, ddl):
    folder = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{folder}/b={i:03d}")
    schema = spark.read.parquet(f"{folder}/b=000").schema
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False)
        .parquet(f"{folder}/*")
    )


def drain(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    return df.sparkSession.table(name).collect()


def test_change_feed(spark, tmp_path):
    ddl = "job string, seq bigint, payload string, status string, ts timestamp"
    batches = [
        [("a", 1, "p1", "queued"), ("a", 2, "p1", "queued"), ("b", 1, "x", "processing")],
        [("a", 3, "p2", "processing"), ("b", 2, "x", "processing")],
        [("a", 4, "p3", "completed"), ("a", 5, "p4", "processing")],
        [("a", 6, "p5", "processing"), ("b", 3, "y", "processing")],
    ]
    batches = [[(*r, at(10 * i + r[1])) for r in b] for i, b in enumerate(batches)]
    stream = feed(spark, tmp_path, batches, ddl)
    changes = R.job_changes(stream, "job", "ts", ["seq"], "payload", "status", "1 minute")
    got = {(r["job"], r["seq"]) for r in drain(changes, "changes", "append")}
    assert got == {("a", 1), ("a", 3), ("a", 4), ("b", 1), ("b", 3)}
    flat = spark.createDataFrame([r for b in batches for r in b], ddl)
    twin = R.job_changes_batch(flat, Timeline(["job"], "seq", (), 2), "payload", "status")
    assert {(r["job"], r["seq"]) for r in twin.collect()} == got


def test_progress_never_falls(spark, tmp_path):
    batches = [[("a", 0.3)], [("a", 0.1)], [("a", 2.0)]]
    stream = feed(spark, tmp_path, batches, "job string, amount double")
    rows = drain(R.job_progress(stream, "job", F.col("amount")), "progress", "update")
    seen = [r["progress"] for r in rows]
    assert seen == sorted(seen) and seen[-1] == 0.97


def test_debounce(spark, tmp_path):
    batches = [
        [("k", at(0), "v0"), ("k", at(0.5), "v1"), ("k", at(1.0), "v2")],
        [("k", at(5), "v3")],
        [("k", at(60), "v4")],
        [("k", at(120), "v5")],
    ]
    stream = feed(spark, tmp_path, batches, "key string, ts timestamp, state string")
    rows = drain(R.debounce(stream, "key", "ts", "state", "700 milliseconds", "1 second"), "saves", "append")
    assert [r["state"] for r in sorted(rows, key=lambda r: r["saved_at"])][:3] == ["v2", "v3", "v4"]


def test_sweep_gives_up_silent_jobs(spark, tmp_path):
    batches = [
        [("a", at(0), "processing"), ("b", at(0), "processing")],
        [("b", at(5), "completed")],
        [("c", at(500), "queued")],
        [("c", at(501), "queued")],
    ]
    stream = feed(spark, tmp_path, batches, "job string, ts timestamp, status string")
    rows = drain(R.sweep_stream(stream, "job", "ts", "1 second", 60_000, "ANALYSIS_INTERRUPTED"), "swept", "append")
    assert [(r["job"], r["status"], r["error_code"]) for r in rows] == [("a", "failed", "ANALYSIS_INTERRUPTED")]


def test_protected_upsert(spark, tmp_path):
    ddl = "track_id bigint, pos bigint, source string, edited boolean, locked boolean"
    batches = [
        [(1, 100, "fused", False, False), (1, 200, "manual", False, False), (2, 50, "fused", False, False)],
        [(1, 205, "fused", False, False), (1, 300, "fused", False, False)],
        [(2, 70, "stems", False, False), (2, 70, "stems", False, False)],
    ]
    stream = feed(spark, tmp_path, batches, ddl)
    path = str(tmp_path / "table")
    tl = Timeline(["track_id"], "pos", ["id"], 1000)
    query = R.stream_merge(stream, path, str(tmp_path / "cp"), tl, 10).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    rows = R.stored_rows(spark, path, ddl).collect()
    # track 1: the manual row stays, 205 is too close to it, 100 was automatic and is gone
    assert {(r["track_id"], r["pos"]) for r in rows} == {(1, 200), (1, 300), (2, 70)}


def test_upsert_reads_and_keeps_touched_buckets_only(spark, tmp_path, capsys):
    ddl = "track_id bigint, pos bigint, source string, edited boolean, locked boolean"
    path, tl = str(tmp_path / "table"), Timeline(["track_id"], "pos", ["id"], 1000)

    def batch(i):
        rows = [(t, 100 * i + t, "fused", False, False) for t in range(i % 3, 12, 3)] + [(50 + i, 7, "manual", False, True)]
        return spark.createDataFrame(rows, ddl)

    def rows():
        return sorted(map(tuple, R.stored_rows(spark, path, ddl).drop("version").collect()))

    for i in range(12):
        R.merge_into(batch(i), i, path, tl, 10, buckets=8)
    before = rows()
    assert {(r[1], r[2]) for r in before if r[1] < 12} == {(t, 100 * max(i for i in range(12) if i % 3 == t % 3) + t) for t in range(12)}
    assert {r[1] for r in before if r[1] >= 50} == {50 + i for i in range(12)}
    # a repeated batch, whole or half done before, gives the same rows
    R.merge_into(batch(11), 11, path, tl, 10, buckets=8)
    assert rows() == before
    late = batch(12)
    touched = [r[0] for r in late.select(R.bucket_of(["track_id"], 8)).distinct().collect()]
    state = R.bucketed_state(spark, path, ddl, touched[:2], 12)
    assert {r["bucket"] for r in state.collect()} <= set(touched[:2])
    state.explain()
    scans = [line for line in capsys.readouterr().out.splitlines() if "FileScan" in line]
    assert scans and all(re.search(r"PartitionFilters: \[[^\]]*bucket", line) for line in scans)
    folders = list((tmp_path / "table").glob("bucket=*/slot=*"))
    assert len(folders) <= 16
