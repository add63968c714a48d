"""Sources, sinks and extractors on files."""

import hashlib
import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from chronoloom.core.timeline import Timeline
from chronoloom.functions import text as X
from chronoloom.operators import metrics as A
from chronoloom.operators.extractors import ExtractionError, Extractor, extract, register_extractor
from chronoloom.sources import readers, sinks

HIT = {"id": "h1", "sample": 10, "acousticSample": 12, "snappedSample": 11, "band": "low_hit", "confidence": 0.9}


def test_analysis_snapshots(spark, tmp_path):
    docs = {
        "root": {"trackId": "t-root", "hitPoints": [HIT], "tempoMap": [{"startSample": 0, "bpm": 120.0}]},
        "nested": {"track": {"id": "t-track", "hitPoints": [HIT, {**HIT, "id": "h2", "acousticSample": None}]}},
        "late.analysis": {"analysis": {"hitPoints": [], "candidateEvents": [{"id": "c", "lane": "mix"}]}},
    }
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    out = readers.read_analysis(spark, str(tmp_path))
    hits = readers.evaluation_positions(out["hits"]).orderBy("track_id", "idx").collect()
    assert [(r["track_id"], r["id"], r["acoustic"], r["chart"]) for r in hits] == [
        ("t-root", "h1", 12, 11), ("t-track", "h1", 12, 11), ("t-track", "h2", 10, 11),
    ]
    assert [r["track_id"] for r in out["candidates"].collect()] == ["late"]
    assert out["tempo"].collect()[0]["bpm"] == 120.0


def test_truth_against_predictions(spark, tmp_path):
    onsets = [{"sample": s, "strength": w, "band": "low", "layers": ["kick"]} for s, w in ((100, 0.9), (200, 0.5), (300, 0.9))]
    doc = {"slug": "song", "sampleRate": 1000, "durationSec": 60.0, "bpm": 120.0, "beatOffsetSample": 0, "onsets": onsets}
    (tmp_path / "song.ground-truth.json").write_text(json.dumps(doc))
    truth = readers.read_truth(spark, str(tmp_path)).select(
        F.col("slug").alias("track_id"), "idx", F.col("sample").alias("pos"), F.col("strength").alias("score")
    )
    assert [r["idx"] for r in truth.orderBy("pos").collect()] == [0, 1, 2]
    pred = spark.createDataFrame([("song", 0, 98), ("song", 1, 206), ("song", 2, 600)], "track_id string, idx bigint, pos bigint")
    tracks = spark.createDataFrame([("song", 60.0)], "track_id string, duration_sec double")
    tl = Timeline(["track_id"], "pos", (), 1000)
    row = A.event_metrics(truth, pred, tracks, tl, [10], 1000).collect()[0]
    assert (row["tp"], row["fp"], row["fn"]) == (2, 1, 1)
    assert row["median_error_ms"] == 4.0 and row["p95_error_ms"] == 6.0
    strong = A.strong_metrics(truth, pred, tracks, tl, [10], 1000, 0.8).collect()[0]
    assert (strong["tp"], strong["fp"], strong["fn"]) == (1, 1, 1)
    others = spark.createDataFrame([("else",)], "track_id string")
    assert [r["track_id"] for r in readers.missing_predictions(truth, others, ["track_id"]).collect()] == ["song"]


def test_golden_metrics(spark):
    tl = Timeline(["track_id"], "pos", (), 1000)
    rows = spark.createDataFrame([("t", p) for p in (100, 103, 107, 200)], "track_id string, pos bigint")
    assert A.duplicate_count(rows, tl, 8).collect()[0]["duplicates"] == 2
    truth = spark.createDataFrame([("t", p) for p in (0, 250, 500)], "track_id string, pos bigint")
    pred = spark.createDataFrame([("t", p) for p in (0, 500, 750)], "track_id string, pos bigint")
    r = A.cell_accuracy(truth, pred, ["track_id"], "pos", F.lit(1000 * 60.0 / 60 / 4), F.lit(0)).collect()[0]
    assert (r["correct"], r["missing"], r["extra"], r["accuracy"]) == (2, 1, 1, 0.5)


def test_rhythm_cells(spark):
    from chronoloom.operators.sequences import rhythm_constrain

    rows = [
        (1, 22_250, 0.60, ["a"], {"drums": 0.4}), (2, 21_950, 0.95, ["b"], {"drums": 0.9}), (3, 25_550, 0.9, ["c"], {"drums": 0.5}),
    ]
    hits = spark.createDataFrame(rows, "id bigint, refined bigint, confidence double, votes array<string>, evidence map<string,double>").withColumns({
        "track_id": F.lit("t"), "salience": F.lit(0.5), "primary_stem": F.lit("drums"), "bpm": F.lit(120.0),
        "beat_offset": F.lit(0).cast("bigint"), "tempo_confidence": F.lit(0.9), "tempo_source": F.lit("auto"),
    })
    out, stats = rhythm_constrain(hits, ["track_id"], "id", 44_100, F.lit(441_000))
    got = {r["refined"]: r for r in out.collect()}
    assert set(got) == {21_950, 25_550} and got[21_950]["chart"] == 22_050
    # 300 samples apart is close enough to pass evidence on (9 ms = 397 samples)
    assert got[21_950]["votes"] == ["a", "b", "rhythm_1_16"]
    s = stats.collect()[0]
    assert (s["merged_same_grid"], s["retained_off_grid"], s["output_count"]) == (1, 1, 2)
    apart = hits.withColumn("refined", F.when(F.col("id") == 1, 22_650).when(F.col("id") == 2, 21_950).otherwise(F.col("refined")))
    out, _ = rhythm_constrain(apart, ["track_id"], "id", 44_100, F.lit(441_000))
    assert {r["id"]: r["votes"] for r in out.collect()}[2] == ["b", "rhythm_1_16"]


def test_sinks(spark, tmp_path):
    rows = [("t", i, 100 - i, 100 - i, ["vocals", "piano", None][i % 3]) for i in range(9)]
    hits = spark.createDataFrame(rows, "track_id string, id bigint, refined bigint, snapped bigint, primary_stem string").withColumns({
        "acoustic": F.lit(None).cast("bigint"), "chart": F.lit(None).cast("bigint"), "source": F.lit("fused"), "band": F.lit("mid_hit"),
        "confidence": F.lit(0.5), "salience": F.lit(0.5), "snap_error_ms": F.lit(0.0), "edited": F.lit(False), "locked": F.lit(False),
    })
    sinks.write_marker_csv(hits, str(tmp_path / "csv"), 100)
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == sinks.CSV_COLUMNS and back.count() == 9
    candidates = hits.select("track_id", "id", F.col("refined").alias("acoustic"))
    sinks.write_marker_package(hits, candidates, str(tmp_path / "pkg"), 100)
    markers = spark.read.json(str(tmp_path / "pkg" / "markers"))
    assert {r["primary_stem"]: r["count"] for r in markers.groupBy("primary_stem").count().collect()} == {"vocals": 3, "mix": 6}
    tracks = spark.createDataFrame([("t", 1000, 2)], "track_id string, sample_count bigint, channels int")
    manifest = {r["primary_stem"]: r for r in sinks.package_manifest(tracks, hits, candidates, 100).collect()}
    assert len(manifest) == 5 and manifest["drums"]["count"] == 0 and manifest["vocals"]["marker_count"] == 9


def test_extractor_isolates_bad_rows(spark):
    def shout(pdf):
        if (pdf["x"] == 3).any():
            raise ExtractionError("BAD_INPUT", "three is not allowed")
        return pd.DataFrame({"id": pdf["id"], "y": pdf["x"] * 10.0})

    def plain(pdf):
        return pd.DataFrame({"id": pdf["id"], "y": pdf["x"] * 1.0})

    register_extractor(Extractor("loud", shout, "y double"))
    register_extractor(Extractor("missing", shout, "y double", available=lambda: "no model"))
    register_extractor(Extractor("plain", plain, "y double"))
    df = spark.createDataFrame([(i, i) for i in range(5)], "id int, x int")
    out = {r["id"]: r for r in extract(df, "loud", ["id"]).collect()}
    assert len(out) == 5 and out[3]["status"] == "failed" and "BAD_INPUT" in out[3]["error"]
    assert all(out[i]["y"] == i * 10.0 for i in (0, 1, 2, 4))
    out = extract(df, "missing", ["id"], fallback="plain").collect()
    assert all(r["status"] == "ok" and r["y"] == r["id"] and "no model" in r["warnings"][0] for r in out)
    assert {r["status"] for r in extract(df, "missing", ["id"]).collect()} == {"unavailable"}


def test_extractor_is_called_once_per_bad_row(spark, tmp_path):
    def odd(pdf):
        (tmp_path / f"{len(pdf)}-{pdf['id'].iloc[0]}").touch()
        if (pdf["id"] % 3 > 0).any():
            raise ValueError(f"first of {len(pdf)}: {pdf['id'].iloc[0]}")
        return pd.DataFrame({"id": pdf["id"], "y": pdf["id"] * 0.5})

    register_extractor(Extractor("odd", odd, "y double"))
    df = spark.range(900).coalesce(1).selectExpr("cast(id as int) as id")
    out = {r["id"]: r for r in extract(df, "odd", ["id"]).collect()}
    assert len(out) == 900 and all(out[i]["y"] == i * 0.5 and out[i]["status"] == "ok" for i in range(0, 900, 3))
    assert all(out[i]["error"] == f"first of 1: {i}" and out[i]["y"] is None for i in range(900) if i % 3)
    # halving throughout would ask some 1,700 times
    assert len(list(tmp_path.iterdir())) < 1_000


def test_text_goldens(spark):
    import uuid

    df = spark.createDataFrame([("君(きみ)の声（こえ）が(笑)する", "トウキョーニイッタ シャッター", "きゃっとんーぁ！あ")], "r string, k string, m string")
    row = df.select(
        X.ruby_spoken(F.col("r")).alias("spoken"), X.ruby(F.col("r")).alias("notes"), X.romaji(F.col("k")).alias("roma"),
        X.hiragana(F.col("k")).alias("hira"), X.moras(F.col("m"), silence=True).alias("moras"),
        X.stable_id(F.lit("candidate:1")).alias("uid"),
    ).collect()[0]
    assert row["spoken"] == "きみのこえが(笑)する"
    assert [(n["base"], n["reading"]) for n in row["notes"]] == [("君", "きみ"), ("の声", "こえ")] or [
        (n["base"], n["reading"]) for n in row["notes"]
    ] == [("君", "きみ"), ("声", "こえ")]
    assert row["roma"] == "toukyooniitta shattaa"
    assert row["hira"].startswith("とうきょーにいった")
    assert [(m["kana"], m["kind"]) for m in row["moras"]] == [
        ("きゃ", "yoon"), ("っ", "sokuon"), ("と", "mora"), ("ん", "nasal"), ("ー", "long_vowel"), ("ぁ", "mora"), ("！", "silence"), ("あ", "mora"),
    ]
    assert row["uid"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "candidate:1"))


def wav_bytes(samples, rate=8_000, bits=16, channels=2):
    """A PCM WAV with a chunk before and after its data."""
    body = samples.astype(f"<i{bits // 8}").tobytes()
    block = channels * bits // 8
    head = b"fmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * block, block, bits)
    parts = head + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(body)) + body + b"tail" + struct.pack("<I", 0)
    return b"RIFF" + struct.pack("<I", 4 + len(parts)) + b"WAVE" + parts


def test_ranges_of_one_file_go_to_many_tasks(spark, tmp_path):
    rng = np.random.default_rng(3)
    long = rng.integers(-30_000, 30_000, (300_001, 2))
    (tmp_path / "a b").mkdir()
    files = {"long": long, "short": long[:10], "none": long[:0]}
    for name, samples in files.items():
        (tmp_path / "a b" / f"{name}.wav").write_bytes(wav_bytes(samples))
    (tmp_path / "a b" / "broken.wav").write_bytes(wav_bytes(long)[:5_000])
    (tmp_path / "a b" / "text.wav").write_bytes(b"no")
    chunks = readers.read_pcm(spark, str(tmp_path / "a b"), chunk=1_000, chunks_per_part=8)
    rows = chunks.withColumn("task", F.spark_partition_id()).collect()
    assert {r["track_id"] for r in rows if r["error"]} == {"broken", "text"}
    for name, samples in files.items():
        own = sorted((r for r in rows if r["track_id"] == name), key=lambda r: r["chunk_idx"])
        assert [r["start_sample"] for r in own] == list(range(0, max(1, len(samples)), 1_000))
        assert all(r["sample_count"] == len(samples) and (r["rate"], r["channels"]) == (8_000, 2) for r in own)
        got = np.concatenate([r["samples"] for r in own])
        want = (samples.astype(np.float32) / 32_768).mean(axis=1, dtype=np.float32)
        assert np.array_equal(got.astype(np.float32), want)
        _, _, whole = readers.parse_wav(wav_bytes(samples))
        assert np.array_equal(whole.mean(axis=1, dtype=np.float32), want)
    tasks = {}
    for r in rows:
        if r["track_id"] == "long":
            tasks.setdefault(r["task"], []).append(r["chunk_idx"])
    assert len(tasks) > 2 and max(map(len, tasks.values())) < 301  # no task reads the whole file
    same = readers._read_whole(spark, str(tmp_path / "a b"), 1_000).drop("samples", "error").exceptAll(chunks.drop("samples", "error"))
    assert same.count() == 0


def test_inventory_reads_headers_and_hashes(spark, tmp_path, monkeypatch):
    samples = np.arange(600).reshape(-1, 2)
    for track, role in (("t1", "reference"), ("t1", "vocals"), ("t2", "reference")):
        (tmp_path / track).mkdir(exist_ok=True)
        (tmp_path / track / f"{role}.wav").write_bytes(wav_bytes(samples if track == "t1" else samples[:5], channels=2))
    (tmp_path / "t2" / "drums.wav").write_bytes(b"RIFFxxxx")
    tracks = spark.createDataFrame([("t1", 8_000, 300, 2), ("t2", 8_000, 300, 2)], "track_id string, rate int, sample_count bigint, channels int")
    for near in (True, False):
        monkeypatch.setattr(readers, "reachable", lambda path, near=near: near)
        out = {(r["track_id"], r["role"]): r for r in readers.asset_inventory(spark, str(tmp_path), tracks).collect()}
        assert len(out) == 4 and out["t2", "drums"]["error"] and not out["t2", "drums"]["fits"]
        assert [out[k]["fits"] for k in (("t1", "reference"), ("t1", "vocals"), ("t2", "reference"))] == [True, True, False]
        for (track, role), r in out.items():
            content = (tmp_path / track / f"{role}.wav").read_bytes()
            assert r["sha256"] == hashlib.sha256(content).hexdigest() and r["bytes"] == len(content)
