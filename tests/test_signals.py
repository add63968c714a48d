import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.core.timeline import Timeline
from chronoloom.operators import signals as S
from chronoloom.sources import readers


def wav(path, rate, frames):
    frames = np.asarray(frames)
    channels = 1 if frames.ndim == 1 else frames.shape[1]
    body = (np.clip(frames, -1, 1) * 32767).astype("<i2").tobytes()
    head = b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack(
        "<IHHIIHH", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16
    ) + b"data" + struct.pack("<I", len(body))
    path.write_bytes(head + body)


@pytest.fixture(scope="module")
def clicks():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.004, 44_100)
    for at in (6000, 15_000, 16_500, 30_000):
        x[at : at + 900] += 0.2 * rng.normal(0, 1, 900) * np.exp(-np.arange(900) / 180)
    return x


def test_pcm_source(spark, tmp_path, clicks):
    wav(tmp_path / "one.wav", 44_100, np.stack([clicks, clicks * 0.5], axis=1))
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxxWAVEjunk")
    chunks = readers.read_pcm(spark, str(tmp_path), chunk=10_000)
    good = chunks.filter("error is null").orderBy("chunk_idx").collect()
    assert [r["start_sample"] for r in good] == [0, 10_000, 20_000, 30_000, 40_000]
    assert good[0]["channels"] == 2 and good[0]["sample_count"] == 44_100
    joined = np.concatenate([r["samples"] for r in good])
    assert np.abs(joined - clicks * 0.75).max() < 1e-4
    bad = chunks.filter("error is not null").collect()
    assert len(bad) == 1 and bad[0]["track_id"] == "bad"
    values = readers.samples_of(chunks.filter("error is null"))
    assert values.count() == 44_100


def test_asset_inventory(spark, tmp_path, clicks):
    folder = tmp_path / "t1"
    folder.mkdir()
    wav(folder / "reference.wav", 44_100, clicks)
    wav(folder / "drums.wav", 44_100, np.stack([clicks, clicks], axis=1))
    wav(folder / "bass.wav", 44_100, clicks[:-5])
    tracks = spark.createDataFrame([("t1", 44_100, 44_100, 1)], "track_id string, rate int, sample_count bigint, channels int")
    rows = {r["role"]: r for r in readers.asset_inventory(spark, str(tmp_path), tracks).collect()}
    assert rows["reference"]["fits"] and rows["drums"]["fits"] and not rows["bass"]["fits"]
    assert len(rows["reference"]["sha256"]) == 64


def test_chunks_of_line_items_are_filled_in_one_pass(spark, tmp_path):
    from chronoloom.plans.signals import pcm_chunks

    rows = [("a", 1, 1, 20_000.0), ("a", 1, 2, 40_000.0), ("a", 1, 4, None), ("a", 5, 0, 90_000.0), ("a", 16, 3, 70_000.0), ("b", 2, 3, 10_000.0)]
    items = spark.createDataFrame(rows, "l_returnflag string, l_orderkey long, l_linenumber long, l_extendedprice double")
    items.write.parquet(str(tmp_path / "lineitem.parquet"))
    out = pcm_chunks(spark, str(tmp_path), 8)
    got = {(r["track_id"], r["chunk_idx"]): r for r in out.collect()}
    assert set(got) == {("a", 0), ("a", 1), ("a", 4), ("b", 0)}
    assert [r["start_sample"] for r in got.values()] == [8 * c for _, c in got]
    assert {t: r["sample_count"] for (t, _), r in got.items()} == {"a": 33, "b": 5}
    assert got["a", 0]["samples"] == pytest.approx([0, 0, -0.2, 0, 0, 0, 0, 0])
    assert got["a", 1]["samples"] == pytest.approx([0, 0, 0.4, 0, 0, 0, 0, 0])
    assert got["a", 4]["samples"] == pytest.approx([0.2]) and got["b", 0]["samples"] == pytest.approx([0, 0, 0, 0, -0.4])
    # no lookup per sample: that is a search of the whole chunk each time
    assert "element_at" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_percussive_part_of_a_stretch(clicks):
    whole = S._percussive(clicks, 0, len(clicks))
    for low, high in ((0, 900), (9_000, 20_000), (43_000, 44_100)):
        assert np.array_equal(S._percussive(clicks, low, high)[low:high], whole[low:high])


def test_features_do_not_depend_on_chunking(spark, clicks):
    def chunks(size):
        rows = [
            ("t", len(clicks), i, i * size, [float(v) for v in clicks[i * size : (i + 1) * size]])
            for i in range(-(-len(clicks) // size))
        ]
        return spark.createDataFrame(rows, "track_id string, sample_count bigint, chunk_idx bigint, start_sample bigint, samples array<double>")

    whole = S.frame_features(chunks(256 * 200), ["track_id"], 44_100, 256 * 200).orderBy("frame_idx").toPandas()
    split = S.frame_features(chunks(256 * 40), ["track_id"], 44_100, 256 * 40).orderBy("frame_idx").toPandas()
    assert whole["frame_idx"].tolist() == split["frame_idx"].tolist() == list(range(len(whole)))
    for name in S.FEATURES:
        assert np.allclose(whole[name], split[name], atol=1e-7), name
    # every click is a clear rise of the energy and of the percussive part
    for name in ("energy_derivative", "high"):
        curve = whole[name].to_numpy()
        for at in (6000, 15_000, 30_000):
            frame = at // S.HOP
            assert curve[frame - 4 : frame + 5].max() > 3 * np.median(curve[1:])


def test_level_and_attack(spark, clicks):
    x = clicks + 0.1
    samples = spark.createDataFrame([("t", i, float(v)) for i, v in enumerate(x)], "track_id string, pos bigint, value double")
    chunks = spark.createDataFrame([("t", [float(v) for v in x])], "track_id string, samples array<double>")
    level = S.normalise_level(chunks, samples, ["track_id"]).collect()[0]
    centred = x - np.median(x)
    gain = min(32.0, 0.92 / np.quantile(np.abs(centred), 0.995))
    assert level["dc"] == pytest.approx(np.median(x)) and level["gain"] == pytest.approx(gain)
    assert np.allclose(level["samples"], np.clip(centred * gain, -1, 1))
    tl = Timeline(["track_id"], "pos", (), 8000)
    rows = samples.withColumns({"value": F.col("value") - 0.1, "percussive": F.col("value") - 0.1})
    curve = S.novelty_curve(rows, tl, 15)
    peaks = spark.createDataFrame([("t", 1, 6100), ("t", 2, 29_950)], "track_id string, id int, detected bigint")
    out = {r["id"]: r["refined"] for r in S.refine_attack(peaks, curve, ["track_id"], 44_100).collect()}
    assert abs(out[1] - 6000) <= 60 and abs(out[2] - 30_000) <= 60


def test_melody_events(spark):
    midi = [None, 60, 60, 60, 64, 64, 64, None, 64, 64]
    rows = [("t", i, None if m is None else float(m), m is not None, 0.8, 0.1) for i, m in enumerate(midi)]
    rows += [("t", len(midi), None, False, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "track_id string, frame_idx bigint, midi double, voiced boolean, probability double, rms double")
    out = S.melody_events(df, Timeline(["track_id"], "frame_idx", (), 4), 2)
    assert [(r["frame_idx"], r["kind"]) for r in out.orderBy("frame_idx").collect()] == [
        (1, "pitch_onset"), (4, "pitch_onset"), (8, "pitch_onset"),
    ]
