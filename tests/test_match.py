import random

import pytest
from pyspark.sql import functions as F

from chronoloom.core import quantiles
from chronoloom.core.quantiles import exact_quantiles
from chronoloom.core.timeline import Timeline
from chronoloom.operators.joins import (
    asof_segment, blocks_of, interval_join, match_events, nearest_distance, suppress_near, unmatched,
)

TL = Timeline(["k"], "pos", ["id"], 41)


def greedy(truth, pred, tol):
    pairs = sorted(
        (abs(p - t), i, j)
        for i, t in truth for j, p in pred if abs(p - t) <= tol
    )
    ut, up, out = set(), set(), set()
    for d, i, j in pairs:
        if i not in ut and j not in up:
            ut.add(i)
            up.add(j)
            out.add((i, j, d))
    return out


def frames(spark, truth, pred):
    t = spark.createDataFrame([(1, p, i) for i, p in truth], "k bigint, pos bigint, idx bigint")
    p = spark.createDataFrame([(1, p, i) for i, p in pred], "k bigint, pos bigint, idx bigint")
    return t, p


@pytest.mark.parametrize("seed,tol,span,n", [(1, 10, 900, 120), (2, 5, 200, 90), (3, 25, 3000, 300)])
def test_match_equals_all_pairs_greedy(spark, seed, tol, span, n):
    rng = random.Random(seed)
    truth = [(i, rng.randrange(span)) for i in range(n)]
    pred = [(i, rng.randrange(span)) for i in range(n)]
    t, p = frames(spark, truth, pred)
    tl = Timeline(["k"], "pos")
    # slices and halo far too narrow on purpose: forces several rounds
    out = match_events(t, p, tl, tol, slices_per_window=4, halo_windows=2)
    got = {(r["truth_idx"], r["prediction_idx"], r["distance"]) for r in out.collect()}
    assert got == greedy(truth, pred, tol)


def test_match_regular_chain(spark):
    # evenly spaced rows: every decision depends on the one before
    truth = [(i, 20 * i) for i in range(60)]
    pred = [(i, 20 * i + 10) for i in range(60)]
    t, p = frames(spark, truth, pred)
    out = match_events(t, p, Timeline(["k"], "pos"), 10, slices_per_window=16, halo_windows=3)
    got = {(r["truth_idx"], r["prediction_idx"], r["distance"]) for r in out.collect()}
    assert got == greedy(truth, pred, 10)


def test_golden_matches(spark):
    tl = Timeline(["k"], "pos")
    t, p = frames(spark, [(0, 1000), (1, 1010)], [(0, 1005)])
    m = match_events(t, p, tl, 10)
    assert m.count() == 1
    assert unmatched(t, m, ["k"], "idx", "truth_idx").count() == 1
    assert unmatched(p, m, ["k"], "idx", "prediction_idx").count() == 0
    t, p = frames(spark, [(0, 100), (1, 200), (2, 300)], [(0, 98), (1, 206), (2, 600)])
    m = match_events(t, p, tl, 10)
    assert {(r["truth_idx"], r["prediction_idx"]) for r in m.collect()} == {(0, 0), (1, 1)}
    assert [r["idx"] for r in unmatched(t, m, ["k"], "idx", "truth_idx").collect()] == [2]
    assert [r["idx"] for r in unmatched(p, m, ["k"], "idx", "prediction_idx").collect()] == [2]


@pytest.fixture(scope="module")
def cloud(spark):
    rng = random.Random(11)
    rows = [(rng.randrange(2), rng.randrange(600), i) for i in range(200)]
    marks = [(rng.randrange(2), 40 + rng.randrange(500), i) for i in range(15)]
    return (
        rows, marks,
        spark.createDataFrame(rows, "k bigint, pos bigint, id bigint"),
        spark.createDataFrame(marks, "k bigint, pos bigint, id bigint"),
    )


def test_nearest_and_suppression(cloud):
    rows, marks, points, events = cloud
    dist = {
        i: min((abs(p - q) for kk, q, _ in marks if kk == k), default=None) for k, p, i in rows
    }
    got = {r["id"]: r["distance"] for r in nearest_distance(points, events, TL).collect()}
    assert got == dist
    left = {r["id"] for r in suppress_near(points, events, TL, 7).collect()}
    assert left == {i for i, d in dist.items() if d is None or d > 7}


def test_asof_and_interval(spark, cloud):
    rows, _, points, _ = cloud
    starts = [(0, 50, "a"), (0, 300, "b"), (1, 120, "c")]
    seg = spark.createDataFrame(starts, "k bigint, start bigint, name string")
    got = {r["id"]: r["name"] for r in asof_segment(points, seg, TL, "start", ["name"]).collect()}
    for k, p, i in rows:
        mine = [(s, n) for kk, s, n in starts if kk == k]
        before = [n for s, n in mine if s <= p]
        assert got[i] == (before[-1] if before else mine[0][1])
    spans = [(0, 10, 120, 3), (0, 100, 260, 1), (1, 0, 40, 0), (1, 90, 90, 2), (0, 500, 490, 0)]
    iv = spark.createDataFrame(spans, "k bigint, s bigint, e bigint, n bigint")
    got = {r["id"]: r["n"] for r in interval_join(points, iv, TL, "s", "e", "n").collect()}
    for k, p, i in rows:
        inside = [n for kk, s, e, n in spans if kk == k and s <= p < e]
        assert got[i] == (min(inside) if inside else None)


def test_long_intervals_lie_in_few_rows(spark):
    cases = [(0, 10_000), (3, 10_001), (-7, 9_999), (-5_000, 5_000), (5, 6), (4, 4), (1, 2**40 - 1), (-1, 0)]
    df = spark.createDataFrame(cases, "a long, b long")
    for r in df.select("a", "b", blocks_of(F.col("a"), F.col("b")).alias("blocks")).collect():
        parts = sorted((x["block"] << x["level"], (x["block"] + 1) << x["level"]) for x in r["blocks"])
        assert len(parts) <= 2 * max(1, (r["b"] - r["a"]).bit_length())
        assert [p[0] for p in parts[1:]] == [p[1] for p in parts[:-1]]  # side by side
        assert (parts[0][0], parts[-1][1]) == (r["a"], r["b"]) if parts else r["a"] == r["b"]
        assert r["b"] - r["a"] != 10_000 or len(parts) + 2 < 30


def test_long_intervals_against_brute_force(spark):
    rng = random.Random(9)
    points = [(rng.choice([1, 2, None]), rng.randrange(-3_000, 6_000), i) for i in range(700)]
    spans = []
    for n in range(60):
        s = rng.randrange(-4_000, 6_000)
        spans.append((rng.choice([1, 2, None]), s, s + rng.choice([0, 1, 41, 400, 41 * 60, 9_000]), rng.randrange(10**6) * 100 + n))
    spans += [(1, -41 * 4, 41 * 4, 5), (2, 41, 82, 1)]  # ends on slice borders
    p = spark.createDataFrame(points, "k int, pos long, id long")
    v = spark.createDataFrame(spans, "k int, s long, e long, n long")
    got = {r["id"]: r["n"] for r in interval_join(p, v, TL, "s", "e", "n").collect()}
    for k, at, i in points:
        if k is not None:
            assert got[i] == min((n for kk, s, e, n in spans if kk == k and s <= at < e), default=None)


def test_exact_quantiles(spark):
    import numpy as np

    rng = random.Random(5)
    rows = [(k, rng.choice([rng.random(), rng.random() * 50, -3.0])) for k in (1, 2) for _ in range(301)]
    df = spark.createDataFrame(rows, "k int, x double")
    out = exact_quantiles(df, ["k"], F.col("x"), {"a": 0.12, "b": 0.5, "c": 0.995})
    near = exact_quantiles(df, ["k"], F.col("x"), {"p": 0.95}, nearest_rank=True)
    ranked = {r["k"]: r["p"] for r in near.collect()}
    for r in out.collect():
        x = sorted(v for k, v in rows if k == r["k"])
        assert r["n"] == 301
        assert np.allclose([r["a"], r["b"], r["c"]], np.quantile(x, [0.12, 0.5, 0.995]))
        assert ranked[r["k"]] == x[int(np.ceil(301 * 0.95)) - 1]


def test_quantiles_of_any_scale(spark, monkeypatch):
    """Long keys are bracketed: of their values only a few are grouped, whatever the scale."""
    import numpy as np

    monkeypatch.setattr(quantiles, "ACCURACY", 100)
    rng = random.Random(6)
    curves = {
        "tiny": [rng.gauss(0, 1) * 1e-6 for _ in range(6_000)],
        "huge": [rng.expovariate(1) * 1e9 for _ in range(6_000)],
        "same": [0.25] * 5_000,
        "steps": [float(rng.randrange(3)) for _ in range(5_000)],
        "short": [rng.random() for _ in range(90)],
        None: [rng.random() for _ in range(3_000)],
    }
    rows = [(k, x, -x) for k, xs in curves.items() for x in xs] + [("short", None, None), ("none", None, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(5)
    probs = {"a": 0.0, "b": 0.12, "c": 0.5, "d": 0.995, "e": 1.0}
    out = quantiles.curve_quantiles(df, ["k"], {n: (F.col("x"), p) for n, p in probs.items()} | {"low": (F.col("y"), 0.1)})
    got = {r["k"]: r for r in out.collect()}
    near = {r["k"]: r["p"] for r in exact_quantiles(df, ["k"], F.col("x"), {"p": 0.95}, nearest_rank=True).collect()}
    assert got.keys() == curves.keys()
    for k, xs in curves.items():
        assert [got[k][n] for n in probs] == pytest.approx(np.quantile(xs, list(probs.values())).tolist(), rel=1e-12)
        assert got[k]["low"] == pytest.approx(np.quantile([-x for x in xs], 0.1), rel=1e-12) and got[k]["n"] == len(xs)
        assert near[k] == sorted(xs)[int(np.ceil(len(xs) * 0.95)) - 1]


def test_large_ids_survive(spark):
    big = 2**60
    rows = [(1, 10 * i, big + i) for i in range(20)]
    points = spark.createDataFrame(rows, "k bigint, pos bigint, id bigint")
    spans = spark.createDataFrame([(1, 0, 95, big + 7), (1, 40, 150, big + 3)], "k bigint, s bigint, e bigint, n bigint")
    out = {r["id"]: r["n"] for r in interval_join(points, spans, TL, "s", "e", "n").collect()}
    assert out == {
        i: big + 3 if 40 <= p < 150 else big + 7 if p < 95 else None for _, p, i in rows
    }
