"""Core plans against brute force, with slices far narrower than the data."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.core import folds
from chronoloom.core.chains import anchors, keep_distant, spaced
from chronoloom.core.timeline import Timeline, carried, islands, near, swept


def sample_rows(seed, n=400, span=900, keys=3):
    rng = random.Random(seed)
    return [
        (rng.randrange(keys), rng.randrange(-50, span), i, rng.randrange(12) / 8.0)
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def rows():
    return sample_rows(7)


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "k bigint, pos bigint, id bigint, score double")


def by_key(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups


TL = Timeline(["k"], "pos", ["id"], 37)


def test_carried_matches_plain_walk(frame, rows):
    out = carried(
        frame,
        TL,
        last={"seen": F.when(F.col("score") > 1.2, F.col("id"))},
        upcoming={"ahead": F.when(F.col("score") > 1.2, F.col("id"))},
        prev={"before": F.col("id")},
        nxt={"after": F.col("id")},
        run_sum={"total": F.col("id")},
        run_max={"top": F.col("score")},
    )
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for group in by_key(rows).values():
        seen, total, top = None, 0, float("-inf")
        for i, (_, _, rid, score) in enumerate(group):
            seen = rid if score > 1.2 else seen
            total += rid
            top = max(top, score)
            ahead = next((g[2] for g in group[i:] if g[3] > 1.2), None)
            r = got[rid]
            assert r["seen"] == seen and r["ahead"] == ahead
            assert r["total"] == total and r["top"] == top
            assert r["before"] == (group[i - 1][2] if i else None)
            assert r["after"] == (group[i + 1][2] if i + 1 < len(group) else None)


def test_near_matches_plain_scan(frame, rows):
    out = near(frame, TL, 20, 55, {"n": F.count("*"), "m": F.max("score")})
    got = {r["id"]: (r["n"], r["m"]) for r in out.collect()}
    for k, p, i, _ in rows:
        inside = [r for r in rows if r[0] == k and p - 20 <= r[1] <= p + 55]
        assert got[i] == (len(inside), max(r[3] for r in inside))


def test_islands(frame, rows):
    got = {r["id"]: r["island"] for r in islands(frame, TL, 9).collect()}
    for group in by_key(rows).values():
        start, prev = None, None
        for _, p, i, _ in group:
            if prev is None or p - prev >= 9:
                start = p
            prev = p
            assert got[i] == start


@pytest.mark.parametrize("seed,window,width", [(1, 25, 40), (2, 60, 31), (3, 5, 7), (4, 300, 64)])
def test_chains_cross_slices(spark, fan_in, seed, window, width):
    rows = sample_rows(seed)
    df = spark.createDataFrame(rows, "k bigint, pos bigint, id bigint, score double")
    expect_anchor, expect_keep, expect_spaced = {}, set(), set()
    for k, group in by_key(rows).items():
        anchor = None
        for _, p, _, _ in group:
            if anchor is None or p - anchor > window:
                anchor = p
                expect_keep.add((k, p))
            expect_anchor[(k, p)] = anchor
        kept = []
        for r in group:
            if not kept or r[1] - kept[-1][1] >= window:
                kept.append(r)
            elif r[3] > kept[-1][3]:
                kept[-1] = r
        expect_spaced |= {r[2] for r in kept}
    got = {(r["k"], r["pos"]): r["anchor"] for r in anchors(df, TL, window, width).collect()}
    assert got == expect_anchor
    kept = {(r["k"], r["pos"]) for r in keep_distant(df, TL, window, width).collect()}
    assert kept == expect_keep
    survivors = {r["id"] for r in spaced(df, TL, window, "score", width).collect()}
    assert survivors == expect_spaced


@pytest.mark.parametrize("radius", [0, 7, 40])
def test_swept_matches_plain_scan(frame, rows, radius):
    out = swept(frame, TL, radius, maxima={"m": F.col("score")}, count="n")
    got = {r["id"]: (r["n"], r["m"]) for r in out.collect()}
    for k, p, i, _ in rows:
        inside = [r for r in rows if r[0] == k and abs(r[1] - p) <= radius]
        assert got[i] == (len(inside), max(r[3] for r in inside))


@pytest.mark.parametrize("fan_in,slices", [(8, 5_000), (8, 8), (3, 40)])
def test_folds_of_any_depth(spark, monkeypatch, fan_in, slices):
    """Running sums over slices; no function ever gets more tables than the fan-in."""
    monkeypatch.setattr(folds, "FAN_IN", fan_in)
    asked = []
    grouped = folds.map_groups
    monkeypatch.setattr(folds, "map_groups", lambda *a: asked.append(1) or grouped(*a))
    rows = [(k, s * (1 + k) - 7, s) for k in (0, 1) for s in range(slices)] + [(None, 10**12, 5), (None, -(10**12), 4), (2, 3, 1)]
    tables = spark.createDataFrame(rows, f"k long, {folds.SLICE} long, x long")

    def compose(g):
        assert len(g["x"]) <= fan_in
        return {"x": [int(g["x"].sum())]}

    def follow(g, enter):
        assert len(g["x"]) <= fan_in
        before = np.cumsum(g["x"]) - g["x"] + (0 if enter is None else enter["sum"])
        return {folds.SLICE: g[folds.SLICE], "sum": before.astype(np.int64)}

    got = {(r["k"], r[folds.SLICE]): r["sum"] for r in folds.entry_states(tables, ["k"], compose, "x long", follow, "sum long").collect()}
    want, sums = {}, {}
    for k, s, x in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        want[k, s] = sums.get(k, 0)
        sums[k] = want[k, s] + x
    assert got == want
    assert (len(asked) > 1) == (slices > fan_in)
