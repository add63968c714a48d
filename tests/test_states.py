"""Stateful folds against a plain walk, with narrow slices."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.core.states import ABSORB, APPEND, REPLACE, TAKE_OVER, Pairs, fold_states
from chronoloom.core.timeline import Timeline
from chronoloom.operators.tails import suppress_tails, with_valley_curve


@pytest.mark.parametrize("seed,width", [(1, 30), (2, 12), (3, 400)])
def test_fold_states(spark, fan_in, seed, width):
    def rule(state, row):
        gap = row["pos"] - state["pos"]
        if gap < 6:
            return REPLACE if row["x"] > state["x"] else ABSORB
        if gap <= 25 and abs(row["x"] - state["x"]) < 0.3:
            return ABSORB if row["x"] <= state["x"] else TAKE_OVER
        return APPEND

    def decide(rows, i, j):
        pairs = zip(rows["pos"][i], rows["x"][i], rows["pos"][j], rows["x"][j])
        return np.array([rule({"pos": p, "x": x}, {"pos": q, "x": y}) for p, x, q, y in pairs])

    rng = random.Random(seed)
    rows = [(rng.randrange(2), rng.randrange(700), i, rng.randrange(10) / 10, [rng.choice("abcdef")]) for i in range(160)]
    df = spark.createDataFrame(rows, "k bigint, pos bigint, id bigint, x double, votes array<string>")
    tl = Timeline(["k"], "pos", ["id"], 50)
    out = fold_states(df, tl, 25, decide, ["x"], "id", "votes", width)
    got = {r["id"]: r["votes"] for r in out.collect()}
    want = {}
    for k in (0, 1):
        kept = []
        for _, p, i, x, v in sorted(r for r in rows if r[0] == k):
            row = {"pos": p, "x": x}
            what = rule(kept[-1][0], row) if kept else APPEND
            if what == ABSORB:
                kept[-1][2].update(v)
            elif what == APPEND:
                kept.append([row, i, set(v)])
            else:
                held = kept[-1][2] if what == TAKE_OVER else set()
                kept[-1] = [row, i, set(v) | held]
        want |= {i: sorted(v) for _, i, v in kept}
    assert got == want


def test_tail_suppression(spark):
    config = {"tail_strength_ratio": 0.62, "tail_band_similarity": 0.82, "tail_valley_reset_ratio": 0.42}
    rows = [
        ("t", 1, 1000, 0.9, 1.0, 0.9, 0.1, 0.1, ["a"]),
        ("t", 2, 1010, 0.5, 0.9, 0.1, 0.9, 0.1, ["b"]),   # too close and weaker
        ("t", 3, 1300, 0.8, 0.5, 0.9, 0.1, 0.1, ["c"]),   # weak similar tail
        ("t", 4, 1700, 0.8, 0.5, 0.1, 0.1, 0.9, ["d"]),   # other band
        ("t", 5, 2000, 0.8, 0.9, 0.1, 0.1, 0.9, ["e"]),   # stronger, similar: takes over
        ("t", 6, 9000, 0.8, 0.4, 0.1, 0.1, 0.9, ["f"]),   # far away
    ]
    ddl = "track_id string, id bigint, pos bigint, confidence double, peak_value double, low double, mid double, high double, votes array<string>"
    df = spark.createDataFrame(rows, ddl)
    frames = spark.range(0, 100).select(F.lit("t").alias("track_id"), F.col("id").alias("frame_idx"), F.lit(0.6).alias("fused"))
    tl = Timeline(["track_id"], "pos", ["id"], 1000)
    curve = with_valley_curve(df, frames, ["track_id"], "pos", 100, 10, "fused")
    out = suppress_tails(curve, tl, minimum=50, tail=800, config=config)
    got = {r["id"]: r["votes"] for r in out.collect()}
    # the frames between 3 and 4 stay high, so only the bands tell them apart
    assert got == {1: ["a", "b", "c"], 5: ["d", "e"], 6: ["f"]}


@pytest.mark.parametrize("spread", [16 * 1_000, 20_000 * 40])
def test_a_dense_slice_is_quick(spread):
    """20,000 rows of one slice, with 1,250 rows in a window and with one."""
    rng = np.random.default_rng(1)
    rows = {"pos": np.sort(rng.integers(0, spread, 20_000)), "x": rng.random(20_000)}

    def decide(rows, i, j):
        return np.where(rows["x"][j] <= rows["x"][i], ABSORB, np.where(rows["x"][j] > 0.9, TAKE_OVER, APPEND))

    began = time.perf_counter()
    after, what, need = Pairs(rows, "pos", 1_000, decide, None).paths(1_250)
    assert time.perf_counter() - began < 3  # well under one on an idle machine
    at = 0
    while at < 20_000:
        j = at + 1
        while j < 20_000 and rows["pos"][j] - rows["pos"][at] <= 1_000 and rows["x"][j] <= rows["x"][at]:
            j += 1
        assert need[at] and after[at] == j
        at = j
