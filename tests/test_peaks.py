import random

import pytest

from chronoloom.core.timeline import Timeline
from chronoloom.operators.peaks import find_peaks, keep_spaced_peaks


def brute(x, height, distance, prominence):
    n, peaks, i = len(x), [], 1
    while i < n - 1:
        if x[i - 1] < x[i]:
            j = i
            while j + 1 < n and x[j + 1] == x[i]:
                j += 1
            if j + 1 < n and x[j + 1] < x[i]:
                peaks.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    peaks = [p for p in peaks if x[p] >= height]
    keep = set(peaks)
    for p in sorted(peaks, key=lambda p: (-x[p], -p)):
        if p in keep:
            keep -= {q for q in keep if q != p and abs(q - p) < distance}
    out = {}
    for p in sorted(keep):
        sides = []
        for step in (-1, 1):
            q, low = p, x[p]
            while 0 <= q < n and x[q] <= x[p]:
                low = min(low, x[q])
                q += step
            sides.append(low)
        out[p] = x[p] - max(sides)
    return {p: v for p, v in out.items() if v >= prominence}


@pytest.mark.parametrize("seed,distance", [(1, 3), (2, 9), (3, 1)])
def test_peaks_match_brute_force(spark, fan_in, seed, distance):
    rng = random.Random(seed)
    curves = {}
    for k in (1, 2):
        level, x = 0.0, []
        for _ in range(700):
            level += rng.choice([-1, -1, 0, 1, 1]) * rng.random()
            x.append(round(level, 1))
        curves[k] = x
    rows = [(k, i, v) for k, x in curves.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k int, f bigint, x double")
    tl = Timeline(["k"], "f", (), 16)
    out = find_peaks(df, tl, "x", height=-2.0, distance=distance, prominence=0.4).collect()
    for k, x in curves.items():
        got = {r["f"]: r["prominence"] for r in out if r["k"] == k}
        want = brute(x, -2.0, distance, 0.4)
        assert got.keys() == want.keys()
        assert all(abs(got[p] - want[p]) < 1e-9 for p in want)


def spaced_brute(rows, distance):
    keep = []
    for x, p in sorted(rows, key=lambda r: (-r[0], -r[1])):
        if all(abs(p - q) >= distance for q in keep):
            keep.append(p)
    return sorted(keep)


SHAPES = {
    "rising": lambda i, rng: (float(i), 1),
    "falling": lambda i, rng: (float(-i), 3),
    "level": lambda i, rng: (1.0, 2),
    "waves": lambda i, rng: (float(i % 40 if i // 40 % 2 else 40 - i % 40), 2),
    "random": lambda i, rng: (rng.randrange(6) / 2, rng.choice([1, 2, 5, 9, 400])),
    "sparse": lambda i, rng: (rng.random(), rng.choice([3, 70_000])),
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("distance", [5, 7])
def test_spacing_of_long_chains(spark, fan_in, shape, distance):
    rng = random.Random(3)
    curves = {}
    for k in (1, None):
        at, rows = -90, []
        for i in range(900):
            x, step = SHAPES[shape](i, rng)
            at += step
            rows.append((x, at))
        curves[k] = rows
    df = spark.createDataFrame([(k, p, x) for k, rows in curves.items() for x, p in rows], "k int, f bigint, x double")
    out = keep_spaced_peaks(df, Timeline(["k"], "f", (), 16), "x", distance).collect()
    for k, rows in curves.items():
        assert sorted(r["f"] for r in out if r["k"] == k) == spaced_brute(rows, distance)


def test_spacing_runs_as_many_jobs_for_any_length(spark):
    def jobs(n):
        df = spark.range(n).selectExpr("1 AS k", "id * 2 AS f", "double(id) AS x")
        spark.sparkContext.setJobGroup(f"peaks-{n}", "")
        count = keep_spaced_peaks(df, Timeline(["k"], "f", (), 16), "x", 7).count()
        spark.sparkContext.setJobGroup("other", "")
        return count, len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"peaks-{n}"))

    (few, some), (many, same) = jobs(640), jobs(64_000)
    assert (few, many) == (160, 16_000) and some == same
