import functools
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from chronoloom.core.timeline import Timeline
from chronoloom.operators import alignment as L


def test_token_alignment_prefers_the_diagonal(spark):
    ddl = "line int, idx bigint, token string"
    exp = spark.createDataFrame([(1, i, t) for i, t in enumerate("kAsan")] + [(2, 0, "x")], ddl)
    obs = spark.createDataFrame([(1, i, t) for i, t in enumerate("kazn")], ddl)
    edges = L.align_tokens(exp, obs, ["line"])
    got = [(r["expected_idx"], r["observed_idx"], r["operation"]) for r in edges.filter("line = 1").collect()]
    ops = sorted(o for _, _, o in got)
    assert ops == ["delete", "match", "match", "match", "substitute"]
    assert (0, 0, "match") in got and (4, 3, "match") in got
    cov = {r["line"]: r["coverage"] for r in L.unit_coverage(edges, ["line"]).collect()}
    assert cov == {1: 0.6, 2: 0.0}


def test_moras_from_edges(spark):
    edges = spark.createDataFrame(
        [(1, 0, 0, "match"), (1, 1, 1, "substitute"), (1, 2, None, "delete"), (1, None, 2, "insert")],
        "track_id int, expected_idx bigint, observed_idx bigint, operation string",
    )
    plan = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 1, 2)], "track_id int, mora_idx int, expected_idx bigint")
    phones = spark.createDataFrame(
        [(1, 0, 100, 180, 105, 178, 0.8), (1, 1, 180, 260, 182, 255, 0.6), (1, 2, 300, 310, 300, 310, 0.9)],
        "track_id int, observed_idx bigint, aligned_start int, aligned_end int, refined_start int, refined_end int, confidence double",
    )
    out = {r["mora_idx"]: r for r in L.decode_moras(edges, plan, phones, ["track_id"]).collect()}
    assert (out[0]["aligned_start"], out[0]["aligned_end"]) == (100, 260)
    assert out[0]["confidence"] == pytest.approx(0.7 * 1.0 * (1 - 0.25 / 2))
    assert out[1]["missing"] and out[1]["confidence"] is None


def test_lines_go_to_segments_in_order(spark):
    lines = ["silver rain is falling down", "over empty streets tonight", "hold me till the morning", "and never let me go"]
    heard = ["silver rain is faling over empty street tonight", "zzzz qqqq", "hold me til the morning never let go"]
    seg = spark.createDataFrame([(1, i, t) for i, t in enumerate(heard)], "track_id int, idx bigint, text string")
    lin = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "track_id int, idx bigint, text string")
    got = {r["segment_idx"]: (r["line_start"], r["line_end"]) for r in L.assign_lines(seg, lin, ["track_id"]).collect()}
    assert got == {0: (0, 2), 2: (2, 4)}


@pytest.mark.parametrize("heard,lines,want", [
    (["星明かりを探して歩く", "", "静かな海に響く声"],
     ["No Destiny", "星明かりを探して歩く", "instrumental", "静かな海に響く声", "ending"], {0: (1, 2), 2: (3, 4)}),
    (["雨を待つ次の朝", "雨を待つ最後の夜"], ["雨を待つ", "次の朝", "雨を待つ", "最後の夜"], {0: (0, 2), 1: (2, 4)}),
    (["ピアノだけの間奏", "ドラムソロ"], ["遠い空に声を重ねる", "明日を迎える"], {}),
    (["Ｍｉｒａｉ、 を 待つ！"], ["", "miraiを待つ", None], {0: (1, 2)}),
    ([None, ""], ["a"], {}),
])
def test_lines_of_sheets(spark, heard, lines, want):
    ddl = "track_id int, idx bigint, text string"
    seg = spark.createDataFrame([(1, i, t) for i, t in enumerate(heard)], ddl)
    lin = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], ddl)
    got = L.assign_lines(seg, lin, ["track_id"]).collect()
    assert {r["segment_idx"]: (r["line_start"], r["line_end"]) for r in got} == want
    assert all(r["confidence"] > 0.5 for r in got)


def best_runs(segments, lines):
    """Gain of the best way to give runs of lines to segments, by trying all."""
    grams = [Counter(t[i : i + 2] for i in range(max(1, len(t) - 1))) for t in lines]

    def gain(i, a, b):
        own, run = Counter(segments[i][j : j + 2] for j in range(max(1, len(segments[i]) - 1))), sum(grams[a:b], Counter())
        common, n, m = (own & run).total(), own.total(), run.total()
        ratio = 2 * common / (n + m)
        if ratio < 0.2 or not common:
            return None
        size = len("".join(lines[a:b]))
        length = abs(math.log((size + 1) / (len(segments[i]) + 1)))
        place = abs((a + b) / 2 / len(lines) - (i + 0.5) / len(segments))
        return 2.45 * ratio + 0.55 * common / min(n, m) - 0.38 * length - 0.34 * place - 0.2 - 0.018 * (b - a - 1)

    @functools.cache
    def best(i, a):
        if i == len(segments):
            return (-0.065 * (len(lines) - a), ())
        ways = [best(i + 1, a)]
        for start in range(a, len(lines)):
            for stop in range(start + 1, len(lines) + 1):
                g = gain(i, start, stop)
                if g is not None:
                    rest, picks = best(i + 1, stop)
                    ways.append((g - 0.065 * (start - a) + rest, ((i, start, stop), *picks)))
        return max(ways, key=lambda w: w[0])

    return list(best(0, 0)[1])


def test_lines_against_all_ways(spark):
    rng = random.Random(5)
    seg, lin, want = [], [], {}
    for song in range(6):
        lines = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 7))) for _ in range(6)]
        heard = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12))) for _ in range(4)]
        want[song] = best_runs(tuple(heard), lines)
        seg += [(song, i, t) for i, t in enumerate(heard)]
        lin += [(song, i, t) for i, t in enumerate(lines)]
    ddl = "track_id int, idx bigint, text string"
    got = {song: [] for song in want}
    for r in L.assign_lines(spark.createDataFrame(seg, ddl), spark.createDataFrame(lin, ddl), ["track_id"]).collect():
        got[r["track_id"]].append((r["segment_idx"], r["line_start"], r["line_end"]))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_short_songs_are_solved_whole(spark, monkeypatch):
    rng = random.Random(6)
    seg, lin = [(2, None, "ab"), (2, 2**60 + 1, "cd"), (None, 0, "ab"), (3, 0, None)], [(2, None, "ab"), (2, 2**60 + 1, "cd"), (None, 0, "ab"), (3, 0, "x")]
    for song in range(4, 12):
        seg += [(song, 3 * i, "".join(rng.choice("aé漢𝄞 𠀀") for _ in range(rng.randrange(12)))) for i in range(5)]
        lin += [(song, 3 * i, "".join(rng.choice("aé漢𝄞 𠀀") for _ in range(rng.randrange(7)))) for i in range(7)]
    ddl = "track_id int, idx bigint, text string"
    heard, sung = spark.createDataFrame(seg, ddl), spark.createDataFrame(lin, ddl)

    def rows(most=None, floor=0.2):
        found = L.assign_lines(heard, sung, ["track_id"], most, floor).collect()
        return sorted(((*r[:4], round(r[4], 9), round(r[5], 9)) for r in found), key=repr)

    settings = [(None, 0.2), (1, 0.2), (None, 0.0)]
    monkeypatch.setattr(L, "SONG_CELLS", 0)
    apart = [rows(*s) for s in settings]
    monkeypatch.setattr(L, "SONG_CELLS", 1 << 20)
    monkeypatch.setattr(L, "line_runs", None)  # pairs of a short song are no rows
    assert [rows(*s) for s in settings] == apart
    assert [r[:4] for r in apart[0] if r[0] in (None, 2, 3)] == [(2, 2**60 + 1, 2**60 + 1, 2**60 + 2), (2, None, None, None)]


def test_long_songs_go_by_run(spark, monkeypatch):
    ddl = "track_id int, idx bigint, text string"
    rows = spark.createDataFrame([(s, i, "abcd"[i : i + 2] * s) for s in (1, 9) for i in range(3)], ddl)
    called = []
    runs = L.line_runs
    monkeypatch.setattr(L, "line_runs", lambda heard, *a: called.append(heard.select("track_id").distinct().collect()) or runs(heard, *a))
    monkeypatch.setattr(L, "SONG_CHARS", 40)
    got = {(r["track_id"], r["segment_idx"]): (r["line_start"], r["line_end"]) for r in L.assign_lines(rows, rows, ["track_id"]).collect()}
    assert got == {(s, i): (i, i + 1) for s in (1, 9) for i in range(3)}
    assert called == [[(9,)]]


def cost_of(expected, observed, path):
    return sum({"match": 0, "substitute": 10, "insert": 10, "delete": 11}[how] for _, _, how in path)


def test_edit_paths_are_the_cheapest():
    rng = random.Random(9)
    for _ in range(60):
        a, b = ([rng.choice("xyz") for _ in range(rng.randrange(8))] for _ in range(2))
        table = [[11 * i + 10 * j for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            table[i][j] = min(table[i - 1][j - 1] + 10 * (a[i - 1] != b[j - 1]), table[i][j - 1] + 10, table[i - 1][j] + 11)
        path = L._align(a, b)
        assert cost_of(a, b, path) == table[-1][-1]
        assert [i for i, _, _ in path if i is not None] == list(range(len(a)))
        assert [j for _, j, _ in path if j is not None] == list(range(len(b)))


def cheapest(refined, aligned, conf, step, cells):
    best = None
    for pick in itertools.product(*[[None, *c] for c in cells]):
        used = [c for c in pick if c is not None]
        if used != sorted(set(used)):
            continue
        cost, last = 0.0, None
        for i, c in enumerate(pick):
            if c is None:
                cost += 1.05 * (0.2 + 0.8 * conf[i])
                continue
            cost += (0.35 + 0.65 * conf[i]) * (
                0.72 * (abs(refined[i] - c * step) / step) ** 2 + 0.18 * (abs(aligned[i] - c * step) / step) ** 2
            )
            if last is not None:
                gap = (refined[i] - refined[last]) / step
                cost += 0.22 * abs(c - pick[last] - gap) / max(1.0, gap)
            last = i
        if best is None or cost < best[0] - 1e-12:
            best = (cost, pick)
    return best[1]


def test_phrase_cells_are_the_cheapest(spark):
    rng = random.Random(3)
    rate, step = 8000, 1000  # bpm 120, sixteenths
    rows, want = [], {}
    for phrase in range(4):
        refined = sorted(rng.randrange(500, 9000) for _ in range(6))
        aligned = [r - rng.randrange(300) for r in refined]
        conf = [rng.random() for _ in refined]
        cells = []
        for r, a in zip(refined, aligned):
            near = set()
            for p in (r, a):
                c = int(p / step + 0.5)
                near |= set(range(c - 2, c + 3))
            cells.append(sorted(c for c in near if c >= 0 and abs(r - c * step) <= 0.6 * step))
        for i, c in enumerate(cheapest(refined, aligned, conf, step, cells)):
            want[phrase * 10 + i] = None if c is None else c * step
            rows.append((1, phrase, phrase * 10 + i, refined[i], aligned[i], conf[i], "phrase", 120.0, 0))
    df = spark.createDataFrame(
        rows, "track_id int, phrase_id int, id bigint, refined bigint, aligned bigint, confidence double, kind string, bpm double, beat_offset bigint"
    )
    out = L.assign_cells(df, Timeline(["track_id"], "refined", ["id"], 1000), rate)
    assert {r["id"]: r["grid_sample"] for r in out.collect()} == want


WORKED_PHRASES = [
    ([(5900, 5750, 0.9, "mora"), (12100, 12250, 0.9, "mora"), (18050, 17900, 0.9, "mora")], [6000, 12000, 18000]),
    ([(6000, 6000, 0.98, "mora"), (6120, 6120, 0.12, "mora"), (12000, 12000, 0.95, "mora")], [6000, None, 12000]),
    ([(6000, 6000, 0.98, "mora"), (8200, 8200, 0.98, "mora")], [6000, None]),
    ([(6000, 6000, 0.9, "mora"), (8000, 8000, 0.9, "nasal"), (10000, 10000, 0.9, "sokuon"), (12000, 12000, 0.9, "mora")],
     [6000, None, None, 12000]),
    ([(6000, 6000, 0.9, "mora"), (8000, 8000, 0.9, "sustain"), (9000, 9000, 0.9, "silence"), (12000, 12000, 0.9, "mora")],
     [6000, None, None, 12000]),
]


def phrases(spark, rows):
    ddl = "track_id int, phrase_id int, id bigint, refined bigint, aligned bigint, confidence double, kind string, bpm double, beat_offset bigint"
    return spark.createDataFrame(rows, ddl)


def test_worked_phrases(spark):
    rows = [
        (1, p, p * 10 + i, *anchor, 120.0, 0) for p, (anchors, _) in enumerate(WORKED_PHRASES) for i, anchor in enumerate(anchors)
    ]
    out = L.assign_cells(phrases(spark, rows), Timeline(["track_id"], "refined", ["id"], 10_000), 48_000)
    got = {r["id"]: r["grid_sample"] for r in out.collect()}
    assert got == {p * 10 + i: c for p, (_, cells) in enumerate(WORKED_PHRASES) for i, c in enumerate(cells)}


def test_long_phrase_is_exact():
    # 10,000 anchors against a plain table over (anchor, cell) that tries every earlier node
    rng = np.random.default_rng(4)
    weights = {"refined": 0.72, "aligned": 0.18, "transition": 0.22}
    for n, check in ((10_000, False), (150, True)):
        at = np.sort(rng.uniform(0, n * 0.8, n))
        home, trust, silent = at - rng.uniform(0, 0.4, n), rng.random(n), np.cumsum(rng.random(n) < 0.05)
        drop = 1.05 * (0.2 + 0.8 * trust)
        cells = [[c for c in range(round(x) - 2, round(x) + 3) if abs(x - c) <= 0.6] for x in at]
        out, placed = L._cheapest_cells(at, home, trust, drop, silent, cells, weights)
        used = out[placed]
        assert (np.diff(used) > 0).all()

        def total(picks):
            cost, last = drop.sum(), None
            for i, c in picks:
                cost += (0.35 + 0.65 * trust[i]) * (0.72 * (at[i] - c) ** 2 + 0.18 * (home[i] - c) ** 2) - drop[i]
                if last and silent[i] == silent[last[0]]:
                    gap = at[i] - at[last[0]]
                    cost += 0.22 * abs(c - last[1] - gap) / max(1.0, gap)
                last = (i, c)
            return cost

        if check:
            nodes = [(i, c) for i in range(n) for c in cells[i]]
            best = {}
            for node in nodes:
                start = total([node])
                for before in best:
                    if before[0] < node[0] and before[1] < node[1]:
                        start = min(start, best[before] + total([before, node]) - total([before]))
                best[node] = start
            assert total(list(zip(np.flatnonzero(placed), used))) == pytest.approx(min(best.values()))


@pytest.mark.parametrize("seed,width", [(1, 40), (2, 900)])
def test_unused_events_in_order(spark, seed, width):
    rng = random.Random(seed)
    spans, events = [], []
    for k in (1, 2):
        spans += [(k, 100 * k + i, s, s + 30, float(s + rng.randrange(8))) for i, s in enumerate(sorted(rng.sample(range(0, 900), 60)))]
        events += [(k, 1000 * k + i, rng.randrange(0, 930), rng.random()) for i in range(70)]
    want = {}
    for k in (1, 2):
        free = {e[1]: e for e in events if e[0] == k}
        for _, sid, s, end, act in sorted((x for x in spans if x[0] == k), key=lambda x: (x[2], x[1])):
            near = [e for e in free.values() if s - 8 <= e[2] < min(s + 22, end + 2)]
            pick = min(near, key=lambda e: (abs(e[2] - act), -e[3], e[1]), default=None)
            want[sid] = None if pick is None else pick[1]
            if pick:
                del free[pick[1]]
    s = spark.createDataFrame(spans, "k int, span_id bigint, start bigint, end bigint, active_start double")
    e = spark.createDataFrame(events, "k int, event_id bigint, at bigint, confidence double")
    out = L.match_unused(s, e, ["k"], 8, 22, 2, width)
    assert {r["span_id"]: r["event_id"] for r in out.collect()} == want


def test_replacement_golden(spark):
    hits = spark.createDataFrame(
        [("t", "covered", 800, 800, "vocals", False, False), ("t", "failed", 3000, 3000, "vocals", False, False),
         ("t", "empty", 5000, 5000, "vocals", False, False), ("t", "manual", 1500, 1500, "vocals", True, False)],
        "track_id string, id string, pos bigint, snapped bigint, primary_stem string, edited boolean, locked boolean",
    )
    chunks = spark.createDataFrame(
        [("t", 0, 0, 2000, "success", 2), ("t", 1, 2000, 4000, "alignment_failed", 0), ("t", 2, 4000, 6000, "insufficient_anchors", 1)],
        "track_id string, idx bigint, start bigint, end bigint, status string, anchor_count bigint",
    )
    anchors = spark.createDataFrame(
        [("t", "a", 0, 900, 1000, True, True), ("t", "b", 0, 1700, 2000, True, True), ("t", "c", 1, 2900, 3000, True, True)],
        "track_id string, id string, chunk_idx bigint, pos bigint, grid_sample bigint, active boolean, chart_candidate boolean",
    )
    tl = Timeline(["track_id"], "pos", ["id"], 1000)
    lengths = spark.createDataFrame([("t", 8000)], "track_id string, sample_count bigint")
    result, counters = L.replace_in_intervals(hits, anchors, chunks, lengths, tl, 80, 1000)
    assert {r["id"] for r in result.collect()} == {"a", "b", "failed", "empty", "manual"}
    c = counters.collect()[0]
    assert (c["created"], c["removed"], c["chunks"], c["preserved"]) == (2, 1, 1, 2)
