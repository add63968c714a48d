"""Nothing is dropped or changed: large positions, null keys, empty projects, odd kana, late lines."""

import pytest
from pyspark.sql import functions as F

from chronoloom.core.chains import spaced
from chronoloom.core.durable import own_folder
from chronoloom.core.timeline import Timeline, carried
from chronoloom.functions.text import moras
from chronoloom.operators.metrics import duplicate_count
from chronoloom.operators.pyramid import build_lods, select_lod
from chronoloom.sources.sinks import project_documents

LINE = Timeline(["track_id"], "pos", ["id"], 1_000)


def events(spark, base, key):
    rows = [(key, base + 7 * i + i % 3, i, float(i * 37 % 101)) for i in range(200)]
    return spark.createDataFrame(rows, "track_id long, pos long, id long, score double")


@pytest.mark.parametrize("base", [0, 1_700_000_000_000_000_000])
def test_positions_beyond_doubles(spark, base):
    kept = spaced(events(spark, base, 1), LINE, 50, "score")
    small = spaced(events(spark, 0, 1), LINE, 50, "score")
    # slices may cut the timeline elsewhere, the walk is the same
    assert sorted(r["pos"] - base for r in kept.collect()) == sorted(r["pos"] for r in small.collect())
    count = [r[-1] for r in duplicate_count(events(spark, base, 1), LINE, 8).collect()]
    assert count == [r[-1] for r in duplicate_count(events(spark, 0, 1), LINE, 8).collect()]


def test_null_keys_stay(spark):
    both = events(spark, 0, 1).unionByName(events(spark, 0, None))
    kept = spaced(both, LINE, 50, "score").groupBy("track_id").count().collect()
    assert len({r["count"] for r in kept}) == 1 and {r["track_id"] for r in kept} == {1, None}


def test_null_keys_get_what_enters_a_slice(spark):
    rows = events(spark, 0, 1).unionByName(events(spark, 0, None))
    line = Timeline(["track_id"], "pos", ["id"], 3)
    x = F.col("score")
    out = carried(rows, line, last={"l": F.when(F.col("id") % 7 == 0, x)}, prev={"p": x}, nxt={"n": x}, run_sum={"s": x}, run_max={"m": x})
    got = {}
    for r in out.collect():
        got.setdefault(r["track_id"], {})[r["id"]] = (r["l"], r["p"], r["n"], round(r["s"], 6), r["m"])
    assert got[None] == got[1] and sum(v[0] is not None for v in got[1].values()) > len(got[1]) // 2


def test_project_without_rows_is_written(spark):
    tracks = spark.createDataFrame([(1, "a"), (2, "b")], "track_id long, title string")
    hits = spark.createDataFrame([(1, 5, 5, 9)], "track_id long, acoustic long, chart long, id long")
    tempo = spark.createDataFrame([], "track_id long, start_pos long, bpm double, beat_offset long")
    rows = {r["track_id"]: r for r in project_documents(tracks, tempo, hits, hits.limit(0), 100, ["id"], ["id"]).collect()}
    assert len(rows[1]["hitPoints"]) == 1
    assert rows[2]["part"] == 0 and rows[2]["hitPoints"] == rows[2]["candidateEvents"] == rows[2]["tempoMap"] == []


def test_kana_are_composed_first(spark):
    rows = spark.createDataFrame([("が",), ("ｱｶﾞ",), ("カ" + "ァ" * 120 + "ャ",)], "kana string")
    got = [[tuple(m) for m in r[0]] for r in rows.select(moras(F.col("kana"))).collect()]
    assert got[0] == [("が", "mora")]
    assert [m[0] for m in got[1]] == ["ア", "ガ"]
    assert got[2][0][1] == "yoon"


def test_missing_level_is_an_error(spark):
    lods = build_lods(events(spark, 0, 1), ["track_id"], "pos", "score", base_window=4)
    assert select_lod(lods, ["track_id"], 10, level=0).count() > 0
    with pytest.raises(Exception, match="no level 7"):
        select_lod(lods, ["track_id"], 10, level=7).collect()


def test_levels_are_made_and_chosen_by_blocks(spark):
    spots = [*range(0, 3_000, 7), 70_000, 70_001, 1_000_000, -9, None]
    rows = [(t, p, float(p % 13) if p and p % 5 else None) for t in (1, 2, None) for p in spots if t != 2 or p != 1_000_000]
    samples = spark.createDataFrame([*rows, (3, 5, 1.0)], "track_id long, pos long, value double")
    lods = build_lods(samples, ["track_id"], "pos", "value", base_window=4, block="block")
    want = {}
    for t, p, v in [*rows, (3, 5, 1.0)]:
        top = max(q // 4 for u, q, _ in [*rows, (3, 5, 1.0)] if u == t and q is not None) + 1
        for level in range(8):
            if level == 0 or -(-top // 4 ** (level - 1)) > 32:
                base = None if p is None else p // 4
                bin_ = None if base is None else int(base / 4**level)
                want.setdefault((t, level, 4 * 4**level, bin_), []).append(v)
    ends = {k: [f([x for x in v if x is not None], default=None) for f in (min, max)] for k, v in want.items()}
    got = {(r["track_id"], r["level"], r["window"], r["bin"]): [r["min"], r["max"]] for r in lods.collect()}
    assert lods.count() == len(got) and got == ends
    names = ["track_id", "level", "window", "bin", "min", "max"]
    for most in (2, 40, 200, 10_000):
        plain = select_lod(lods.drop("block"), ["track_id"], most)
        chosen = select_lod(lods, ["track_id"], most, block="block")
        assert chosen.columns == names and sorted(map(str, chosen.collect())) == sorted(map(str, plain.select(names).collect()))
    # choosing a level deals out the bins by their blocks only: no bins are shuffled by key or level
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(block" in plan and not [x for x in plan.splitlines() if "hashpartitioning(block" in x and "level" in x]


def test_cuts_need_a_shared_folder():
    assert own_folder("local[8]")
    for master in ("spark://host:7077", "local-cluster[3,2,1000]", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            own_folder(master)
