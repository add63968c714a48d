"""Lattice functions over events with their tempo segment."""

from pyspark.sql import functions as F

from ..functions import lattice as L
from ..operators.joins import asof_segment
from .registry import query
from .views import POINTS, RATE, TEMPO, TRACKS, points, table, tempo


def placed(spark, sf_dir):
    """Events with the tempo segment in force."""
    return asof_segment(
        points(spark, sf_dir), tempo(spark, sf_dir), TRACKS, "start_pos", ["bpm", "beat_offset"]
    )


PLACED = f"""{POINTS}, {TEMPO},
placed AS (
  SELECT p.*, coalesce(t.bpm_milli, f.bpm_milli) AS bpm_milli, coalesce(t.bpm, f.bpm) AS bpm,
         coalesce(t.start_pos, f.start_pos) AS start_pos,
         coalesce(t.beat_offset, f.beat_offset) AS beat_offset
  FROM points p
  ASOF LEFT JOIN tempo t ON p.track_id = t.track_id AND p.pos >= t.start_pos
  LEFT JOIN (SELECT track_id, min(start_pos) AS start_pos, min_by(bpm_milli, start_pos) AS bpm_milli,
                    min_by(bpm, start_pos) AS bpm, min_by(beat_offset, start_pos) AS beat_offset
             FROM tempo GROUP BY track_id) f ON p.track_id = f.track_id),
grid AS (
  SELECT *, 60000::BIGINT AS num, bpm_milli * 4 AS den FROM placed),
celled AS (
  SELECT *, sign(pos - beat_offset)::BIGINT * ((2 * abs(pos - beat_offset) * den + num) // (2 * num)) AS cell
  FROM grid),
snapped AS (
  SELECT *, sign(beat_offset * den + cell * num)::BIGINT
         * ((2 * abs(beat_offset * den + cell * num) + den) // (2 * den)) AS grid_pos
  FROM celled)"""


def lattice_of(bpm="bpm", offset="beat_offset", subdivisions=4):
    return L.Lattice(RATE, F.col(bpm), F.col(offset), subdivisions)


@query("t1_sample_to_time", f"""WITH {POINTS}
SELECT id, round(pos / 44100.0::DOUBLE, 6) AS sec FROM points""")
def t1(spark, d):
    return points(spark, d).select("id", F.round(L.position_to_seconds(F.col("pos"), 44_100), 6).alias("sec"))


@query("t2_time_to_sample", """
SELECT event_id AS id, CAST(round(CAST(value AS DECIMAL(20,9)) * 44100, 0) AS BIGINT) AS sample FROM events""")
def t2(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), L.seconds_to_position(F.col("value"), 44_100).alias("sample")
    )


@query("t3_rate_remap", f"""WITH {POINTS}
SELECT id, (2 * pos * 48000 + 44100) // (2 * 44100) AS mapped FROM points""")
def t3(spark, d):
    return points(spark, d).select("id", L.remap_position(F.col("pos"), 44_100, 48_000).alias("mapped"))


@query("t4_nearest_grid", f"WITH {PLACED} SELECT id, cell, grid_pos FROM snapped")
def t4(spark, d):
    lat = lattice_of()
    return placed(spark, d).select(
        "id", lat.cell(F.col("pos")).alias("cell"), lat.nearest(F.col("pos")).alias("grid_pos")
    )


@query("t5_grid_sample", f"""WITH {PLACED}
SELECT id, sign(m)::BIGINT * ((2 * abs(m) + den) // (2 * den)) AS sample FROM (
  SELECT id, den, beat_offset * den + ((id % 50) * 4 + id % 4) * num AS m FROM grid)""")
def t5(spark, d):
    lat = lattice_of()
    return placed(spark, d).select(
        "id", lat.beat(F.col("id") % 50, F.col("id") % 4).alias("sample")
    )


@query("t6_snap_float", f"""WITH {PLACED}
SELECT id, greatest(round_even(beat_offset + round_even((pos - beat_offset) / step, 0) * step, 0), 0)::BIGINT AS sample
FROM (SELECT *, 60.0::DOUBLE / (bpm * 4) AS step FROM placed)""")
def t6(spark, d):
    return placed(spark, d).select(
        "id", L.snap_float(F.col("pos"), RATE, F.col("bpm"), F.col("beat_offset")).alias("sample")
    )


@query("t7_snap_error_ms", f"WITH {PLACED} SELECT id, round((pos - grid_pos) * 1000.0::DOUBLE / 1, 6) AS error_ms FROM snapped")
def t7(spark, d):
    lat = lattice_of()
    return placed(spark, d).select(
        "id", F.round(L.snap_error_ms(F.col("pos"), lat.nearest(F.col("pos")), F.lit(RATE)), 6).alias("error_ms")
    )


@query("t8_grid_confidence", f"""WITH {PLACED}
SELECT id, round(exp(-0.5 * pow(abs(pos - grid_pos) / 1000.0::DOUBLE / 0.3, 2)), 6) AS confidence FROM snapped""")
def t8(spark, d):
    # seconds of distance read as tenths of milliseconds, so that the bell is visible
    lat = lattice_of()
    error = L.snap_error_ms(F.col("pos"), lat.nearest(F.col("pos")), F.lit(100_000))
    return placed(spark, d).select("id", F.round(L.grid_confidence(error * 10), 6).alias("confidence"))


RHYTHM_SQL = f"""{PLACED},
rhythm AS (SELECT *, abs(pos - (beat_offset + round_even((pos - beat_offset) / step, 0) * step)) AS dist
  FROM (SELECT *, 60.0::DOUBLE / (bpm * 4) AS step FROM placed))"""


@query("t9_rhythm_score", f"""WITH {RHYTHM_SQL}
SELECT id, round(exp(-pow(dist / (step / 2), 2)), 6) AS rhythm FROM rhythm""")
def t9(spark, d):
    step = F.lit(60.0) / (F.col("bpm") * 4)
    return placed(spark, d).select(
        "id",
        F.round(L.rhythm_score(L.line_distance(F.col("pos"), step, F.col("beat_offset")), step), 6).alias("rhythm"),
    )


@query("t10_min_grid_error", f"""WITH {PLACED}
SELECT id, round(least(
   abs(pos - (beat_offset + round_even((pos - beat_offset) / (beat / 2), 0) * (beat / 2))),
   abs(pos - (beat_offset + round_even((pos - beat_offset) / (beat / 3), 0) * (beat / 3))),
   abs(pos - (beat_offset + round_even((pos - beat_offset) / (beat / 4), 0) * (beat / 4)))), 6) AS error
FROM (SELECT *, 60.0::DOUBLE / bpm AS beat FROM placed)""")
def t10(spark, d):
    return placed(spark, d).select(
        "id",
        F.round(L.min_grid_error(F.col("pos"), RATE, F.col("bpm"), F.col("beat_offset")), 6).alias("error"),
    )


@query("t11_beat_salience", f"""WITH {PLACED}
SELECT id, round(greatest(0, least(1, 0.9 * (score / 500) + 0.1 * exp(-0.5 * pow(abs(
    (pos - beat_offset + p / 2) - floor((pos - beat_offset + p / 2) / p) * p - p / 2) / 900, 2)))), 6) AS salience
FROM (SELECT *, 60.0::DOUBLE / bpm AS p FROM placed)""")
def t11(spark, d):
    return placed(spark, d).select(
        "id",
        F.round(
            L.beat_salience(
                F.col("score") / 500, F.col("pos"), RATE, F.col("bpm"), F.col("beat_offset"), width_sec=900
            ), 6,
        ).alias("salience"),
    )


@query("t12_musical_position", f"""WITH {PLACED}
SELECT id, (slot // 4 // 4 + 1) || ':' || (slot // 4 % 4 + 1) || ':' || (slot % 4 + 1) AS place FROM (
  SELECT id, greatest(floor((pos - beat_offset) / (60.0::DOUBLE / bpm) * 4 + 0.5), 0)::BIGINT AS slot FROM placed)""")
def t12(spark, d):
    return placed(spark, d).select(
        "id",
        L.musical_position(F.col("pos"), RATE, F.col("bpm"), F.col("beat_offset"), F.lit(4)).alias("place"),
    )


@query("t13_clock_format", """
SELECT event_id AS id, (ms // 60000) || ':' || lpad((ms % 60000 // 1000)::VARCHAR, 2, '0') || '.'
       || lpad((ms % 1000)::VARCHAR, 3, '0') AS clock
FROM (SELECT event_id, floor(greatest(value - 5, 0) * 1000 + 0.5)::BIGINT AS ms FROM events)""")
def t13(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), L.clock(F.col("value") - 5).alias("clock")
    )


@query("t14_subdivision_lookup", """
SELECT l_orderkey, l_linenumber, l_partkey, label,
       CASE label WHEN '1/4' THEN 1 WHEN '1/8' THEN 2 WHEN '1/12' THEN 3 WHEN '1/16' THEN 4
                  WHEN '1/24' THEN 6 WHEN '1/32' THEN 8 END AS subdivisions
FROM (SELECT *, '1/' || (4 * l_linenumber) AS label FROM lineitem)""")
def t14(spark, d):
    label = F.concat(F.lit("1/"), (4 * F.col("l_linenumber")).cast("string"))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", label.alias("label"),
        L.subdivision_count(label).alias("subdivisions"),
    )
