"""Projections, filters and checks over the given tables."""

from pyspark.sql import functions as F

from ..core.quantiles import attach
from ..functions import presets
from ..functions.lattice import Lattice
from ..operators import projections as P
from .registry import query
from .views import HITS, POINTS, RATE, hits, k_of, points, table

PROJECTS = """projects AS (
  SELECT c_custkey AS id, c_name AS title, c_mktsegment AS artist, c_custkey AS updated_at,
         CASE c_nationkey % 5 WHEN 0 THEN 'unprocessed' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed'
              WHEN 3 THEN 'edited' ELSE 'failed' END AS status
  FROM customer)"""


def projects(spark, d):
    state = F.col("c_nationkey") % 5
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("title"),
        F.col("c_mktsegment").alias("artist"), F.col("c_custkey").alias("updated_at"),
        F.when(state == 0, "unprocessed").when(state == 1, "processing")
        .when(state == 2, "completed").when(state == 3, "edited").otherwise("failed").alias("status"),
    )


@query("p1_project_search", f"""WITH {PROJECTS},
found AS (SELECT * FROM projects WHERE (title ILIKE '%mach%' OR artist ILIKE '%mach%') AND status = 'edited')
SELECT *, (SELECT count(*) FROM found) AS total FROM found""")
def p1(spark, d):
    return P.search_projects(projects(spark, d), " mach ", "edited")


@query("p2_marker_filter", f"""WITH {HITS}
SELECT id, confidence FROM (SELECT *, (coalesce(acoustic, refined) - coalesce(chart, snapped)) * 1000.0 AS err FROM hits)
WHERE confidence >= 0.1 AND band = 'high_hit' AND primary_stem = 'bass' AND NOT edited AND confidence < 0.5 AND abs(err) > 25""")
def p2(spark, d):
    spec = P.MarkerFilter("high_hit", "bass", 0.1, True, True, True)
    rows = P.dual_time(hits(spark, d), RATE).withColumn("snap_error_ms", F.col("acoustic_minus_chart_ms"))
    return P.filter_hits(rows, spec).select("id", "confidence")


@query("p3_lane_filter", f"WITH {POINTS} SELECT id, pos FROM points WHERE lane = 'view'")
def p3(spark, d):
    return P.filter_lane(points(spark, d), "view").select("id", "pos")


def timed(rows):
    """Rows with their track's length: its last row is its last sample."""
    return attach(rows, rows.groupBy("track_id").agg((F.max("pos") + 1).alias("length")), ["track_id"])


@query("p4_normalize_hits", f"""WITH {HITS},
base AS (SELECT *, max(pos) OVER (PARTITION BY track_id) + 1 AS n FROM hits),
ac AS (SELECT *, least(greatest(coalesce(acoustic, refined), 0), n - 1) AS ac FROM base),
ch AS (SELECT *, least(greatest(coalesce(snapped, 0), 0), n - 1) AS sn FROM ac)
SELECT id, ac AS acoustic, least(greatest(detected, 0), n - 1) AS detected, least(greatest(refined, 0), n - 1) AS refined,
       sn AS snapped, least(greatest(coalesce(chart, sn), 0), n - 1) AS chart,
       CASE WHEN band = 'unknown' THEN 'mid_hit' ELSE band END AS band,
       round(least(1, greatest(0, ev_vocals)), 6) AS ev_vocals, round(ev_drums, 6) AS ev_drums,
       round(least(1, ev_other), 6) AS ev_other, 3 AS n_keys,
       round((ac - least(greatest(coalesce(chart, sn), 0), n - 1)) * 1000.0::DOUBLE, 6) AS snap_error_ms
FROM ch""")
def p4(spark, d):
    out = P.normalize_hits(timed(hits(spark, d)), Lattice(RATE, 0.006, 1000), F.col("length"), RATE)
    return out.select(
        "id", "acoustic", "detected", "refined", "snapped", "chart", "band",
        *[F.round(F.col("evidence")[s], 6).alias(f"ev_{s}") for s in ("vocals", "drums", "other")],
        F.size("evidence").alias("n_keys"), F.round("snap_error_ms", 6).alias("snap_error_ms"),
    )


@query("p5_dual_time", f"""WITH {HITS}
SELECT id, a AS acoustic, c AS chart, round(a / 100.0::DOUBLE, 6) AS acoustic_sec, round(c / 100.0::DOUBLE, 6) AS chart_sec,
       round((a - c) * 1000.0::DOUBLE / 100, 6) AS acoustic_minus_chart_ms, source = 'manual' AS manual
FROM (SELECT *, coalesce(acoustic, refined) AS a, coalesce(chart, snapped) AS c FROM hits)""")
def p5(spark, d):
    return P.dual_time(hits(spark, d), 100).select(
        "id", "acoustic", "chart", F.round("acoustic_sec", 6).alias("acoustic_sec"),
        F.round("chart_sec", 6).alias("chart_sec"),
        F.round("acoustic_minus_chart_ms", 6).alias("acoustic_minus_chart_ms"), "manual",
    )


@query("p6_candidate_view", f"""WITH {HITS}
SELECT id, pos AS acoustic, CASE WHEN k % 3 <> 0 THEN detected ELSE pos END AS aligned,
       CASE WHEN k % 2 <> 0 THEN snapped ELSE pos END AS refined, round(pos / 100.0::DOUBLE, 6) AS time_sec FROM hits""")
def p6(spark, d):
    candidates = hits(spark, d).select(
        "id", F.col("pos").alias("acoustic"), F.when(F.col("k") % 3 != 0, F.col("detected")).alias("aligned"),
        F.when(F.col("k") % 2 != 0, F.col("snapped")).alias("refined"),
    )
    return P.candidate_view(candidates, 100).withColumn("time_sec", F.round("time_sec", 6))


@query("p7_range_quarantine", f"""WITH {HITS},
h AS (SELECT *, max(pos) OVER (PARTITION BY track_id) + 1 AS n FROM hits),
long AS (SELECT id, n, 'detected' AS field, detected AS value FROM h UNION ALL SELECT id, n, 'refined', refined FROM h
         UNION ALL SELECT id, n, 'chart', chart FROM h),
bad AS (SELECT id, field, value FROM long WHERE value < 0 OR value >= n)
SELECT id, field, value FROM bad
UNION ALL SELECT id, 'valid' AS field, 0::BIGINT AS value FROM hits WHERE id NOT IN (SELECT id FROM bad)""")
def p7(spark, d):
    good, bad = P.split_by_range(timed(hits(spark, d)), ["detected", "refined", "chart"], F.col("length"))
    return bad.select("id", "field", "value").unionByName(
        good.select("id", F.lit("valid").alias("field"), F.lit(0).cast("bigint").alias("value"))
    )


@query("p8_integrity_rules", f"""WITH {HITS},
u AS (SELECT id, track_id, pos AS s, pos + k - 20 AS e, CASE WHEN k % 10 = 0 THEN pos + 1 ELSE pos END AS a,
             [k % 3, k % 5, k % 7] AS idx, max(pos) OVER (PARTITION BY track_id) + 1 AS n FROM hits),
broken AS (
  SELECT 'positive_duration' AS rule FROM u WHERE e <= s
  UNION ALL SELECT 'aligned_is_start' FROM u WHERE a <> s
  UNION ALL SELECT 'indices_ordered' FROM u WHERE NOT (idx[1] < idx[2] AND idx[2] < idx[3])
  UNION ALL SELECT 'inside_track' FROM u WHERE e > n
  UNION ALL SELECT 'unique_start' FROM u GROUP BY track_id, s // 86400 HAVING count(*) > 1
  UNION ALL SELECT 'sequential_index' FROM hits GROUP BY track_id, k
     HAVING min(k % 2) <> 0 OR max(k % 2) <> count(*) - 1 OR count(DISTINCT k % 2) <> count(*))
SELECT rule, count(*) AS n FROM broken GROUP BY rule""")
def p8(spark, d):
    h = timed(hits(spark, d))
    k = F.col("k")
    units = h.select(
        "id", "track_id", "length", "pos", (F.col("pos") + k - 20).alias("stop"),
        F.when(k % 10 == 0, F.col("pos") + 1).otherwise(F.col("pos")).alias("aligned"),
        F.array(k % 3, k % 5, k % 7).alias("indices"),
    )
    rules = {
        "positive_duration": F.col("stop") > F.col("pos"),
        "aligned_is_start": F.col("aligned") == F.col("pos"),
        "indices_ordered": P.ordered_unique(F.col("indices")),
        "inside_track": F.col("stop") <= F.col("length"),
    }
    row_level = P.violations(units, rules, ["id"]).select("rule")
    starts = units.select("track_id", F.floor(F.col("pos") / 86_400).alias("day"))
    repeated = P.duplicate_keys(starts, ["track_id", "day"]).select(F.lit("unique_start").alias("rule"))
    numbered = h.select("track_id", "k", (k % 2).alias("idx"))
    gaps = P.index_gaps(numbered, ["track_id", "k"], "idx").select(F.lit("sequential_index").alias("rule"))
    return row_level.unionByName(repeated).unionByName(gaps).groupBy("rule").agg(F.count("*").alias("n"))


@query("p9_lane_mapping", f"""WITH {HITS}
SELECT id, CASE primary_stem WHEN 'vocals' THEN 'vocals' WHEN 'other' THEN 'melody' WHEN 'drums' THEN 'drums'
       ELSE 'mix' END AS lane FROM hits""")
def p9(spark, d):
    return hits(spark, d).select("id", P.lane(F.col("primary_stem")).alias("lane"))


@query("p10_source_evidence", f"""WITH {HITS}
SELECT id, round(least(1, ev_vocals), 6) AS vocals, round(least(1, ev_other), 6) AS melody, round(ev_drums, 6) AS drums,
       CASE WHEN primary_stem IN ('bass', 'mix') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mix FROM hits""")
def p10(spark, d):
    ev = P.source_evidence(F.col("evidence"), P.lane(F.col("primary_stem")))
    return hits(spark, d).withColumn("ev", ev).select(
        "id", *[F.round(F.col("ev")[name], 6).alias(name) for name in ("vocals", "melody", "drums", "mix")]
    )


@query("p11_config", """
SELECT e.event_id AS id, c.mode, round(greatest(0.08, c.h * (1 - 0.45 * (s - 0.5))), 6) AS peak_height,
       round(greatest(0.015, c.p * (1 - 0.35 * (s - 0.5))), 6) AS peak_prominence,
       round(greatest(0.75, c.v * (1 - 0.5 * (s - 0.5))), 6) AS individual_vote_height, c.i AS minimum_interval_ms
FROM (SELECT *, CAST(props->>'$.k' AS BIGINT) / 99.0::DOUBLE AS s FROM events) e
JOIN (VALUES ('signup', 'recall', 0.34::DOUBLE, 0.085::DOUBLE, 1.18::DOUBLE, 12.0::DOUBLE),
             ('error', 'balanced', 0.49, 0.165, 1.35, 16.0), ('click', 'clean', 0.6, 0.2, 1.95, 24.0),
             ('view', 'accurate', 0.43, 0.13, 1.42, 14.0), ('purchase', 'balanced', 0.49, 0.165, 1.35, 16.0)) c(t, mode, h, p, v, i)
  ON e.event_type = c.t""")
def p11(spark, d):
    kind = F.col("event_type")
    mode = (
        F.when(kind == "signup", "recall").when(kind == "click", "clean")
        .when(kind == "view", "accurate").otherwise("balanced")
    )
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("id"), mode.alias("mode"), (k_of(F.col("props")) / 99).alias("sensitivity")
    )
    return presets.with_config(rows).select(
        "id", "mode", *[F.round(c, 6).alias(c) for c in presets.SENSITIVE], "minimum_interval_ms"
    )
