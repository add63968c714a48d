"""Source and sink queries over the given tables."""

from pyspark.sql import functions as F

from ..sources import readers, sinks
from .registry import query
from .views import DAY, HITS, POINTS, RATE, TEMPO, hits, points, table, tempo


@query("s3_missing_predictions", f"""WITH {POINTS}
SELECT DISTINCT track_id FROM points WHERE lane = 'view' AND track_id NOT IN (SELECT track_id FROM points WHERE lane = 'click' AND score > 200)""")
def s3(spark, d):
    p = points(spark, d)
    return readers.missing_predictions(p.filter("lane = 'view'"), p.filter("lane = 'click' and score > 200"), ["track_id"])


@query("s5_marker_csv_rows", f"""WITH {HITS}
SELECT id, a AS sample, a AS acoustic_sample, c AS chart_sample, round(a / 100.0::DOUBLE, 6) AS time_sec, band, confidence, salience, source, primary_stem,
  snapped AS snapped_sample, (a - c) * 1000.0::DOUBLE AS snap_error_ms, edited AS manually_edited, locked
FROM (SELECT *, coalesce(acoustic, refined) AS a, coalesce(chart, snapped) AS c FROM hits)""")
def s5(spark, d):
    rows = hits(spark, d).withColumn(
        "snap_error_ms", (F.coalesce("acoustic", "refined") - F.coalesce("chart", "snapped")) * F.lit(1000.0)
    )
    return sinks.csv_rows(rows, 100).withColumn("time_sec", F.round("time_sec", 6))


@query("s6_project_documents", f"""WITH {HITS}, {POINTS}, {TEMPO},
h AS (SELECT track_id, a // 864000 AS part, count(*) AS n_hits, string_agg(id::VARCHAR, ',' ORDER BY c, a, id) AS hit_ids FROM (SELECT *, coalesce(acoustic, refined) AS a, coalesce(chart, snapped) AS c FROM hits) GROUP BY 1, 2),
e AS (SELECT track_id, pos // 864000 AS part, string_agg(id::VARCHAR, ',' ORDER BY pos, id) AS candidate_ids FROM hits WHERE k >= 50 GROUP BY 1, 2),
b AS (SELECT coalesce(h.track_id, e.track_id) AS track_id, coalesce(h.part, e.part) AS part, n_hits, hit_ids, candidate_ids FROM h FULL OUTER JOIN e ON h.track_id = e.track_id AND h.part = e.part),
t AS (SELECT track_id, start_pos // 864000 AS part, count(*) AS n_tempo FROM tempo GROUP BY 1, 2),
f AS (SELECT coalesce(b.track_id, t.track_id) AS track_id, coalesce(b.part, t.part)::BIGINT AS part, coalesce(n_hits, 0) AS n_hits, hit_ids, candidate_ids, coalesce(n_tempo, 0) AS n_tempo
  FROM b FULL OUTER JOIN t ON b.track_id = t.track_id AND b.part = t.part)
SELECT c.c_custkey AS track_id, coalesce(part, 0) AS part, coalesce(n_hits, 0) AS n_hits, coalesce(hit_ids, '') AS hit_ids,
  coalesce(candidate_ids, '') AS candidate_ids, coalesce(n_tempo, 0) AS n_tempo, c.c_name AS title
FROM customer c LEFT JOIN f ON c.c_custkey = f.track_id""")
def s6(spark, d):
    rows = hits(spark, d).withColumns({"acoustic": F.coalesce("acoustic", "refined"), "chart": F.coalesce("chart", "snapped")})
    candidates = hits(spark, d).filter("k >= 50").withColumn("acoustic", F.col("pos"))
    songs = table(spark, d, "customer").select(F.col("c_custkey").alias("track_id"), F.col("c_name").alias("title"))
    docs = sinks.project_documents(
        songs, tempo(spark, d), rows, candidates, 10 * DAY, ["id", "acoustic", "chart", "band"], ["id", "acoustic"]
    )
    ids = lambda c: F.array_join(F.transform(c, lambda r: r["id"].cast("string")), ",")
    return docs.select(
        "track_id", "part", "title", F.coalesce(F.size("hitPoints"), F.lit(0)).cast("bigint").alias("n_hits"),
        ids(F.col("hitPoints")).alias("hit_ids"), ids(F.col("candidateEvents")).alias("candidate_ids"),
        F.coalesce(F.size("tempoMap"), F.lit(0)).cast("bigint").alias("n_tempo"),
    )


@query("s7_marker_partitions", f"""WITH {HITS} SELECT primary_stem, track_id, id, coalesce(chart, snapped) AS chart, coalesce(acoustic, refined) AS acoustic FROM hits""")
def s7(spark, d):
    order = ["primary_stem", "track_id", "chart", "acoustic", "id"]
    return sinks.markers(hits(spark, d), RATE).select(*order).sortWithinPartitions(*order)


@query("s8_package_manifest", f"""WITH {HITS}, t AS (SELECT track_id, max(pos) AS n FROM hits GROUP BY 1),
st AS (SELECT unnest(['vocals', 'drums', 'bass', 'other', 'mix']) AS primary_stem)
SELECT t.track_id, st.primary_stem, 'markers/' || st.primary_stem || '.json' AS path, coalesce(c.n, 0) AS count, coalesce(m.n, 0) AS marker_count, coalesce(e.n, 0) AS candidate_count,
  t.n AS sample_count, 2 AS channels, 100 AS sample_rate, 'samples' AS timebase, t.n / 100.0::DOUBLE AS duration_sec
FROM t CROSS JOIN st LEFT JOIN (SELECT track_id, primary_stem, count(*) AS n FROM hits WHERE k > 40 GROUP BY 1, 2) c USING (track_id, primary_stem)
LEFT JOIN (SELECT track_id, count(*) AS n FROM hits WHERE k > 40 GROUP BY 1) m USING (track_id)
LEFT JOIN (SELECT track_id, count(*) AS n FROM hits WHERE k > 80 GROUP BY 1) e USING (track_id)""")
def s8(spark, d):
    rows = hits(spark, d)
    songs = rows.groupBy("track_id").agg(F.max("pos").alias("sample_count")).withColumn("channels", F.lit(2))
    return sinks.package_manifest(songs, rows.filter("k > 40"), rows.filter("k > 80"), 100)


@query("s10_legacy_backfill", f"""WITH {HITS} SELECT id, coalesce(acoustic, CASE WHEN edited OR locked THEN detected ELSE refined END) AS acoustic, coalesce(chart, snapped) AS chart, 'mix' AS primary_stem FROM hits""")
def s10(spark, d):
    rows = hits(spark, d).withColumn("sample", F.col("detected")).drop("primary_stem", "evidence")
    return readers.backfill_hits(rows).select("id", "acoustic", "chart", "primary_stem")
