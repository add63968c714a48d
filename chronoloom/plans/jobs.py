"""Batch twins of the streaming operators over the given tables."""

from pyspark.sql import functions as F

from ..operators import metrics as A
from ..streaming import jobs as R
from .registry import query
from .views import HITS, HOUR, POINTS, TRACKS, hits, points, table

STATUS = "CASE lane WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'queued' ELSE 'processing' END"


@query("r1_change_feed", f"""WITH {POINTS}, s AS (SELECT track_id, id, pos, {STATUS} AS status, lane AS payload FROM points),
e AS (SELECT track_id, min(pos) AS en FROM s WHERE status = 'completed' GROUP BY 1),
o AS (SELECT s.*, lag(payload) OVER (PARTITION BY s.track_id ORDER BY pos, id) AS p FROM s LEFT JOIN e USING (track_id) WHERE en IS NULL OR pos <= en)
SELECT track_id, id, payload, status FROM o WHERE p IS NULL OR p <> payload""")
def r1(spark, d):
    status = F.when(F.col("lane") == "purchase", "completed").when(F.col("lane") == "error", "queued").otherwise("processing")
    rows = points(spark, d).select("track_id", "id", "pos", status.alias("status"), F.col("lane").alias("payload"))
    return R.job_changes_batch(rows, TRACKS, "payload", "status").select("track_id", "id", "payload", "status")


@query("r2_monotone_progress", f"""WITH {POINTS} SELECT id, round(max(greatest(0.01, least(0.97, score / 400))) OVER (PARTITION BY track_id ORDER BY pos, id), 6) AS progress FROM points""")
def r2(spark, d):
    out = A.monotone_progress(points(spark, d), TRACKS, F.col("score") / 400)
    return out.select("id", F.round("progress", 6).alias("progress"))


@query("r3_debounced_save", f"""WITH {POINTS}, g AS (SELECT *, pos - lag(pos) OVER (PARTITION BY track_id ORDER BY pos, id) AS g FROM points),
i AS (SELECT *, sum(CASE WHEN g IS NULL OR g >= 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY pos, id) AS b FROM g)
SELECT track_id, min(pos) AS started_at, arg_max(lane, [pos, id]) AS lane, max(pos) AS saved_at, count(*) AS changes FROM i GROUP BY track_id, b""")
def r3(spark, d):
    return R.debounce_batch(points(spark, d), TRACKS, "lane", 6 * HOUR)


@query("r4_protected_upsert", f"""WITH {HITS}, arr AS (SELECT * FROM hits WHERE primary_stem IN ('vocals', 'bass') AND k >= 30), cur AS (SELECT * FROM hits WHERE primary_stem NOT IN ('vocals', 'bass') OR k < 30),
prot AS (SELECT * FROM cur WHERE (edited OR locked OR source = 'manual') AND track_id IN (SELECT track_id FROM arr))
SELECT track_id, pos, 'kept' AS origin FROM prot UNION ALL SELECT track_id, pos, 'new' FROM (SELECT DISTINCT track_id, pos, source FROM arr) n
WHERE NOT EXISTS (SELECT 1 FROM prot p WHERE p.track_id = n.track_id AND abs(p.pos - n.pos) <= 3600)""")
def r4(spark, d):
    rows = hits(spark, d).select("track_id", F.col("id").cast("string").alias("id"), "pos", "source", "edited", "locked", "primary_stem", "k")
    fresh = F.col("primary_stem").isin("vocals", "bass") & (F.col("k") >= 30)
    out = R.merge_batch(rows.filter(~fresh).withColumn("version", F.lit(0)), rows.filter(fresh), TRACKS, HOUR, 1)
    origin = F.when(F.length("id") == 36, "new").otherwise("kept")
    return out.filter("id is not null").select("track_id", "pos", origin.alias("origin"))


@query("r5_interrupted_sweep", """WITH o AS (SELECT *, CASE o_orderstatus WHEN 'O' THEN 'processing' WHEN 'P' THEN 'queued' ELSE 'completed' END AS status,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT o_custkey, o_orderkey, CASE WHEN status <> 'completed' AND o_orderdate < TIMESTAMP '2001-06-01' THEN 'failed' ELSE status END AS status,
  CASE WHEN status <> 'completed' AND o_orderdate < TIMESTAMP '2001-06-01' THEN 'ANALYSIS_INTERRUPTED' END AS error_code FROM o WHERE rn = 1""")
def r5(spark, d):
    state = F.col("o_orderstatus")
    rows = table(spark, d, "orders").select(
        "o_custkey", "o_orderkey", "o_orderdate",
        F.when(state == "O", "processing").when(state == "P", "queued").otherwise("completed").alias("status"),
    )
    now = F.lit("2001-06-08").cast("timestamp_ntz")
    out = R.sweep(rows, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderdate", now, F.expr("interval 7 days"), "ANALYSIS_INTERRUPTED")
    return out.select("o_custkey", "o_orderkey", "status", "error_code")
