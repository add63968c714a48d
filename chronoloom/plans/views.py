"""The given tables in the roles of the data model, in Spark and in SQL.

Positions are whole seconds since 2024-01-01, so the sample rate is 1 per second
and lattice steps, windows and spacings are hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.timeline import Timeline

HOUR = 3600
DAY = 86_400
RATE = 1

#: per track and second, whole-track order is (pos, id)
TRACKS = Timeline(["track_id"], "pos", ["id"], 2 * DAY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """Whole seconds since 2024-01-01 of a zone-less timestamp."""
    days = F.datediff(F.to_date(ts), F.lit("2024-01-01").cast("date")).cast("bigint")
    return days * DAY + F.hour(ts) * HOUR + F.minute(ts) * 60 + F.second(ts)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track_id"),
        seconds(F.col("ts")).alias("pos"),
        F.col("event_id").alias("id"),
        F.col("event_type").alias("lane"),
        F.col("value").alias("score"),
    )


POINTS = """points AS (
  SELECT user_id AS track_id, epoch(date_trunc('second', ts))::BIGINT - 1704067200 AS pos,
         event_id AS id, event_type AS lane, value AS score
  FROM events)"""


def tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tempo segments: the signup rows of a track; bpm has three decimals."""
    return (
        points(spark, sf_dir)
        .filter("lane = 'signup'")
        .select(
            "track_id",
            F.col("pos").alias("start_pos"),
            ((F.floor("score") % 9 + 4) / 1000).alias("bpm"),
            F.col("pos").alias("beat_offset"),
            F.col("id").alias("segment_id"),
        )
    )


TEMPO = """tempo AS (
  SELECT track_id, pos AS start_pos, (floor(score)::BIGINT % 9 + 4) / 1000.0::DOUBLE AS bpm,
         floor(score)::BIGINT % 9 + 4 AS bpm_milli, pos AS beat_offset, id AS segment_id
  FROM points WHERE lane = 'signup')"""


def k_of(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("bigint")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit points with five positions, evidence and edit flags."""
    k = k_of(F.col("props"))
    kind = F.col("event_type")
    pos = seconds(F.col("ts"))
    stem = (
        F.when(kind == "signup", "vocals").when(kind == "error", "drums")
        .when(kind == "click", "bass").when(kind == "view", "other").otherwise("mix")
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track_id"),
        F.col("event_id").alias("id"),
        pos.alias("pos"),
        (pos + F.col("event_id") % 7 - 3).alias("detected"),
        pos.alias("refined"),
        F.when(k % 5 != 0, pos + k % 3).alias("acoustic"),
        (pos - pos % 3000).alias("snapped"),
        F.when(k % 4 != 0, pos - pos % 3000 + k).alias("chart"),
        F.when(kind == "signup", "low_hit").when(kind == "error", "mid_hit")
        .when(kind == "click", "high_hit").when(kind == "view", "full_band_accent")
        .otherwise("unknown").alias("band"),
        stem.alias("primary_stem"),
        F.when(kind == "purchase", "manual").when(kind == "error", "stems")
        .otherwise("fused").alias("source"),
        (F.col("value") / 500).alias("confidence"),
        (k / 100).alias("salience"),
        (kind == "error").alias("edited"),
        (kind == "purchase").alias("locked"),
        F.create_map(
            F.lit("vocals"), k / 80, F.lit("drums"), (100 - k) / 100,
            F.lit("other"), F.col("value") / 400, F.lit("noise"), F.lit(0.5),
        ).alias("evidence"),
        F.array(
            F.when(k % 2 == 0, "spectral_flux").otherwise("percussive_flux"),
            F.when(k % 3 == 0, "low_band").otherwise("energy_attack"),
            F.concat(F.lit("stem_"), stem),
        ).alias("votes"),
        k.alias("k"),
    )


HITS = """hits AS (
  SELECT user_id AS track_id, event_id AS id, pos, pos + event_id % 7 - 3 AS detected,
         pos AS refined, CASE WHEN k % 5 <> 0 THEN pos + k % 3 END AS acoustic,
         pos - pos % 3000 AS snapped, CASE WHEN k % 4 <> 0 THEN pos - pos % 3000 + k END AS chart,
         CASE event_type WHEN 'signup' THEN 'low_hit' WHEN 'error' THEN 'mid_hit'
              WHEN 'click' THEN 'high_hit' WHEN 'view' THEN 'full_band_accent' ELSE 'unknown' END AS band,
         CASE event_type WHEN 'signup' THEN 'vocals' WHEN 'error' THEN 'drums'
              WHEN 'click' THEN 'bass' WHEN 'view' THEN 'other' ELSE 'mix' END AS primary_stem,
         CASE event_type WHEN 'purchase' THEN 'manual' WHEN 'error' THEN 'stems' ELSE 'fused' END AS source,
         value / 500 AS confidence, k / 100.0::DOUBLE AS salience,
         event_type = 'error' AS edited, event_type = 'purchase' AS locked,
         k / 80.0::DOUBLE AS ev_vocals, (100 - k) / 100.0::DOUBLE AS ev_drums, value / 400 AS ev_other,
         CASE WHEN k % 2 = 0 THEN 'spectral_flux' ELSE 'percussive_flux' END AS vote1,
         CASE WHEN k % 3 = 0 THEN 'low_band' ELSE 'energy_attack' END AS vote2, k
  FROM (SELECT *, epoch(date_trunc('second', ts))::BIGINT - 1704067200 AS pos,
               CAST(props->>'$.k' AS BIGINT) AS k FROM events))"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evenly spaced frames: one row per element of the embedding arrays."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("track_id"),
        F.posexplode("embedding").alias("frame_idx", "x"),
    ).withColumn("x", F.col("x").cast("double")).withColumn("frame_idx", F.col("frame_idx").cast("bigint"))


FRAMES = """frames AS (
  SELECT vec_id AS track_id, (i - 1)::BIGINT AS frame_idx, embedding[i]::DOUBLE AS x
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""

#: frames are ordered by their index; slices of 32 frames split even short arrays
FRAME_LINE = Timeline(["track_id"], "frame_idx", (), 32)
