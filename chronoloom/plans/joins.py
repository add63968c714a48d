"""Ordered joins over the given tables."""

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import merge as M
from .lattice import PLACED
from .registry import query
from .views import FRAME_LINE, FRAMES, HITS, HOUR, POINTS, TRACKS, frames, hits, points, table, tempo

INTERVALS = """intervals AS (
  SELECT track_id, pos AS s, pos + floor(score)::BIGINT * 200 - 5000 AS e, id AS idx FROM points WHERE lane = 'signup')"""


def intervals(spark, d):
    start = F.col("pos")
    return points(spark, d).filter("lane = 'signup'").select(
        "track_id", start.alias("s"), (start + F.floor("score") * 200 - 5000).alias("e"), F.col("id").alias("idx")
    )


@query("j1_asof_tempo", f"WITH {PLACED} SELECT id, start_pos, bpm_milli FROM placed")
def j1(spark, d):
    out = J.asof_segment(points(spark, d), tempo(spark, d), TRACKS, "start_pos", ["bpm"])
    return out.select("id", "start_pos", F.round(F.col("bpm") * 1000).cast("bigint").alias("bpm_milli"))


@query("j2_interval_join", f"""WITH {POINTS}, {INTERVALS}
SELECT p.id, min(i.idx) AS idx FROM points p
LEFT JOIN intervals i ON p.track_id = i.track_id AND p.pos >= i.s AND p.pos < i.e GROUP BY p.id""")
def j2(spark, d):
    return J.interval_join(points(spark, d), intervals(spark, d), TRACKS, "s", "e", "idx").select("id", "idx")


@query("j3_nearest_distance", f"""WITH {POINTS}, ev AS (SELECT DISTINCT track_id, pos AS at FROM points WHERE lane = 'error')
SELECT p.id, least(p.pos - l.at, r.at - p.pos) AS distance FROM points p
ASOF LEFT JOIN ev l ON p.track_id = l.track_id AND p.pos >= l.at
ASOF LEFT JOIN ev r ON p.track_id = r.track_id AND p.pos <= r.at""")
def j3(spark, d):
    p = points(spark, d)
    return J.nearest_distance(p, p.filter("lane = 'error'"), TRACKS).select("id", "distance")


@query("j4_suppress_near", f"""WITH {POINTS}
SELECT n.id FROM points n WHERE n.lane <> 'error' AND NOT EXISTS (
  SELECT 1 FROM points e WHERE e.lane = 'error' AND e.track_id = n.track_id
     AND (abs(e.pos - n.pos) <= 3600 OR e.pos // 7200 = n.pos // 7200))""")
def j4(spark, d):
    p = points(spark, d).withColumn("cell", F.floor(F.col("pos") / 7200))
    return J.suppress_near(p.filter("lane <> 'error'"), p.filter("lane = 'error'"), TRACKS, HOUR, "cell").select("id")


def greedy_match_sql(tolerance: int, tag: str = "") -> str:
    """Recursive walk over all pairs in (distance, truth, prediction) order."""
    return f"""pairs{tag} AS (
  SELECT t.track_id, t.id AS t, p.id AS p, abs(t.pos - p.pos) AS d,
         row_number() OVER (PARTITION BY t.track_id ORDER BY abs(t.pos - p.pos), t.id, p.id) AS rn
  FROM points t JOIN points p ON t.track_id = p.track_id AND t.lane = 'purchase' AND p.lane = 'click'
       AND abs(t.pos - p.pos) <= {tolerance}),
walk{tag} AS (
  SELECT track_id, 0::BIGINT AS rn, []::BIGINT[] AS ut, []::BIGINT[] AS up, []::BIGINT[] AS ud
  FROM (SELECT DISTINCT track_id FROM pairs{tag})
  UNION ALL
  SELECT w.track_id, q.rn,
    CASE WHEN list_contains(ut, q.t) OR list_contains(up, q.p) THEN ut ELSE list_append(ut, q.t) END,
    CASE WHEN list_contains(ut, q.t) OR list_contains(up, q.p) THEN up ELSE list_append(up, q.p) END,
    CASE WHEN list_contains(ut, q.t) OR list_contains(up, q.p) THEN ud ELSE list_append(ud, q.d) END
  FROM walk{tag} w JOIN pairs{tag} q ON q.track_id = w.track_id AND q.rn = w.rn + 1),
done{tag} AS (SELECT track_id, max_by(ut, rn) AS ut, max_by(up, rn) AS up, max_by(ud, rn) AS ud
  FROM walk{tag} GROUP BY track_id),
matches{tag} AS (SELECT track_id, unnest(ut) AS truth_idx, unnest(up) AS prediction_idx, unnest(ud) AS distance FROM done{tag})"""


def truth_and_prediction(spark, d):
    p = points(spark, d).withColumn("idx", F.col("id"))
    return p.filter("lane = 'purchase'"), p.filter("lane = 'click'")


def matches(spark, d, tolerance):
    truth, predicted = truth_and_prediction(spark, d)
    return J.match_events(truth, predicted, TRACKS, tolerance)


@query("j5_tolerance_match", f"""WITH RECURSIVE {POINTS}, {greedy_match_sql(4 * HOUR)}
SELECT track_id, truth_idx, prediction_idx, distance FROM matches""")
def j5(spark, d):
    return matches(spark, d, 4 * HOUR)


@query("j6_candidate_hit_link", f"""WITH {HITS}
SELECT c.id, h.id AS hit_id, CASE WHEN c.k >= 40 AND h.id IS NULL THEN 'uncertain' WHEN c.k >= 40 THEN 'accepted'
       WHEN c.k >= 10 THEN 'uncertain' ELSE 'rejected' END AS status,
       coalesce(h.refined, c.pos) AS acoustic, coalesce(h.chart2, c.snapped) AS chart
FROM (SELECT * FROM hits WHERE primary_stem = 'vocals') c
LEFT JOIN (SELECT *, coalesce(chart, snapped) AS chart2, id - 1 AS cid FROM hits WHERE primary_stem = 'drums') h ON h.cid = c.id""")
def j6(spark, d):
    h = hits(spark, d)
    k = F.col("k")
    candidates = h.filter("primary_stem = 'vocals'").select(
        "id", F.col("pos").alias("acoustic"), F.col("snapped").alias("chart"),
        F.when(k >= 40, "accepted").when(k >= 10, "uncertain").otherwise("rejected").alias("status"),
    )
    kept = h.filter("primary_stem = 'drums'").select(
        "id", (F.col("id") - 1).alias("candidate_id"), F.col("refined").alias("acoustic"),
        F.coalesce("chart", "snapped").alias("chart"),
    )
    return J.link_candidates(candidates, kept)


def stem_frames(spark, d):
    """Four activity curves per embedding row, one frame per entry."""
    e, n = F.col("embedding"), F.size("embedding")

    def turned(by, factor):
        return F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.abs(F.get(e, (i + by) % n)).cast("double") * F.lit(factor),
        )

    scale = {"vocals": 1.0, "drums": 0.95, "bass": 0.9, "other": 1.05}
    zipped = F.arrays_zip(*[turned(16 * i, f).alias(s) for i, (s, f) in enumerate(scale.items())])
    return (
        table(spark, d, "embeddings")
        .select(F.col("vec_id").alias("track_id"), F.posexplode(zipped).alias("frame_idx", "z"))
        .select("track_id", F.col("frame_idx").cast("bigint").alias("frame_idx"), "z.*")
    )


STEM_FRAMES = """stem_frames AS (
  SELECT vec_id AS track_id, (i - 1)::BIGINT AS frame_idx, abs(embedding[i])::DOUBLE AS vocals,
         abs(embedding[(i + 15) % n + 1])::DOUBLE * 0.95::DOUBLE AS drums,
         abs(embedding[(i + 31) % n + 1])::DOUBLE * 0.9::DOUBLE AS bass, abs(embedding[(i + 47) % n + 1])::DOUBLE * 1.05::DOUBLE AS other
  FROM (SELECT vec_id, embedding, len(embedding) AS n, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""


@query("j8_timeline_sampling", f"""WITH {POINTS}, {STEM_FRAMES},
placed AS (SELECT *, least(greatest(round_even(pos / 40000.0::DOUBLE, 0)::BIGINT, 0), 63) AS frame_idx FROM points)
SELECT p.id, round(vocals / t, 6) AS share_vocals, round(drums / t, 6) AS share_drums,
       round(bass / t, 6) AS share_bass, round(other / t, 6) AS share_other
FROM placed p LEFT JOIN (SELECT *, greatest(vocals + drums + bass + other, 1e-8) AS t FROM stem_frames) f
  ON p.track_id = f.track_id AND p.frame_idx = f.frame_idx""")
def j8(spark, d):
    stems = ["vocals", "drums", "bass", "other"]
    out = J.evidence_at(points(spark, d), stem_frames(spark, d), ["track_id"], "pos", 40_000, stems)
    return out.select("id", *[f"share_{s}" for s in stems])


@query("j10_local_evidence", f"""WITH {STEM_FRAMES},
peaks AS (SELECT track_id, frame_idx, 0.5 * max(vocals) OVER w + 0.3 * max(drums) OVER w + 0.2 * max(bass) OVER w AS e
          FROM stem_frames WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
tokens AS (SELECT conv_id AS track_id, turn % 64 AS frame_idx, turn FROM conversations)
SELECT t.track_id, t.turn, round(p.e, 6) AS evidence FROM tokens t LEFT JOIN peaks p USING (track_id, frame_idx)""")
def j10(spark, d):
    tokens = table(spark, d, "conversations").select(
        F.col("conv_id").alias("track_id"), (F.col("turn") % 64).alias("frame_idx"), "turn"
    )
    weights = {"vocals": 0.5, "drums": 0.3, "bass": 0.2}
    out = J.local_evidence(tokens, stem_frames(spark, d), FRAME_LINE, weights)
    return out.select("track_id", "turn", F.round("evidence", 6).alias("evidence"))


def units(spark, d):
    """Parents (turns) naming child frames in an index array."""
    turn = F.col("turn")
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("track_id"), turn,
        F.array_distinct(F.array(turn, turn * 3 % 64, turn * 7 % 64)).alias("indices"),
    )


UNITS = """units AS (
  SELECT DISTINCT conv_id AS track_id, turn, unnest([turn, turn * 3 % 64, turn * 7 % 64]) AS frame_idx FROM conversations)"""


@query("j11_index_roll_up", f"""WITH {FRAMES}, {UNITS}
SELECT track_id, turn, round(min(x), 6) AS low, round(max(x), 6) AS high, count(*) AS n
FROM units JOIN frames USING (track_id, frame_idx) GROUP BY track_id, turn""")
def j11(spark, d):
    out = J.roll_up(
        units(spark, d), frames(spark, d), ["track_id"], "indices", "frame_idx",
        [F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")],
    )
    return out.withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


@query("j12_bulk_replace", f"""WITH {POINTS},
cur AS (SELECT id, track_id FROM points WHERE lane IN ('view', 'click', 'error')),
inc AS (SELECT id, CASE WHEN score < 40 THEN track_id + 1 ELSE track_id END AS track_id FROM points
        WHERE lane IN ('view', 'signup') AND score > 20)
SELECT coalesce(c.id, i.id) AS id, c.track_id AS old_track, i.track_id AS new_track,
  CASE WHEN c.id IS NULL THEN 'insert' WHEN i.id IS NULL AND c.track_id NOT IN (SELECT track_id FROM inc) THEN 'untouched'
       WHEN i.id IS NULL THEN 'delete' WHEN c.track_id <> i.track_id THEN 'conflict' ELSE 'update' END AS action
FROM cur c FULL OUTER JOIN inc i ON c.id = i.id""")
def j12(spark, d):
    p = points(spark, d)
    moved = F.when(F.col("score") < 40, F.col("track_id") + 1).otherwise(F.col("track_id"))
    incoming = p.filter("lane in ('view', 'signup') and score > 20").select("id", moved.alias("track_id"))
    return M.bulk_replace(p.filter("lane in ('view', 'click', 'error')").select("id", "track_id"), incoming)


@query("j13_resnap", f"""WITH {PLACED}
SELECT id, pos, grid_pos AS chart, round((pos - grid_pos) * 1000.0::DOUBLE / 10000, 6) AS snap_error_ms,
       round(exp(-0.5 * pow(abs(pos - grid_pos) * 1000.0::DOUBLE / 10000 / 30, 2)), 6) AS beat, 0.25::DOUBLE AS lyric
FROM (SELECT *, sign(beat_offset * den + cell * num)::BIGINT * ((2 * abs(beat_offset * den + cell * num) + den) // (2 * den)) AS grid_pos
  FROM (SELECT *, sign(pos - beat_offset)::BIGINT * ((2 * abs(pos - beat_offset) * den + num) // (2 * num)) AS cell
    FROM (SELECT * EXCLUDE (num, den), 600000000::BIGINT AS num, bpm_milli * 10000 * 4 AS den FROM grid)))""")
def j13(spark, d):
    semantic = F.create_map(F.lit("lyricAlignment"), F.lit(0.25), F.lit("beatConfidence"), F.lit(0.0))
    rows = points(spark, d).withColumn("semantic", semantic)
    # rate 10 kHz with bpm scaled alike: same lattice, millisecond-sized errors
    segments = tempo(spark, d).withColumn("bpm", F.col("bpm") * 10_000)
    out = J.resnap(rows, segments, TRACKS, 10_000)
    return out.select(
        "id", "pos", "chart", F.round("snap_error_ms", 6).alias("snap_error_ms"),
        F.round(F.col("semantic")["beatConfidence"], 6).alias("beat"),
        F.col("semantic")["lyricAlignment"].alias("lyric"),
    )
