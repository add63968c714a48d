"""Signal and alignment jobs over the given tables."""

from pyspark.sql import functions as F

from ..core.timeline import Timeline
from ..functions.lattice import Lattice
from ..operators import alignment as L
from ..operators import peaks as P
from ..operators import signals as S
from ..operators import tails
from ..operators.projections import clip
from .joins import STEM_FRAMES, stem_frames
from .metrics import TILES, tiles
from .registry import query
from .sequences import smooth_sql
from .views import DAY, FRAME_LINE, FRAMES, HITS, HOUR, POINTS, RATE, TRACKS, frames, hits, points, table


@query("w3_peak_picking", f"""WITH {FRAMES},
n AS (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS b FROM frames WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx)),
p AS (SELECT track_id, frame_idx, x FROM n WHERE a < x AND b < x AND x >= 0.05),
q AS (SELECT p.*, coalesce((SELECT max(f.frame_idx) FROM frames f WHERE f.track_id = p.track_id AND f.frame_idx < p.frame_idx AND f.x > p.x), -1) AS l,
  coalesce((SELECT min(f.frame_idx) FROM frames f WHERE f.track_id = p.track_id AND f.frame_idx > p.frame_idx AND f.x > p.x), 64) AS r FROM p),
v AS (SELECT q.track_id, q.frame_idx, q.x, q.x - greatest((SELECT min(f.x) FROM frames f WHERE f.track_id = q.track_id AND f.frame_idx > l AND f.frame_idx <= q.frame_idx),
  (SELECT min(f.x) FROM frames f WHERE f.track_id = q.track_id AND f.frame_idx < r AND f.frame_idx >= q.frame_idx)) AS prom FROM q)
SELECT track_id, frame_idx, round(prom, 6) AS prominence FROM v WHERE prom >= 0.15""")
def w3(spark, d):
    out = P.find_peaks(frames(spark, d), FRAME_LINE, "x", height=0.05, prominence=0.15)
    return out.select("track_id", "frame_idx", F.round("prominence", 6).alias("prominence"))


@query("w3_spaced_peaks", f"""WITH RECURSIVE {FRAMES},
n AS (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS b FROM frames WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx)),
p AS (SELECT track_id, frame_idx, row_number() OVER (PARTITION BY track_id ORDER BY x DESC, frame_idx DESC) AS rn FROM n WHERE a < x AND b < x AND x >= 0.0),
w AS (SELECT track_id, 0::BIGINT AS rn, []::BIGINT[] AS kept FROM (SELECT DISTINCT track_id FROM p)
  UNION ALL SELECT w.track_id, p.rn, CASE WHEN len(list_filter(kept, lambda q: abs(q - p.frame_idx) < 5)) > 0 THEN kept ELSE list_append(kept, p.frame_idx) END
  FROM w JOIN p ON p.track_id = w.track_id AND p.rn = w.rn + 1)
SELECT track_id, unnest(max_by(kept, rn)) AS frame_idx FROM w GROUP BY track_id""")
def w3_spaced(spark, d):
    return P.find_peaks(frames(spark, d), FRAME_LINE, "x", height=0.0, distance=5).select("track_id", "frame_idx")


GAP = "(r.pos - w.pos)"
ALIKE = "((r.low * w.low + r.mid * w.mid + r.high * w.high) / (r.norm * w.norm) >= 0.82 AND r.norm * w.norm > 1e-9)"
VALLEY = "(r.frame - w.frame > 1 AND len(r.back) > 0 AND list_min(r.back[-(r.frame - w.frame - 1):]) <= least(r.peak, w.peak) * 0.42)"
#: what becomes of a row: 0 absorbed, 1 replaces the state, 2 takes it over, 3 is the next state
FATE = f"""CASE WHEN {GAP} < {2 * HOUR} THEN CASE WHEN r.confidence > w.confidence THEN 1 ELSE 0 END WHEN {GAP} > {10 * HOUR} THEN 3
  WHEN {ALIKE} AND NOT {VALLEY} AND r.peak <= w.peak * 0.62 THEN 0 WHEN {ALIKE} AND NOT {VALLEY} AND w.peak <= r.peak * 0.62 THEN 2 ELSE 3 END"""
STATE = ["id", "pos", "confidence", "peak", "low", "mid", "high", "norm", "frame"]


@query("w15_tail_suppression", f"""WITH RECURSIVE {HITS}, {STEM_FRAMES},
placed AS (SELECT track_id, id, pos, confidence, salience AS peak, ev_vocals AS low, ev_drums AS mid, ev_other AS high, round_even(pos / 40000.0::DOUBLE, 0)::BIGINT AS frame,
  sqrt(ev_vocals * ev_vocals + ev_drums * ev_drums + ev_other * ev_other) AS norm, [vote1, vote2, 'stem_' || primary_stem] AS votes,
  row_number() OVER (PARTITION BY track_id ORDER BY pos, id) AS rn FROM hits),
backs AS (SELECT p.id, list(f.vocals * 4 ORDER BY f.frame_idx) AS back FROM placed p JOIN stem_frames f ON f.track_id = p.track_id AND f.frame_idx BETWEEN p.frame - 2 AND p.frame - 1 GROUP BY p.id),
r AS (SELECT placed.*, coalesce(back, []) AS back FROM placed LEFT JOIN backs USING (id)),
w AS (SELECT track_id, rn, {', '.join(STATE)}, votes AS held, NULL::BIGINT AS done, votes AS done_votes FROM r WHERE rn = 1
  UNION ALL SELECT track_id, rn, {', '.join(f'CASE WHEN fate = 0 THEN w_{c} ELSE {c} END' for c in STATE)},
    CASE fate WHEN 0 THEN held || votes WHEN 2 THEN held || votes ELSE votes END, CASE WHEN fate = 3 THEN w_id END, held
  FROM (SELECT r.*, w.held, {', '.join(f'w.{c} AS w_{c}' for c in STATE)}, {FATE} AS fate FROM w JOIN r ON r.track_id = w.track_id AND r.rn = w.rn + 1)),
kept AS (SELECT done AS id, done_votes AS votes FROM w WHERE done IS NOT NULL
  UNION ALL SELECT arg_max(id, rn), arg_max(held, rn) FROM w GROUP BY track_id)
SELECT track_id, id, pos, array_to_string(list_sort(list_distinct(kept.votes)), ',') AS votes FROM kept JOIN placed USING (id)""")
def w15(spark, d):
    ev = F.col("evidence")
    rows = hits(spark, d).select(
        "track_id", "id", "pos", "confidence", F.col("salience").alias("peak_value"), ev["vocals"].alias("low"),
        ev["drums"].alias("mid"), ev["other"].alias("high"), "votes",
    )
    curve = stem_frames(spark, d).withColumn("fused", F.col("vocals") * 4)
    config = {"tail_strength_ratio": 0.62, "tail_band_similarity": 0.82, "tail_valley_reset_ratio": 0.42}
    rows = tails.with_valley_curve(rows, curve, ["track_id"], "pos", 40_000, 2, "fused")
    out = tails.suppress_tails(rows, TRACKS, minimum=2 * HOUR, tail=10 * HOUR, config=config)
    return out.select("track_id", "id", "pos", F.array_join("votes", ",").alias("votes"))


@query("d2_level_normalisation", f"""WITH {FRAMES}, c AS (SELECT track_id, median(x) AS dc FROM frames GROUP BY 1),
g AS (SELECT track_id, any_value(dc) AS dc, quantile_cont(abs(x - dc), 0.995) AS pk FROM frames JOIN c USING (track_id) GROUP BY 1)
SELECT track_id, frame_idx, round(greatest(-1, least(1, (x - dc) * least(32, 0.92 / pk))), 6) AS level FROM frames JOIN g USING (track_id)""")
def d2(spark, d):
    chunks = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("track_id"), F.transform("embedding", lambda x: x.cast("double")).alias("samples")
    )
    out = S.normalise_level(chunks, frames(spark, d).withColumnRenamed("x", "value"), ["track_id"])
    return out.select("track_id", F.posexplode("samples").alias("i", "v")).select(
        "track_id", F.col("i").cast("bigint").alias("frame_idx"), F.round("v", 6).alias("level")
    )


E = "({0} * 4 / ({0} * 4 + 1.75))"
FUSED = f"""(0.27 * (0.55 * {E.format('vocals')} + 0.45 * {E.format('drums')}) + 0.24 * {E.format('bass')} + 0.17 * greatest({E.format('other')}, {E.format('vocals')})
  + 0.13 * greatest({E.format('drums')}, 0.82 * {E.format('bass')}) + 0.08 * {E.format('other')} + 0.11 * greatest({E.format('vocals')}, 0.82 * {E.format('drums')}, 0.78 * {E.format('bass')}))
  * (0.76 + 0.24 * greatest(0.55 * {E.format('vocals')} + 0.45 * {E.format('drums')}, {E.format('bass')}))"""
FUSE_FROM = {
    "mix_flux": "vocals", "fine_flux": "drums", "percussive_flux": "bass", "energy_derivative": "other", "rms_derivative": "vocals",
    "sub_low": "drums", "low_mid": "bass", "mid": "other", "high": "vocals", "air": "drums", "hfc_change": "bass",
}


@query("d3_curve_fusion", f"""WITH {STEM_FRAMES}, f AS (SELECT track_id, frame_idx, {FUSED} AS u FROM stem_frames)
SELECT track_id, frame_idx, round({smooth_sql('u', __import__('chronoloom.operators.sequences', fromlist=['x']).gaussian_weights(0.72))}, 6) AS fused FROM f
WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx)""")
def d3(spark, d):
    rows = stem_frames(spark, d)
    rows = rows.select("track_id", "frame_idx", *[(F.col(s) * 4).alias(f"{c}_norm") for c, s in FUSE_FROM.items()])
    return S.fuse(rows, FRAME_LINE).select("track_id", "frame_idx", F.round("fused", 6).alias("fused"))


def pcm_chunks(spark, d, chunk):
    """Audio-sized sample arrays: line item prices in shipping order per supplier group."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("track_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"), (F.col("l_extendedprice") / 100_000 - 0.5).alias("v"),
    )
    pos = F.floor(F.col("at") / 4)
    dense = rows.groupBy("track_id", pos.alias("pos")).agg(F.avg("v").alias("v"))
    count = rows.groupBy("track_id").agg((F.max(pos) + 1).alias("sample_count"))
    parts = dense.groupBy("track_id", F.floor(F.col("pos") / chunk).alias("chunk_idx")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("m")
    ).join(count, "track_id")
    start = F.col("chunk_idx") * chunk
    stop = F.least(start + chunk, F.col("sample_count"))

    def quiet(a, b):
        return F.array_repeat(F.lit(0.0), (b - a).cast("int"))

    # each value with the zeros up to the next one
    runs = F.transform("m", lambda x, i: F.concat(
        F.array(F.coalesce(x["v"], F.lit(0.0))), quiet(x["pos"] + 1, F.coalesce(F.get("m", i + 1)["pos"], stop))
    ))
    filled = F.concat(quiet(start, F.col("m")[0]["pos"]), F.flatten(runs))
    return parts.select("track_id", "sample_count", "chunk_idx", start.alias("start_sample"), filled.alias("samples"))


@query("d1_frame_features")
def d1(spark, d):
    chunk = 256 * 64
    out = S.frame_features(pcm_chunks(spark, d, chunk), ["track_id"], 44_100, chunk)
    return out.select("track_id", "frame_idx", *[F.round(c, 5).alias(c) for c in S.FEATURES])


@query("d4_attack_refinement")
def d4(spark, d):
    rows = frames(spark, d).select("track_id", F.col("frame_idx").alias("pos"), F.col("x").alias("value"), F.col("x").alias("percussive"))
    curve = S.novelty_curve(rows, Timeline(["track_id"], "pos", (), 32), 3)
    coarse = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("track_id"), F.col("vec_id").alias("id"), (F.col("label") * 5 + 8).cast("bigint").alias("detected")
    )
    return S.refine_attack(coarse, curve, ["track_id"], 500)


def pitch_frames(spark, d):
    x = F.col("x")
    return frames(spark, d).select(
        "track_id", "frame_idx", F.when(x > -0.1, F.floor(60 + x * 20).cast("double")).alias("midi"), (x > -0.1).alias("voiced"),
        clip(0.5 + x).alias("probability"), F.abs(x).alias("rms"),
    )


@query("d6_pitch_events", f"""WITH RECURSIVE {FRAMES},
f AS (SELECT track_id, frame_idx, CASE WHEN x > -0.1 THEN floor(60 + x * 20) END AS midi, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + x)) AS chance, abs(x) AS rms FROM frames),
g AS (SELECT *, midi IS NOT NULL AND chance >= 0.42::DOUBLE AS sung,
  greatest(0.0::DOUBLE, (coalesce(lead(rms) OVER w, rms) - coalesce(lag(rms) OVER w, rms))
    / CASE WHEN lag(rms) OVER w IS NOT NULL AND lead(rms) OVER w IS NOT NULL THEN 2 ELSE 1 END) AS rise
  FROM f WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx)),
h AS (SELECT g.*, lag(CASE WHEN sung THEN midi END) OVER (PARTITION BY track_id ORDER BY frame_idx) AS before,
  least(1.0::DOUBLE, rise / greatest(quantile_cont(rise, 0.94) OVER (PARTITION BY track_id), 1e-9::DOUBLE)) AS gain FROM g),
k AS (SELECT *, CASE WHEN NOT sung THEN NULL WHEN before IS NULL OR abs(midi - before) >= 0.75 THEN 'pitch_onset' WHEN gain >= 0.72 THEN 'energy_reattack' END AS kind FROM h),
c AS (SELECT *, CASE kind WHEN 'pitch_onset' THEN chance + 0.18::DOUBLE WHEN 'energy_reattack' THEN chance ELSE 0 END AS score FROM k),
n AS (SELECT *, lag(score) OVER w AS a, lead(score) OVER w AS b FROM c WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx)),
p AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, frame_idx DESC) AS rn FROM n WHERE a < score AND b < score AND score >= 0.42::DOUBLE),
w AS (SELECT track_id, 0::BIGINT AS rn, []::BIGINT[] AS kept FROM (SELECT DISTINCT track_id FROM p)
  UNION ALL SELECT w.track_id, p.rn, CASE WHEN len(list_filter(kept, lambda q: abs(q - p.frame_idx) < 3)) > 0 THEN kept ELSE list_append(kept, p.frame_idx) END
  FROM w JOIN p ON p.track_id = w.track_id AND p.rn = w.rn + 1),
l AS (SELECT track_id, unnest(max_by(kept, rn)) AS frame_idx FROM w GROUP BY track_id)
SELECT track_id, frame_idx, kind, least(0.94::DOUBLE, 0.3::DOUBLE + 0.62::DOUBLE * chance) AS confidence, least(0.9::DOUBLE, 0.25::DOUBLE + 0.55::DOUBLE * chance) AS salience
FROM l JOIN p USING (track_id, frame_idx)""")
def d6(spark, d):
    return S.melody_events(pitch_frames(spark, d), FRAME_LINE, 3)


@query("d7_vocal_novelty", f"""WITH RECURSIVE {STEM_FRAMES},
f AS (SELECT track_id, frame_idx, vocals AS onset, drums AS rms, bass AS flux, other * 10 AS pitch FROM stem_frames),
g AS (SELECT *, greatest(0.0::DOUBLE, (coalesce(lead(rms) OVER w, rms) - coalesce(lag(rms) OVER w, rms))
    / CASE WHEN lag(rms) OVER w IS NOT NULL AND lead(rms) OVER w IS NOT NULL THEN 2 ELSE 1 END) AS env
  FROM f WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx)),
m AS (SELECT track_id, greatest(quantile_cont(rms, 0.9), 1e-9::DOUBLE) AS loud, greatest(quantile_cont(rms, 0.2), 1e-9::DOUBLE) AS noise,
  greatest(quantile_cont(onset, 0.98), 1e-9::DOUBLE) AS qo, greatest(quantile_cont(env, 0.98), 1e-9::DOUBLE) AS qe, greatest(quantile_cont(flux, 0.98), 1e-9::DOUBLE) AS qf FROM g GROUP BY 1),
h AS (SELECT g.*, m.* EXCLUDE (track_id), greatest({10.0 ** (-52 / 20)!r}::DOUBLE, loud * 0.025::DOUBLE, noise * 5.0::DOUBLE) AS lowest FROM g JOIN m ON m.track_id = g.track_id),
a AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (rms - lowest) / greatest(loud - lowest, 1e-9::DOUBLE))) AS act FROM h),
u AS (SELECT *, least(1.5::DOUBLE, onset / qo) AS so, least(1.5::DOUBLE, env / qe) AS se, least(1.5::DOUBLE, flux / qf) AS st,
  CASE WHEN act > 0.05::DOUBLE THEN least(1.5::DOUBLE, pitch / 2) ELSE 0 END AS sp FROM a),
c AS (SELECT *, (0.34::DOUBLE * so + 0.25::DOUBLE * se + 0.23::DOUBLE * st + 0.18::DOUBLE * sp) * least(1.0::DOUBLE, act + 0.18::DOUBLE) AS x FROM u),
n AS (SELECT *, lag(x) OVER w AS before, lead(x) OVER w AS after FROM c WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx)),
p AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY x DESC, frame_idx DESC) AS rn FROM n WHERE before < x AND after < x AND x >= 0.16::DOUBLE),
w AS (SELECT track_id, 0::BIGINT AS rn, []::BIGINT[] AS kept FROM (SELECT DISTINCT track_id FROM p)
  UNION ALL SELECT w.track_id, p.rn, CASE WHEN len(list_filter(kept, lambda q: abs(q - p.frame_idx) < 3)) > 0 THEN kept ELSE list_append(kept, p.frame_idx) END
  FROM w JOIN p ON p.track_id = w.track_id AND p.rn = w.rn + 1),
l AS (SELECT track_id, unnest(max_by(kept, rn)) AS frame_idx FROM w GROUP BY track_id),
s AS (SELECT p.* FROM p JOIN l USING (track_id, frame_idx)),
b AS (SELECT s.*, coalesce((SELECT max(c.frame_idx) FROM c WHERE c.track_id = s.track_id AND c.frame_idx < s.frame_idx AND c.x > s.x), -1) AS lo,
  coalesce((SELECT min(c.frame_idx) FROM c WHERE c.track_id = s.track_id AND c.frame_idx > s.frame_idx AND c.x > s.x), 1000000000000) AS hi FROM s),
v AS (SELECT b.*, b.x - greatest((SELECT min(c.x) FROM c WHERE c.track_id = b.track_id AND c.frame_idx > lo AND c.frame_idx <= b.frame_idx),
  (SELECT min(c.x) FROM c WHERE c.track_id = b.track_id AND c.frame_idx < hi AND c.frame_idx >= b.frame_idx)) AS prom FROM b)
SELECT track_id, frame_idx, round(greatest(0.0::DOUBLE, least(0.94::DOUBLE, 0.16::DOUBLE + 0.24::DOUBLE * so + 0.18::DOUBLE * se + 0.18::DOUBLE * sp + 0.16::DOUBLE * st + 0.08::DOUBLE * act + 0.05::DOUBLE * prom)), 6) AS confidence,
  round(least(1.0::DOUBLE, so), 6) AS onset_score, round(least(1.0::DOUBLE, se), 6) AS envelope_score, round(least(1.0::DOUBLE, sp), 6) AS pitch_score, round(least(1.0::DOUBLE, st), 6) AS transition_score, round(act, 6) AS activity
FROM v WHERE prom >= 0.045::DOUBLE AND rms >= lowest""")
def d7(spark, d):
    rows = stem_frames(spark, d).select(
        "track_id", "frame_idx", F.col("vocals").alias("onset"), F.col("drums").alias("rms"), F.col("bass").alias("flux"),
        (F.col("other") * 10).alias("pitch_change"),
    )
    out = S.vocal_events(rows, FRAME_LINE, 3)
    scores = ["confidence", "onset_score", "envelope_score", "pitch_score", "transition_score", "activity"]
    return out.select("track_id", "frame_idx", *(F.round(c, 6).alias(c) for c in scores))


@query("d8_energy_anchors", f"""WITH RECURSIVE {STEM_FRAMES}, {POINTS}, {TILES},
g AS (SELECT track_id, frame_idx, vocals AS rms, drums AS attack, greatest(0.0::DOUBLE, (coalesce(lead(vocals) OVER w, vocals) - coalesce(lag(vocals) OVER w, vocals))
    / CASE WHEN lag(vocals) OVER w IS NOT NULL AND lead(vocals) OVER w IS NOT NULL THEN 2 ELSE 1 END) AS rise
  FROM stem_frames WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx)),
m AS (SELECT track_id, greatest(quantile_cont(rms, 0.9), 1e-9) AS loud, greatest(quantile_cont(rms, 0.2), 1e-9) AS noise, greatest(quantile_cont(attack, 0.99), 1e-9) AS qa,
  greatest(quantile_cont(rise, 0.99), 1e-9) AS qr FROM g GROUP BY track_id),
f AS (SELECT g.*, greatest(pow(10.0::DOUBLE, -52 / 20.0::DOUBLE), loud * 0.025::DOUBLE, noise * 6.0::DOUBLE) AS floor, loud,
  0.62::DOUBLE * greatest(0, least(1.5::DOUBLE, attack / qa)) + 0.38::DOUBLE * greatest(0, least(1.5::DOUBLE, rise / qr)) AS x,
  greatest(0, least(1.0::DOUBLE, attack / qa)) AS strike, greatest(0, least(1.0::DOUBLE, rise / qr)) AS climb FROM g JOIN m USING (track_id)),
e AS (SELECT *, greatest(0, least(1.0::DOUBLE, (rms - floor) / greatest(loud - floor, 1e-9))) AS active FROM f),
i AS (SELECT *, sum(CASE WHEN x = before THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY frame_idx) AS run
  FROM (SELECT *, lag(x) OVER (PARTITION BY track_id ORDER BY frame_idx) AS before FROM e)),
u AS (SELECT track_id, run, min(x) AS x, (min(frame_idx) + max(frame_idx)) // 2 AS frame_idx FROM i GROUP BY 1, 2),
p AS (SELECT track_id, frame_idx, x, row_number() OVER (PARTITION BY track_id ORDER BY x DESC, frame_idx DESC) AS rn
  FROM (SELECT *, lag(x) OVER o AS a, lead(x) OVER o AS b FROM u WINDOW o AS (PARTITION BY track_id ORDER BY run)) WHERE a < x AND b < x AND x >= 0.10),
k AS (SELECT DISTINCT track_id, 0::BIGINT AS rn, []::BIGINT[] AS kept FROM p
  UNION ALL SELECT k.track_id, p.rn, CASE WHEN len(list_filter(kept, lambda q: abs(q - p.frame_idx) < 3)) > 0 THEN kept ELSE list_append(kept, p.frame_idx) END
  FROM k JOIN p ON p.track_id = k.track_id AND p.rn = k.rn + 1),
s AS (SELECT track_id, unnest(max_by(kept, rn)) AS frame_idx FROM k GROUP BY track_id),
t AS (SELECT e.*, coalesce((SELECT max(o.frame_idx) FROM e o WHERE o.track_id = e.track_id AND o.frame_idx < e.frame_idx AND o.x > e.x), -1) AS l,
  coalesce((SELECT min(o.frame_idx) FROM e o WHERE o.track_id = e.track_id AND o.frame_idx > e.frame_idx AND o.x > e.x), 1000000) AS r FROM e JOIN s USING (track_id, frame_idx)),
h AS (SELECT t.*, t.x - greatest((SELECT min(o.x) FROM e o WHERE o.track_id = t.track_id AND o.frame_idx > l AND o.frame_idx <= t.frame_idx),
  (SELECT min(o.x) FROM e o WHERE o.track_id = t.track_id AND o.frame_idx < r AND o.frame_idx >= t.frame_idx)) AS prominence FROM t),
c AS (SELECT h.*, h.frame_idx * 40000 AS acoustic, (SELECT min(idx) FROM tiles WHERE tiles.track_id = h.track_id AND status <> 'success' AND h.frame_idx * 40000 >= s AND h.frame_idx * 40000 < e) AS idx
  FROM h WHERE prominence >= 0.025 AND rms >= floor),
n AS (SELECT *, 2400 + sign(acoustic - 300)::BIGINT * ((2 * abs(acoustic - 300) * 8 + 60000) // 120000) * 60000 AS cell FROM c WHERE idx IS NOT NULL),
y AS (SELECT *, sign(cell)::BIGINT * ((2 * abs(cell) + 8) // 16) AS chart FROM n),
z AS (SELECT *, exp(-0.5::DOUBLE * pow(abs(acoustic - chart) / 7500.0::DOUBLE / 0.35::DOUBLE, 2)) AS fit FROM y)
SELECT track_id, acoustic, chart, idx, round(greatest(0, least(0.72::DOUBLE, 0.18 + 0.25 * active + 0.22 * strike + 0.17 * climb + 0.13 * fit + 0.05 * greatest(0, least(1, prominence)))), 6) AS confidence,
  round(active, 6) AS activity, round(strike, 6) AS attack_score, round(climb, 6) AS rise_score, round(fit, 6) AS grid_confidence
FROM z WHERE fit >= 0.18 AND active >= 0.08 AND greatest(strike, climb) >= 0.10""")
def d8(spark, d):
    rows = stem_frames(spark, d).select("track_id", "frame_idx", F.col("vocals").alias("rms"), F.col("drums").alias("attack"))
    chunks = tiles(spark, d).filter("status <> 'success'").select("track_id", "idx", "start", "end")
    out = S.energy_anchors(rows, chunks, FRAME_LINE, Lattice(RATE, 0.002, 300), 40_000, 3)
    return out.withColumns({c: F.round(c, 6) for c in ("confidence", "activity", "attack_score", "rise_score", "grid_confidence")})


def words(text):
    return F.filter(F.split(F.lower(text), "[^\\p{L}]+"), lambda w: w != "")


def turn_tokens(spark, d):
    """Words of a turn as expected tokens, the same words with a rule of losses as observed."""
    rows = table(spark, d, "conversations").select(
        F.col("conv_id").alias("track_id"), F.col("turn").alias("line"), F.posexplode(words(F.col("text"))).alias("idx", "token")
    )
    heard = rows.filter("idx % 7 <> 3").withColumn(
        "token", F.when(F.col("idx") % 5 == 1, F.concat("token", F.lit("x"))).otherwise(F.col("token"))
    )
    return rows, heard


@query("d9_token_alignment")
def d9(spark, d):
    return L.align_tokens(*turn_tokens(spark, d), ["track_id", "line"])


@query("d10_mora_rollup", """WITH w AS (SELECT conv_id AS track_id, turn AS line, list_filter(string_split_regex(lower(text), '[^\\p{L}]+'), lambda x: x <> '') AS ws FROM conversations),
t AS (SELECT track_id, line, unnest(range(0, len(ws))) AS idx FROM w)
SELECT track_id, line, idx // 3 AS mora_idx, count(*) AS expected_phones, count(*) FILTER (idx % 7 <> 3) AS matched_phones,
  min(idx * 100) FILTER (idx % 7 <> 3) AS aligned_start, max(idx * 100 + 90) FILTER (idx % 7 <> 3) AS aligned_end, count(*) FILTER (idx % 7 <> 3) = 0 AS missing,
  round(avg((idx % 10) / 10.0::DOUBLE) FILTER (idx % 7 <> 3) * (count(*) FILTER (idx % 7 <> 3) / count(*)::DOUBLE) * (1 - 0.25 * count(*) FILTER (idx % 7 <> 3 AND idx % 5 = 1) / count(*)::DOUBLE), 6) AS confidence
FROM t GROUP BY 1, 2, 3""")
def d10(spark, d):
    expected, heard = turn_tokens(spark, d)
    # the edge table that the losses imply, read off the rule itself
    edges = expected.select(
        "track_id", "line", F.col("idx").cast("bigint").alias("expected_idx"),
        F.when(F.col("idx") % 7 != 3, F.col("idx").cast("bigint")).alias("observed_idx"),
        F.when(F.col("idx") % 7 == 3, "delete").when(F.col("idx") % 5 == 1, "substitute").otherwise("match").alias("operation"),
    )
    plan = expected.select(
        "track_id", "line", F.floor(F.col("idx") / 3).alias("mora_idx"), F.col("idx").cast("bigint").alias("expected_idx")
    )
    at = F.col("idx").cast("bigint") * 100
    spans = heard.select(
        "track_id", "line", F.col("idx").cast("bigint").alias("observed_idx"), at.alias("aligned_start"), (at + 90).alias("aligned_end"),
        at.alias("refined_start"), (at + 90).alias("refined_end"), ((F.col("idx") % 10) / 10).alias("confidence"),
    )
    out = L.decode_moras(edges, plan, spans, ["track_id", "line"])
    return out.drop("refined_start", "refined_end")


@query("d13_unit_coverage")
def d13(spark, d):
    return L.unit_coverage(L.align_tokens(*turn_tokens(spark, d), ["track_id", "line"]), ["track_id"])


@query("d11_phrase_cells")
def d11(spark, d):
    rows = hits(spark, d).select(
        "track_id", F.floor(F.col("pos") / (4 * DAY)).alias("phrase_id"), "id", F.col("pos").alias("refined"),
        (F.col("pos") - F.col("k") * 20).alias("aligned"), F.least(F.lit(1.0), F.col("confidence")).alias("confidence"),
        F.when(F.col("primary_stem") == "mix", "silence").otherwise("phrase").alias("kind"), F.lit(0.002).alias("bpm"),
        F.lit(0).cast("bigint").alias("beat_offset"),
    )
    line = Timeline(["track_id"], "refined", ["id"], 2 * DAY)
    return L.assign_cells(rows, line, RATE).select("track_id", "id", "refined", "grid_sample")


@query("d12_line_assignment")
def d12(spark, d):
    # the turns of a conversation as a lyric sheet, each turn with words misheard as a transcript
    turns = table(spark, d, "conversations").select(
        F.col("conv_id").alias("track_id"), F.col("turn").alias("idx"), "text"
    )
    heard = turns.withColumn("text", F.concat_ws(" ", F.filter(words(F.col("text")), lambda w: ~w.startswith("th"))))
    out = L.assign_lines(heard, turns, ["track_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("similarity", "confidence")})


@query("j9_unused_nearest_match", f"""WITH RECURSIVE {POINTS},
sp AS (SELECT track_id, id, pos, row_number() OVER (PARTITION BY track_id ORDER BY pos, id) AS rn FROM points WHERE lane = 'purchase'),
ev AS (SELECT track_id, list({{'i': id, 'p': pos, 'c': score}}) AS es FROM points WHERE lane = 'view' GROUP BY 1),
w AS (SELECT DISTINCT track_id, 0::BIGINT AS rn, NULL::BIGINT AS span_id, NULL::BIGINT AS event_id, []::BIGINT[] AS used FROM sp
  UNION ALL SELECT s.track_id, s.rn, s.id, pick, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END FROM (
    SELECT w.track_id, s.rn, s.id, w.used, list_sort(list_transform(list_filter(ev.es, lambda e: e.p >= s.pos - 7200 AND e.p < s.pos + 28800 AND NOT list_contains(w.used, e.i)),
      lambda e: {{'d': abs(e.p - s.pos - 600), 'c': -e.c, 'i': e.i}}))[1].i AS pick FROM w JOIN sp s ON s.track_id = w.track_id AND s.rn = w.rn + 1 LEFT JOIN ev ON ev.track_id = w.track_id) s)
SELECT track_id, span_id, event_id FROM w WHERE rn > 0""")
def j9(spark, d):
    p = points(spark, d)
    spans = p.filter("lane = 'purchase'").select(
        "track_id", F.col("id").alias("span_id"), F.col("pos").alias("start"), (F.col("pos") + DAY).alias("end"),
        (F.col("pos") + 600).alias("active_start"),
    )
    events = p.filter("lane = 'view'").select(
        "track_id", F.col("id").alias("event_id"), F.col("pos").alias("at"), F.col("score").alias("confidence")
    )
    return L.match_unused(spans, events, ["track_id"], 2 * HOUR, 8 * HOUR)


def replaced(spark, d):
    h = hits(spark, d)
    chunks = tiles(spark, d).withColumn("anchor_count", F.col("n"))
    anchors = h.filter("primary_stem in ('other', 'bass')").select(
        "track_id", (F.col("id") + 1_000_000_000).alias("id"), F.floor(F.col("pos") / DAY).alias("chunk_idx"), "pos",
        F.col("snapped").alias("grid_sample"), (F.col("k") > 10).alias("active"), (F.col("k") < 95).alias("chart_candidate"),
    )
    rows = h.select("track_id", "id", "pos", "snapped", "primary_stem", "edited", "locked")
    lengths = h.groupBy("track_id").agg((F.max("pos") + 1).alias("sample_count"))
    return L.replace_in_intervals(rows, anchors, chunks, lengths, TRACKS, 1800, 3000)


REPLACED = f"""{HITS}, {POINTS}, {TILES},
lengths AS (SELECT track_id, max(pos) + 1 AS length FROM hits GROUP BY track_id),
proven AS (SELECT track_id, idx, greatest(s, 0) AS s, least(e, length) AS e FROM tiles JOIN lengths USING (track_id) WHERE status = 'success' AND n >= {L.MIN_CHUNK_ANCHORS}),
auto AS (SELECT * FROM hits WHERE primary_stem = 'vocals' AND NOT edited AND NOT locked),
removable AS (SELECT * FROM auto a WHERE EXISTS (SELECT 1 FROM proven p WHERE p.track_id = a.track_id AND a.pos >= p.s AND a.pos < p.e)),
guarded AS (SELECT * FROM hits WHERE id NOT IN (SELECT id FROM removable)),
wanted AS (SELECT track_id, id + 1000000000 AS id, pos // 86400 AS idx, least(greatest(pos, 0), length - 1) AS pos, least(greatest(snapped, 0), length - 1) AS snapped
  FROM hits JOIN lengths USING (track_id) WHERE primary_stem IN ('other', 'bass') AND k > 10 AND k < 95),
chosen AS (SELECT w.*, row_number() OVER (PARTITION BY w.track_id ORDER BY w.pos, w.id) AS rn FROM wanted w JOIN proven p ON p.track_id = w.track_id AND p.idx = w.idx AND w.pos >= p.s AND w.pos < p.e
  WHERE NOT EXISTS (SELECT 1 FROM guarded g WHERE g.track_id = w.track_id AND (abs(g.pos - w.pos) <= 1800 OR g.snapped = w.snapped))),
walk AS (SELECT track_id, rn, pos AS spot, snapped AS cell, id AS kept FROM chosen WHERE rn = 1
  UNION ALL SELECT c.track_id, c.rn, CASE WHEN c.pos - spot <= 1800 OR c.snapped = cell THEN spot ELSE c.pos END, CASE WHEN c.pos - spot <= 1800 OR c.snapped = cell THEN cell ELSE c.snapped END,
    CASE WHEN c.pos - spot <= 1800 OR c.snapped = cell THEN NULL ELSE c.id END FROM walk w JOIN chosen c ON c.track_id = w.track_id AND c.rn = w.rn + 1),
pending AS (SELECT * FROM chosen WHERE id IN (SELECT kept FROM walk WHERE kept IS NOT NULL)),
used AS (SELECT * FROM proven WHERE (track_id, idx) IN (SELECT (track_id, idx) FROM pending)),
removed AS (SELECT * FROM removable a WHERE EXISTS (SELECT 1 FROM used p WHERE p.track_id = a.track_id AND a.pos >= p.s AND a.pos < p.e))"""


@query("j7_interval_replacement", f"""WITH RECURSIVE {REPLACED}
SELECT track_id, (SELECT count(*) FROM pending x WHERE x.track_id = t.track_id) AS created, (SELECT count(*) FROM removed x WHERE x.track_id = t.track_id) AS removed,
  (SELECT count(*) FROM used x WHERE x.track_id = t.track_id) AS chunks,
  (SELECT count(*) FROM auto x WHERE x.track_id = t.track_id) - (SELECT count(*) FROM removed x WHERE x.track_id = t.track_id) AS preserved
FROM (SELECT DISTINCT track_id FROM hits) t""")
def j7(spark, d):
    return replaced(spark, d)[1]


@query("j7_replaced_hits", f"""WITH RECURSIVE {REPLACED}
SELECT track_id, id, pos, snapped, primary_stem, edited, locked FROM hits WHERE id NOT IN (SELECT id FROM removed)
UNION ALL SELECT track_id, id, pos, snapped, 'vocals', false, false FROM pending""")
def j7_rows(spark, d):
    return replaced(spark, d)[0]


RUBY_SQL = (
    r"[\p{Han}々〆ヵヶ]+[\p{Hiragana}\p{Katakana}ー]*"
    r"(?:\(([\p{Hiragana}\p{Katakana}ー]+)\)|（([\p{Hiragana}\p{Katakana}ー]+)）)"
)


@query("f5_ruby", rf"""SELECT doc_id, length(regexp_replace(t, '{RUBY_SQL}', '\1\2', 'g')) AS spoken_chars, len(regexp_extract_all(t, '{RUBY_SQL}')) AS notes
FROM (SELECT doc_id, regexp_replace(text, '(?m)^(\w+)', '漢字\1夜空(よぞら)', 'g') AS t FROM documents)""")
def f5(spark, d):
    from ..functions import text as X

    # put a reading behind the first word of every line, as annotated lyrics do
    noted = F.regexp_replace("text", "(?m)^(\\w+)", "漢字$1夜空(よぞら)")
    docs = table(spark, d, "documents").select("doc_id", noted.alias("t"))
    return docs.select("doc_id", F.length(X.ruby_spoken(F.col("t"))).alias("spoken_chars"), F.size(X.ruby(F.col("t"))).alias("notes"))


@query("d5_tempo_estimation")
def d5(spark, d):
    from ..operators.tempo import TempoConfig, estimate_tempo

    rows = hits(spark, d).select("track_id", F.col("pos").alias("p"), "id", "salience", "confidence", "band")
    # seconds read as 10 ms ticks of a 100 Hz clock, modulo ten minutes
    events = rows.withColumn("pos", F.col("p") % 60_000).drop("p")
    curve = stem_frames(spark, d).select("track_id", "frame_idx", F.col("vocals").alias("fused"))
    line = Timeline(["track_id"], "pos", ["id"], 30_000)
    return estimate_tempo(events, curve, FRAME_LINE, line, "fused", 100.0, 2, TempoConfig())


@query("x1_extractor_contract", """SELECT doc_id, CASE WHEN lang = 'en' THEN NULL ELSE length(text)::DOUBLE END AS score, CASE WHEN lang = 'en' THEN 'failed' ELSE 'ok' END AS status FROM documents""")
def x1(spark, d):
    from ..operators.extractors import Extractor, extract, register_extractor

    def lengths(pdf):
        if (pdf["lang"] == "en").any():
            raise ValueError("this model does not know English")
        return pdf[["doc_id"]].assign(score=pdf["text"].str.len().astype(float))

    register_extractor(Extractor("text_length", lengths, "score double"))
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    return extract(docs, "text_length", ["doc_id"]).select("doc_id", "score", "status")
