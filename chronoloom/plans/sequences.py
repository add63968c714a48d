"""Window and sequence queries over the given tables."""

from pyspark.sql import functions as F

from ..core.chains import spaced
from ..core.quantiles import attach
from ..functions.lattice import Lattice
from ..operators import sequences as S
from .joins import STEM_FRAMES, stem_frames
from .lattice import PLACED, placed
from .metrics import PCM, anchors_sql, pcm
from .registry import query
from .views import (
    FRAME_LINE, FRAMES, HITS, HOUR, POINTS, RATE, TEMPO, TRACKS, frames, hits, points, table, tempo,
)

KERNEL = S.gaussian_weights(0.65)
KERNEL_ACTIVITY = S.gaussian_weights(1.15)


def smooth_sql(column, weights, window="w"):
    """Weighted lag/lead sum with repeated borders."""
    terms = [f"{weights[0]!r}::DOUBLE * {column}"]
    for i in range(1, len(weights)):
        left = ", ".join(f"lag({column}, {j}) OVER {window}" for j in range(i, 0, -1))
        right = ", ".join(f"lead({column}, {j}) OVER {window}" for j in range(i, 0, -1))
        terms.append(f"{weights[i]!r}::DOUBLE * (coalesce({left}, {column}) + coalesce({right}, {column}))")
    return " + ".join(terms)


FRAME_W = "WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx)"


@query("w1_robust_norm", f"""WITH {FRAMES},
m AS (SELECT track_id, frame_idx, abs(x) AS x, median(abs(x)) OVER (PARTITION BY track_id ORDER BY frame_idx ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS med,
  max(abs(x)) OVER (PARTITION BY track_id) AS pk FROM frames),
d AS (SELECT *, abs(x - med) AS dev FROM m),
e AS (SELECT *, median(dev) OVER (PARTITION BY track_id ORDER BY frame_idx ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS mad,
  avg(dev) OVER (PARTITION BY track_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS md FROM d),
n AS (SELECT track_id, frame_idx, least(16, greatest(x - med, 0) / greatest(1.4826 * mad, 0.35 * md, pk * 1e-5 + 1e-8)) AS nv FROM e)
SELECT track_id, frame_idx, round({smooth_sql('nv', KERNEL)}, 6) AS norm FROM n {FRAME_W}""")
def w1(spark, d):
    rows = frames(spark, d).withColumn("x", F.abs("x"))
    out = S.robust_norm(rows, FRAME_LINE, "x", 8)
    return out.select("track_id", "frame_idx", F.round("x_norm", 6).alias("norm"))


@query("w2_positive_delta", f"""WITH {FRAMES}
SELECT track_id, frame_idx, round(greatest(x - coalesce(lag(x) OVER w, x), 0), 6) AS rise FROM frames {FRAME_W}""")
def w2(spark, d):
    out = S.positive_delta(frames(spark, d), FRAME_LINE, ["x"])
    return out.select("track_id", "frame_idx", F.round("x_rise", 6).alias("rise"))


@query("w4_window_rms", f"""WITH {PCM}, s AS (SELECT DISTINCT track_id, h FROM (SELECT track_id, unnest(range(greatest((pos - 300 - (((pos - 300) % 100) + 100) % 100) // 100 + 1, 0), pos // 100 + 1)) AS h FROM pcm))
SELECT s.track_id, h AS frame_idx, round(sqrt(sum(value * value) / count(*)), 6) AS rms FROM s
JOIN pcm p ON p.track_id = s.track_id AND p.pos >= h * 100 AND p.pos < h * 100 + 300 GROUP BY s.track_id, h""")
def w4(spark, d):
    out = S.window_rms(pcm(spark, d), ["track_id"], "pos", "value", 100, 300)
    return out.select("track_id", "frame_idx", F.round("rms", 6).alias("rms"))


ACTIVITY = f"""db AS (SELECT track_id, frame_idx, 20 * log10(greatest(abs(x), 1e-8)) AS db FROM frames),
qq AS (SELECT track_id, quantile_cont(db, 0.12) AS fl, quantile_cont(db, 0.84) AS fg FROM db GROUP BY track_id),
act AS (SELECT track_id, frame_idx, greatest(0, least(1, (db - fl - 3) / greatest(5, greatest(8, fg - fl) - 3)))
  * greatest(0, least(1, (db + 58) / 10)) AS a FROM db JOIN qq USING (track_id))"""


@query("w5_activity", f"""WITH {FRAMES}, {ACTIVITY}
SELECT track_id, frame_idx, round({smooth_sql('a', KERNEL_ACTIVITY)}, 6) AS activity FROM act {FRAME_W}""")
def w5(spark, d):
    rows = frames(spark, d).withColumn("rms", F.abs("x"))
    return S.activity(rows, FRAME_LINE).select("track_id", "frame_idx", F.round("activity", 6).alias("activity"))


@query("w6_bridge_gaps", f"""WITH {FRAMES}, f AS (SELECT *, x > 0.02 AS on_ FROM frames),
g AS (SELECT *, max(frame_idx) FILTER (on_) OVER (PARTITION BY track_id ORDER BY frame_idx) AS b,
  min(frame_idx) FILTER (on_) OVER (PARTITION BY track_id ORDER BY frame_idx DESC) AS a FROM f)
SELECT track_id, frame_idx, on_ OR coalesce(a - b - 1 <= 3, false) AS active FROM g""")
def w6(spark, d):
    rows = frames(spark, d).withColumn("active", F.col("x") > 0.02)
    return S.bridge_gaps(rows, FRAME_LINE, "active", 3).select("track_id", "frame_idx", "active")


def label_of(x):
    return F.when(x < -0.12, "a").when(x < 0, "b").when(x < 0.12, "c").otherwise("d")


# the reference rule as a walk over frames: three passes reach its fixpoint
@query("w7_smooth_runs", f"""WITH RECURSIVE {FRAMES},
f AS (SELECT track_id, frame_idx, CASE WHEN x < -0.12 THEN 'a' WHEN x < 0 THEN 'b' WHEN x < 0.12 THEN 'c' ELSE 'd' END AS lb FROM frames),
c AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> lb THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY frame_idx) AS run
  FROM (SELECT *, lag(lb) OVER (PARTITION BY track_id ORDER BY frame_idx) AS p FROM f)),
r AS (SELECT track_id, run, any_value(lb) AS lb, count(*) AS n, min(frame_idx) AS s FROM c GROUP BY track_id, run),
walk AS (SELECT track_id, run, s, n, CASE WHEN n < 2 THEN coalesce((SELECT r2.lb FROM r r2 WHERE r2.track_id = r.track_id AND r2.run = 2), lb) ELSE lb END AS lb
    FROM r WHERE run = 1
  UNION ALL SELECT r.track_id, r.run, r.s, r.n, CASE WHEN r.n < 2 THEN w.lb ELSE r.lb END FROM walk w JOIN r ON r.track_id = w.track_id AND r.run = w.run + 1),
m AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> lb THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY run) AS run2
  FROM (SELECT *, lag(lb) OVER (PARTITION BY track_id ORDER BY run) AS p FROM walk)),
b AS (SELECT track_id, run2, any_value(lb) AS lb, sum(n) AS n FROM m GROUP BY track_id, run2)
SELECT c.track_id, c.frame_idx, CASE WHEN m.run2 = 1 AND b.n < 2 THEN coalesce(nx.lb, m.lb) ELSE m.lb END AS label
FROM c JOIN m USING (track_id, run) JOIN b ON b.track_id = c.track_id AND b.run2 = m.run2
LEFT JOIN b nx ON nx.track_id = c.track_id AND nx.run2 = 2""")
def w7(spark, d):
    rows = frames(spark, d).withColumn("label", label_of(F.col("x")))
    return S.smooth_runs(rows, FRAME_LINE, "label", 2).select("track_id", "frame_idx", "label")


def focus_frames(spark, d):
    stems = S.FOCUS_STEMS
    total = F.greatest(sum(F.col(s) * F.col(s) for s in stems), F.lit(1e-12))
    return stem_frames(spark, d).select(
        "track_id", "frame_idx",
        *[F.least(F.lit(1.0), F.col(s) * 3).alias(f"act_{s}") for s in stems],
        *[(F.col(s) * F.col(s) / total).alias(f"rel_{s}") for s in stems],
    )


def segments(spark, d):
    return S.focus_segments(focus_frames(spark, d), FRAME_LINE, 1000, F.lit(63_500))


def _seg_sql():
    stems = S.FOCUS_STEMS
    acts = ", ".join(f"least(1.0::DOUBLE, {s} * 3) AS act_{s}" for s in stems)
    rels = ", ".join(f"{s} * {s} / greatest(vocals * vocals + drums * drums + bass * bass + other * other, 1e-12) AS rel_{s}" for s in stems)
    avgs = ", ".join(f"round(avg(act_{s}), 6) AS ev_{s}" for s in stems)
    routes = ", ".join(f"avg(0.55 * act_{s} + 0.45 * rel_{s}) AS r_{s}" for s in stems)
    alts = ", ".join(f"{{'k': -r_{s}, 'i': {i}, 's': '{s}'}}" for i, s in enumerate(stems))
    return f"""{STEM_FRAMES}, ff AS (SELECT track_id, frame_idx, {acts}, {rels} FROM stem_frames),
v AS (SELECT *, act_vocals >= 0.24 AND rel_vocals >= 0.075 AS va FROM ff),
vb AS (SELECT *, va OR coalesce(min(frame_idx) FILTER (va) OVER (PARTITION BY track_id ORDER BY frame_idx DESC)
   - max(frame_idx) FILTER (va) OVER (PARTITION BY track_id ORDER BY frame_idx) - 1 <= 5, false) AS vocal FROM v),
lab AS (SELECT *, CASE WHEN vocal THEN 'vocals' WHEN rel_drums >= 0.42 AND act_drums >= 0.30 AND rel_other <= 0.30 THEN 'drums'
   WHEN greatest(act_other, rel_other) >= 0.16 THEN 'other' WHEN act_drums >= 0.18 THEN 'drums' WHEN act_bass >= 0.25 THEN 'bass' ELSE 'mix' END AS lb,
   greatest(0, least(1, CASE WHEN vocal THEN 0.48 + 0.34 * act_vocals + 0.18 * rel_vocals
   WHEN rel_drums >= 0.42 AND act_drums >= 0.30 AND rel_other <= 0.30 THEN 0.45 + 0.42 * rel_drums
   WHEN greatest(act_other, rel_other) >= 0.16 THEN 0.40 + 0.36 * act_other + 0.18 * rel_other
   WHEN act_drums >= 0.18 THEN 0.36 + 0.38 * act_drums WHEN act_bass >= 0.25 THEN 0.34 + 0.34 * act_bass ELSE 0.25 END)) AS cf FROM vb),
c AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> lb THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY frame_idx) AS run
  FROM (SELECT *, lag(lb) OVER (PARTITION BY track_id ORDER BY frame_idx) AS p FROM lab)),
r AS (SELECT track_id, run, any_value(lb) AS lb, count(*) AS n FROM c GROUP BY track_id, run),
walk AS (SELECT track_id, run, n, CASE WHEN n < 3 THEN coalesce((SELECT r2.lb FROM r r2 WHERE r2.track_id = r.track_id AND r2.run = 2), lb) ELSE lb END AS lb FROM r WHERE run = 1
  UNION ALL SELECT r.track_id, r.run, r.n, CASE WHEN r.n < 3 THEN w.lb ELSE r.lb END FROM walk w JOIN r ON r.track_id = w.track_id AND r.run = w.run + 1),
m AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> lb THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY run) AS run2
  FROM (SELECT *, lag(lb) OVER (PARTITION BY track_id ORDER BY run) AS p FROM walk)),
b AS (SELECT track_id, run2, any_value(lb) AS lb, sum(n) AS n FROM m GROUP BY track_id, run2),
ev AS (SELECT c.* EXCLUDE (run, p, lb), CASE WHEN m.run2 = 1 AND b.n < 3 THEN coalesce(nx.lb, m.lb) ELSE m.lb END AS lb
  FROM c JOIN m USING (track_id, run) JOIN b ON b.track_id = c.track_id AND b.run2 = m.run2 LEFT JOIN b nx ON nx.track_id = c.track_id AND nx.run2 = 2),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> lb THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY frame_idx) AS seg
  FROM (SELECT *, lag(lb) OVER (PARTITION BY track_id ORDER BY frame_idx) AS p FROM ev)),
s AS (SELECT track_id, seg, any_value(lb) AS lb, min(frame_idx) AS f0, max(frame_idx) AS f1, round(avg(cf), 6) AS confidence, {avgs}, {routes} FROM g GROUP BY track_id, seg),
alt AS (SELECT *, list_filter(list_sort([{alts}]), lambda a: a.s <> lb)[1:2] AS al FROM s),
segs AS (SELECT track_id, f0 * 1000 AS start, greatest(f0 * 1000 + 1, least(63500, (f1 + 1) * 1000)) AS "end", lb AS focus_source, confidence,
  CASE lb WHEN 'vocals' THEN 'vocal_presence' WHEN 'drums' THEN 'drum_solo' WHEN 'mix' THEN 'mixed' ELSE 'melodic_lead' END AS reason,
  {', '.join(f'ev_{s}' for s in stems)}, al[1].s AS alt1, round(-al[1].k, 6) AS alt1_score, al[2].s AS alt2, round(-al[2].k, 6) AS alt2_score FROM alt)"""


SEGMENTS = _seg_sql()


@query("w8_focus_segments", f"""WITH RECURSIVE {SEGMENTS} SELECT * EXCLUDE (alt1, alt1_score, alt2, alt2_score) FROM segs""")
def w8(spark, d):
    return segments(spark, d).drop("alternatives")


@query("o4_top_alternatives", f"""WITH RECURSIVE {SEGMENTS} SELECT track_id, start, alt1, alt1_score, alt2, alt2_score FROM segs""")
def o4(spark, d):
    a = F.col("alternatives")
    return segments(spark, d).select(
        "track_id", "start", a[0]["source"].alias("alt1"), a[0]["score"].alias("alt1_score"),
        a[1]["source"].alias("alt2"), a[1]["score"].alias("alt2_score"),
    )


def spacing_sql(source, spacing, score="score", extra=""):
    """Recursive walk in (pos, id) order; a stronger close row replaces the last kept one."""
    return f"""so AS (SELECT track_id, pos, id, {score} AS sc, row_number() OVER (PARTITION BY track_id ORDER BY pos, id) AS rn FROM {source}),
sp AS (SELECT track_id, rn, pos AS kp, sc AS ks, id AS kid, false AS appended FROM so WHERE rn = 1
  UNION ALL SELECT o.track_id, o.rn, CASE WHEN o.pos - s.kp >= {spacing} OR o.sc > s.ks THEN o.pos ELSE s.kp END,
    CASE WHEN o.pos - s.kp >= {spacing} OR o.sc > s.ks THEN o.sc ELSE s.ks END,
    CASE WHEN o.pos - s.kp >= {spacing} OR o.sc > s.ks THEN o.id ELSE s.kid END, o.pos - s.kp >= {spacing}
  FROM sp s JOIN so o ON o.track_id = s.track_id AND o.rn = s.rn + 1),
kept AS (SELECT track_id, kid AS id FROM (SELECT *, lead(appended) OVER (PARTITION BY track_id ORDER BY rn) AS na FROM sp) WHERE na IS NULL OR na)"""


@query("w10_minimum_spacing", f"WITH RECURSIVE {POINTS}, {spacing_sql('points', 8 * HOUR)} SELECT track_id, id FROM kept")
def w10(spark, d):
    return spaced(points(spark, d), TRACKS, 8 * HOUR, "score").select("track_id", "id")


@query("w11_best_per_cell", f"""WITH {PLACED}
SELECT id, cell, row_number() OVER (PARTITION BY track_id, start_pos, cell ORDER BY score DESC, pos, id) = 1 AS winner FROM snapped""")
def w11(spark, d):
    lat = Lattice(RATE, F.col("bpm"), F.col("beat_offset"))
    rows = placed(spark, d).withColumn("cell", lat.cell(F.col("pos")))
    out = S.best_per_cell(rows, ["track_id", "start_pos"], "cell", "score", ["pos", "id"])
    return out.select("id", "cell", "winner")


def rhythm_input(spark, d):
    k = F.col("k")
    rows = hits(spark, d)
    lengths = rows.groupBy("track_id").agg((F.max("pos") + 1).alias("length"))
    return attach(rows, lengths, ["track_id"]).withColumns({
        "bpm": F.lit(0.002), "beat_offset": F.lit(700).cast("bigint"), "tempo_confidence": k / 100,
        "tempo_source": F.when(k % 2 == 0, "manual").otherwise("auto"),
    })


RHYTHM_CELLS = f"""{HITS}, t AS (SELECT *, max(pos) OVER (PARTITION BY track_id) AS final, [vote1, vote2, 'stem_' || primary_stem] AS votes FROM hits),
c AS (SELECT *, sign(pos - 700)::BIGINT * ((2 * abs(pos - 700) * 8 + 60000) // 120000) AS cell FROM t WHERE k % 2 = 0 OR k / 100.0::DOUBLE >= 0.65),
g AS (SELECT * EXCLUDE (chart), least(greatest(sign(5600 + cell * 60000)::BIGINT * ((2 * abs(5600 + cell * 60000) + 8) // 16), 0), final) AS chart FROM c),
q AS (SELECT *, greatest(0, 1 - abs(pos - chart) / 1875.0::DOUBLE) AS al, CASE primary_stem WHEN 'vocals' THEN ev_vocals WHEN 'drums' THEN ev_drums WHEN 'other' THEN ev_other ELSE 0 END AS dm FROM g),
r AS (SELECT *, {{'s': 0.30 * confidence + 0.12 * salience + 0.45 * al + 0.08 + 0.05 * dm, 'a': al, 'c': confidence, 'p': -pos}} AS worth FROM q)"""
#: a hit that is better than all before it in its cell reigns; an era ends where a reign begins far from the one before
REIGNS = f"""{RHYTHM_CELLS},
b AS (SELECT *, max(worth) OVER (PARTITION BY track_id, chart ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM r),
w AS (SELECT *, best IS NULL OR worth > best AS crown FROM b),
x AS (SELECT *, last_value(CASE WHEN crown THEN pos END IGNORE NULLS) OVER (PARTITION BY track_id, chart ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reign,
  last_value(CASE WHEN crown THEN pos END IGNORE NULLS) OVER (PARTITION BY track_id, chart ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM w),
y AS (SELECT *, sum(CASE WHEN crown AND old IS NOT NULL AND abs(pos - old) > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id, chart ORDER BY id) AS era FROM x),
z AS (SELECT *, max(era) OVER (PARTITION BY track_id, chart) AS last_era, row_number() OVER (PARTITION BY track_id, chart ORDER BY worth DESC, id) AS rn FROM y),
v AS (SELECT track_id, chart, list_sort(list_distinct(flatten(list(votes)) || ['rhythm_1_16'])) AS votes FROM z WHERE era = last_era AND abs(pos - reign) <= 3600 GROUP BY 1, 2)"""


def constrained(spark, d):
    return S.rhythm_constrain(
        rhythm_input(spark, d), ["track_id"], "id", RATE, F.col("length"), max_error_ms=3_600_000.0, merge_ms=3_600_000.0
    )


@query("w12_rhythm_constraint", f"""WITH {REIGNS}
SELECT z.track_id, z.id, z.pos AS refined, z.chart, array_to_string(v.votes, ',') AS votes, 4 AS n_evidence FROM z JOIN v ON v.track_id = z.track_id AND v.chart = z.chart WHERE z.rn = 1
UNION ALL SELECT track_id, id, pos, chart, array_to_string([vote1, vote2, 'stem_' || primary_stem], ','), 4 FROM hits WHERE k % 2 = 1 AND k / 100.0::DOUBLE < 0.65""")
def w12(spark, d):
    out, _ = constrained(spark, d)
    return out.select("track_id", "id", "refined", "chart", F.array_join("votes", ",").alias("votes"), F.size("evidence").alias("n_evidence"))


@query("w12_rhythm_evidence", f"""WITH {REIGNS}, giving AS (SELECT * FROM z WHERE era = last_era AND abs(pos - reign) <= 3600)
SELECT z.id, round(max(n.ev_vocals), 6) AS vocals, round(max(n.ev_drums), 6) AS drums, round(max(n.ev_other), 6) AS other
FROM z JOIN giving n ON n.track_id = z.track_id AND n.chart = z.chart WHERE z.rn = 1 GROUP BY z.id
UNION ALL SELECT id, round(ev_vocals, 6), round(ev_drums, 6), round(ev_other, 6) FROM hits WHERE k % 2 = 1 AND k / 100.0::DOUBLE < 0.65""")
def w12_evidence(spark, d):
    out, _ = constrained(spark, d)
    return out.select("id", *(F.round(F.col("evidence")[c], 6).alias(c) for c in ("vocals", "drums", "other")))


@query("w12_rhythm_statistics", f"""WITH {RHYTHM_CELLS}
SELECT track_id, count(*) AS input_count, count(*) FILTER (abs(pos - chart) > 1875) AS retained_off_grid, count(DISTINCT chart) AS output_count,
  count(*) - count(DISTINCT chart) AS merged_same_grid FROM r GROUP BY track_id""")
def w12_statistics(spark, d):
    return constrained(spark, d)[1]


@query("w12_rhythm_winners", f"""WITH {RHYTHM_CELLS},
o AS (SELECT id, chart, row_number() OVER (PARTITION BY track_id, chart ORDER BY worth DESC, id) AS rn FROM r)
SELECT id, chart FROM o WHERE rn = 1 UNION ALL SELECT id, chart FROM hits WHERE k % 2 = 1 AND k / 100.0::DOUBLE < 0.65""")
def w12_winners(spark, d):
    return constrained(spark, d)[0].select("id", "chart")


CLUSTERED = f"""{anchors_sql(6 * HOUR, 'hits')},
cl AS (SELECT h.*, f.anchor FROM hits h JOIN fold f ON f.track_id = h.track_id AND f.pos = h.pos)"""


@query("w13_merge_clusters", f"""WITH RECURSIVE {HITS}, {CLUSTERED}
SELECT track_id, anchor, min(pos) AS refined, min(detected) AS detected, round(max(confidence), 6) AS confidence, round(max(salience), 6) AS salience,
  count(*) AS members, round(max(ev_vocals), 6) AS low, round(max(ev_drums), 6) AS mid,
  array_to_string(list_sort(list_distinct(flatten([list(vote1), list(vote2), list('stem_' || primary_stem)]))), ',') AS votes FROM cl GROUP BY track_id, anchor""")
def w13(spark, d):
    ev = F.col("evidence")
    rows = hits(spark, d).withColumns({
        "low": ev["vocals"], "mid": ev["drums"], "peak_value": F.col("salience"), "prominence": F.col("salience"),
    })
    out = S.merge_clusters(rows, TRACKS, 6 * HOUR, ["low", "mid"])
    return out.select(
        "track_id", "anchor", "refined", "detected", F.round("confidence", 6).alias("confidence"),
        F.round("salience", 6).alias("salience"), "members", F.round("low", 6).alias("low"), F.round("mid", 6).alias("mid"),
        F.array_join("votes", ",").alias("votes"),
    )


DETECTIONS = """det AS (SELECT track_id, pos, salience AS height, confidence AS prominence,
  CASE k % 5 WHEN 0 THEN 'spectral_flux' WHEN 1 THEN 'percussive_flux' WHEN 2 THEN 'energy_attack' WHEN 3 THEN 'low_band' ELSE 'fused' END AS family FROM hits)"""


@query("w14_vote_clusters", f"""WITH RECURSIVE {HITS}, {DETECTIONS}, {anchors_sql(8 * HOUR, 'det')},
v AS (SELECT d.track_id, anchor, arg_max(d.pos, [height, prominence, -d.pos]) AS frame, max(height) AS height, max(prominence) AS prominence,
  list_sort(list_distinct(list(family) FILTER (family <> 'fused'))) AS votes FROM det d JOIN fold f ON f.track_id = d.track_id AND f.pos = d.pos GROUP BY 1, 2)
SELECT track_id, frame, round(height, 6) AS height, round(prominence, 6) AS prominence, coalesce(array_to_string(votes, ','), '') AS votes FROM v
WHERE coalesce(len(votes), 0) >= 2 OR (height >= 0.8 AND prominence >= 0.2)""")
def w14(spark, d):
    k = F.col("k")
    family = (
        F.when(k % 5 == 0, "spectral_flux").when(k % 5 == 1, "percussive_flux").when(k % 5 == 2, "energy_attack")
        .when(k % 5 == 3, "low_band").otherwise("fused")
    )
    rows = hits(spark, d).select(
        "track_id", "pos", F.col("salience").alias("height"), F.col("confidence").alias("prominence"), family.alias("family")
    )
    out = S.vote_clusters(rows, TRACKS, 8 * HOUR, 2, 0.8, 0.2)
    return out.select(
        "track_id", "frame", F.round("height", 6).alias("height"), F.round("prominence", 6).alias("prominence"),
        F.array_join("votes", ",").alias("votes"),
    )


@query("w16_local_standout", f"""WITH {POINTS}
SELECT id, score >= 0.96 * max(score) OVER (PARTITION BY track_id ORDER BY pos RANGE BETWEEN 43200 PRECEDING AND 43200 FOLLOWING) AS standout FROM points""")
def w16(spark, d):
    return S.local_standout(points(spark, d), TRACKS, 12 * HOUR, F.col("score")).select("id", "standout")


@query("w17_local_density", f"""WITH {POINTS}
SELECT id, count(*) OVER (PARTITION BY track_id ORDER BY pos RANGE BETWEEN 43200 PRECEDING AND 43200 FOLLOWING) AS density FROM points""")
def w17(spark, d):
    return S.density(points(spark, d), TRACKS, 12 * HOUR).select("id", "density")


@query("w18_first_sustained", f"""WITH {FRAMES},
s AS (SELECT track_id, frame_idx, sum((abs(x) > 0.06)::INT) OVER w AS n, count(*) OVER w AS have FROM frames
  WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING))
SELECT track_id, min(frame_idx) AS first_active FROM s WHERE n >= 5 AND have = 6 GROUP BY track_id""")
def w18(spark, d):
    return S.first_sustained(frames(spark, d), FRAME_LINE, F.abs("x") > 0.06, 6, 0.72)


@query("w18_leading_silence", f"""WITH {FRAMES}, q AS (SELECT track_id, quantile_cont(abs(x), 0.98) AS r FROM frames GROUP BY track_id),
a AS (SELECT track_id, frame_idx, abs(x) >= greatest(greatest(r, 1e-7) * pow(10, -20 / 20.0::DOUBLE), 2e-6) AS a FROM frames JOIN q USING (track_id))
SELECT track_id, min(frame_idx) AS first_active FROM (SELECT *, lead(a) OVER (PARTITION BY track_id ORDER BY frame_idx) AS b FROM a) WHERE a AND b GROUP BY track_id""")
def w18_silence(spark, d):
    rows = frames(spark, d).withColumn("rms", F.abs("x"))
    return S.leading_silence(rows, FRAME_LINE, threshold_db=-20.0)


@query("w19_strictly_increasing", f"""WITH {HITS}, t AS (SELECT track_id, id, snapped, row_number() OVER (PARTITION BY track_id ORDER BY pos, id) AS n FROM hits)
SELECT id, max(snapped - n) OVER (PARTITION BY track_id ORDER BY n) + n AS pushed FROM t""")
def w19(spark, d):
    return S.strictly_increasing(hits(spark, d), TRACKS, "snapped", "pushed").select("id", "pushed")


@query("w20_attack_frame", f"""WITH {STEM_FRAMES}, a AS (SELECT *, vocals + drums + bass AS sm FROM stem_frames),
b AS (SELECT track_id, frame_idx, arg_max(frame_idx, [sm, -frame_idx]) OVER (PARTITION BY track_id ORDER BY frame_idx ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS f FROM a)
SELECT b.track_id, b.frame_idx, b.f AS attack_frame, round(s.drums, 6) AS drums FROM b JOIN stem_frames s ON s.track_id = b.track_id AND s.frame_idx = b.f
WHERE b.frame_idx IN (SELECT frame_idx FROM frames_seen WHERE frames_seen.track_id = b.track_id)""".replace(
    "WITH ", "WITH frames_seen AS (SELECT vec_id AS track_id, label * 6 AS frame_idx FROM embeddings), ", 1))
def w20(spark, d):
    peaks = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("track_id"), (F.col("label") * 6).cast("bigint").alias("frame_idx")
    )
    out = S.attack_frame(peaks, stem_frames(spark, d), FRAME_LINE, ["vocals", "drums", "bass"])
    return out.select("track_id", "frame_idx", "attack_frame", F.round("drums", 6).alias("drums"))


@query("w21_attack_ratio", f"""WITH {FRAMES}, p AS (SELECT vec_id AS track_id, (label * 6)::BIGINT AS c FROM embeddings),
r AS (SELECT p.track_id, p.c, (SELECT sqrt(avg(x * x)) FROM frames f WHERE f.track_id = p.track_id AND frame_idx BETWEEN c - 9 AND c - 2) AS b,
  (SELECT sqrt(avg(x * x)) FROM frames f WHERE f.track_id = p.track_id AND frame_idx BETWEEN c + 1 AND c + 8) AS a FROM p)
SELECT track_id, c AS frame_idx, round(coalesce(b, 0), 6) AS before_rms, round(coalesce(a, 0), 6) AS after_rms,
  round((coalesce(a, 0) + 1e-7) / (coalesce(b, 0) + 1e-7), 4) AS attack_ratio FROM r""")
def w21(spark, d):
    peaks = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("track_id"), (F.col("label") * 6).cast("bigint").alias("frame_idx")
    )
    out = S.attack_ratio(peaks, frames(spark, d), FRAME_LINE, "x", 8, 1)
    return out.select(
        "track_id", "frame_idx", F.round("before_rms", 6).alias("before_rms"), F.round("after_rms", 6).alias("after_rms"),
        F.round("attack_ratio", 4).alias("attack_ratio"),
    )


@query("w22_chunk_tiles", f"""WITH {POINTS}, n AS (SELECT track_id, max(pos) AS n FROM points GROUP BY track_id)
SELECT track_id, i AS idx, i * 100000 AS start, least(n, i * 100000 + 100000) AS "end" FROM (SELECT *, unnest(range(0, (n - 1) // 100000 + 1)) AS i FROM n)""")
def w22(spark, d):
    lengths = points(spark, d).groupBy("track_id").agg(F.max("pos").alias("n"))
    return S.tile(lengths, ["track_id"], "n", 100_000).select("track_id", "idx", "start", "end")


@query("w23_grid_lines", f"""WITH {POINTS}, {TEMPO},
c AS (SELECT *, 60000::BIGINT AS num, bpm_milli * 4 AS den, unnest(range(-2, 46)) AS cell FROM tempo),
l AS (SELECT *, beat_offset * den + cell * num AS m FROM c),
o AS (SELECT segment_id, (2 * m + den) // (2 * den) AS sample, (cell + 400) // 4 - 100 AS beat, (cell + 400) % 4 AS part, m, den, beat_offset FROM l
   WHERE m >= beat_offset * den AND m <= (beat_offset + 50000) * den AND m >= 0)
SELECT segment_id, sample, beat, part, CASE WHEN part = 0 AND (beat + 400) % 4 = 0 THEN 'bar' WHEN part = 0 THEN 'beat' ELSE 'subdivision' END AS kind,
  CASE WHEN part = 0 AND (beat + 400) % 4 = 0 THEN (beat + 400) // 4 - 100 + 1 END AS bar FROM o""")
def w23(spark, d):
    out = S.grid_lines(
        tempo(spark, d), ["segment_id"], F.col("beat_offset"), F.col("beat_offset") + 50_000, RATE
    )
    return out


@query("x2_row_generators", f"""WITH {POINTS}, n AS (SELECT track_id, max(pos) AS n FROM points GROUP BY track_id)
SELECT track_id, count(*) AS tiles, max(least(n, i * 50000 + 50000))::BIGINT AS last_end FROM (SELECT *, unnest(range(0, (n - 1) // 50000 + 1)) AS i FROM n) GROUP BY track_id""")
def x2(spark, d):
    lengths = points(spark, d).groupBy("track_id").agg(F.max("pos").alias("n"))
    return S.tile(lengths, ["track_id"], "n", 50_000).groupBy("track_id").agg(
        F.count("*").alias("tiles"), F.max("end").alias("last_end")
    )


@query("x3_ordered_fold", f"""WITH RECURSIVE {POINTS}, {anchors_sql(12 * HOUR)}
SELECT track_id, anchor, count(*) AS members FROM fold GROUP BY track_id, anchor""")
def x3(spark, d):
    from ..core.chains import anchors

    return anchors(points(spark, d), TRACKS, 12 * HOUR).groupBy("track_id", "anchor").agg(F.count("*").alias("members"))
