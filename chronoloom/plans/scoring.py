"""Scores, labels and policies over the given tables."""

from pyspark.sql import functions as F

from ..core.timeline import Timeline
from ..functions.lattice import Lattice
from ..functions.presets import DEFAULTS, PRESETS
from ..operators import metrics as A
from ..operators import scoring as M
from ..operators.joins import asof_segment
from ..operators.projections import clip
from .joins import STEM_FRAMES, UNITS, stem_frames, units
from .lattice import PLACED
from .metrics import BANDS, TILES, bands, tiles
from .registry import query
from .sequences import spacing_sql
from .views import DAY, FRAMES, HITS, HOUR, POINTS, RATE, TEMPO, TRACKS, frames, hits, points, table, tempo

REFINED = Timeline(["track_id"], "refined", ["id"], 2 * DAY)


def policy_input(spark, d):
    """Hits with the tempo in force and semantic evidence; bpm and rate scaled by 10000."""
    semantic = F.create_map(
        F.lit("lyricAlignment"), F.col("k") / 120, F.lit("pitchConfidence"), F.col("confidence"),
    )
    rows = hits(spark, d).withColumns({"semantic": semantic, "id2": F.col("id")})
    segments = tempo(spark, d).withColumn("bpm", F.col("bpm") * 10_000)
    return asof_segment(rows, segments, TRACKS, "start_pos", ["bpm", "beat_offset"])


POLICY = f"""{POINTS}, {TEMPO}, {HITS},
pl AS (SELECT h.*, coalesce(t.bpm_milli, f.bpm_milli) AS bm, coalesce(t.start_pos, f.start_pos) AS off FROM hits h
  ASOF LEFT JOIN tempo t ON h.track_id = t.track_id AND h.pos >= t.start_pos
  LEFT JOIN (SELECT track_id, min(start_pos) AS start_pos, min_by(bpm_milli, start_pos) AS bpm_milli FROM tempo GROUP BY track_id) f ON f.track_id = h.track_id),
ce AS (SELECT *, bm * 40000 AS den, sign(pos - off)::BIGINT * ((2 * abs(pos - off) * bm * 40000 + 600000000::BIGINT) // (2 * 600000000::BIGINT)) AS cell FROM pl),
ch AS (SELECT * EXCLUDE (chart), sign(off * den + cell * 600000000::BIGINT)::BIGINT * ((2 * abs(off * den + cell * 600000000::BIGINT) + den) // (2 * den)) AS chart FROM ce),
sc AS (SELECT *, exp(-0.5 * pow(abs(pos - chart) / 10.0::DOUBLE / 30, 2)) AS gc,
  CASE primary_stem WHEN 'vocals' THEN least(1, ev_vocals) WHEN 'other' THEN least(1, ev_other) WHEN 'drums' THEN ev_drums ELSE 1.0 END AS src FROM ch),
so_ AS (SELECT *, least(1, 0.35 * src + 0.25 * least(1, 0.68 * confidence + 0.32 * salience) + 0.20 * gc + 0.20 * least(1, greatest(k / 120.0::DOUBLE, confidence))) AS score FROM sc),
st AS (SELECT *, CASE WHEN score >= 0.42 THEN 'accepted' WHEN score >= 0.28 THEN 'uncertain' ELSE 'rejected' END AS status FROM so_),
win AS (SELECT track_id, pos, id, score FROM (SELECT *, row_number() OVER (PARTITION BY track_id, chart ORDER BY score DESC, pos, id) AS rn FROM st WHERE status = 'accepted') WHERE rn = 1),
{spacing_sql('win', 5 * HOUR)}"""


@query("m1_chart_policy", f"""WITH RECURSIVE {POLICY}
SELECT st.id, chart, round(score, 6) AS score, CASE WHEN status = 'accepted' AND kept.id IS NULL THEN 'rejected' ELSE status END AS status
FROM st LEFT JOIN kept ON kept.id = st.id""")
def m1(spark, d):
    out = M.chart_policy(policy_input(spark, d), REFINED, 10_000, spacing=5 * HOUR)
    return out.select("id", "chart", F.round("score", 6).alias("score"), "status")


@query("flagship_chart_summary", f"""WITH RECURSIVE {POLICY},
f AS (SELECT st.*, CASE WHEN status = 'accepted' AND kept.id IS NULL THEN 'rejected' ELSE status END AS final FROM st LEFT JOIN kept ON kept.id = st.id)
SELECT track_id, count(*) AS candidates, count(*) FILTER (final = 'accepted') AS accepted, count(*) FILTER (final = 'uncertain') AS uncertain,
  count(*) FILTER (final = 'rejected') AS rejected, round(avg(score), 6) AS mean_score, max(pos) AS last_pos,
  round(coalesce(any_value(fb.bpm), round(avg(score), 3)), 3) AS bpm FROM f LEFT JOIN (SELECT track_id AS t, min_by(bpm_milli, start_pos) / 1000.0::DOUBLE AS bpm FROM tempo GROUP BY track_id) fb ON fb.t = f.track_id
GROUP BY track_id""")
def flagship(spark, d):
    """Events -> tempo in force -> lattice cell -> score -> best per cell -> spacing -> track summary."""
    scored = M.chart_policy(policy_input(spark, d), REFINED, 10_000, spacing=5 * HOUR)
    first = A.first_segment(tempo(spark, d), ["track_id"]).select("track_id", F.round("first_bpm", 3).alias("bpm"))
    status = F.col("status")
    per_track = scored.groupBy("track_id").agg(
        F.count("*").alias("candidates"), F.count_if(status == "accepted").alias("accepted"),
        F.count_if(status == "uncertain").alias("uncertain"), F.count_if(status == "rejected").alias("rejected"),
        F.round(F.avg("score"), 6).alias("mean_score"), F.max("refined").alias("last_pos"),
    )
    # a track without a tempo segment gets an estimate
    estimate = F.round("mean_score", 3)
    return per_track.join(first, "track_id", "left").withColumn("bpm", F.coalesce("bpm", estimate))


@query("m2_onset_scores", f"""WITH {HITS},
i AS (SELECT id, salience AS pv, confidence AS pr, (1 + 1 + CASE WHEN vote2 = 'energy_attack' OR vote2 = 'low_band' THEN 1 ELSE 0 END) AS fam, k % 4 AS sv,
  k / 50.0::DOUBLE AS ar, salience / 3 AS lf, least(1, ev_vocals) AS la, ev_drums AS ma, least(1, ev_other) AS ha, ev_drums / 2 AS sy FROM hits),
c AS (SELECT *, least(1, greatest(0, 0.30 / (1 + exp(greatest(-20, least(20, -10 * (pv - 0.49))))) + 0.24 / (1 + exp(greatest(-20, least(20, -14 * (pr - 0.165)))))
  + 0.22 * least(1, fam / 5.0::DOUBLE) + 0.14 * sv / 3.0::DOUBLE + 0.10 / (1 + exp(greatest(-20, least(20, -3.2 * (ar - 1.008))))))) AS conf FROM i WHERE ar >= 0.9)
SELECT id, round(conf, 6) AS confidence, round(least(1, 0.36 * conf + 0.28 * least(1, greatest(0, pv - lf) / 0.49 * 0.8) + 0.24 * greatest(la, ma, ha) + 0.12 * sy), 6) AS salience FROM c""")
def m2(spark, d):
    ev = F.col("evidence")
    rows = hits(spark, d).select(
        "id", F.col("salience").alias("peak_value"), F.col("confidence").alias("prominence"), "votes",
        (F.col("k") % 4).alias("scale_votes"), (F.col("k") / 50).alias("attack_ratio"),
        (F.col("salience") / 3).alias("local_floor"), clip(ev["vocals"]).alias("low_activation"),
        ev["drums"].alias("mid_activation"), clip(ev["other"]).alias("high_activation"),
        (ev["drums"] / 2).alias("synchronization"),
    )
    out = M.score_onsets(rows, 0.49, 0.165, 0.90, 0.0)
    return out.select("id", F.round("confidence", 6).alias("confidence"), F.round("salience", 6).alias("salience"))


M3_NAMES = ["low_share", "mid_share", "high_share", "synchronization", "broadband_strength", "spectral_entropy"]


@query("m3_band_evidence", f"""WITH {HITS}, {BANDS},
e AS (SELECT id, 0.58 * sub_low + 0.42 * low_mid AS rl, mid AS rm, 0.68 * high + 0.32 * air AS rh,
  greatest(sub_low * 2 / (sub_low * 2 + 1.75), low_mid * 2 / (low_mid * 2 + 1.75)) AS al, mid * 2 / (mid * 2 + 1.75) AS am,
  greatest(high * 2 / (high * 2 + 1.75), air * 2 / (air * 2 + 1.75)) AS ah FROM bands),
s AS (SELECT *, rl / greatest(rl + rm + rh, 1e-10) AS sl, rm / greatest(rl + rm + rh, 1e-10) AS sm, rh / greatest(rl + rm + rh, 1e-10) AS sh, greatest(al + am + ah, 1e-10) AS at_ FROM e),
m AS (SELECT *, 0.72 * sl + 0.28 * al / at_ AS ml, 0.72 * sm + 0.28 * am / at_ AS mm, 0.72 * sh + 0.28 * ah / at_ AS mh FROM s)
SELECT id, round(ml / greatest(ml + mm + mh, 1e-10), 6) AS low_share, round(mm / greatest(ml + mm + mh, 1e-10), 6) AS mid_share, round(mh / greatest(ml + mm + mh, 1e-10), 6) AS high_share,
  round(least(al, am, ah), 6) AS synchronization, round((al + am + ah) / 3, 6) AS broadband_strength,
  round(-(sl * ln(greatest(sl, 1e-10)) + sm * ln(greatest(sm, 1e-10)) + sh * ln(greatest(sh, 1e-10))) / ln(3), 6) AS spectral_entropy FROM m""")
def m3(spark, d):
    rows = bands(spark, d)
    rows = rows.withColumns({f"{b}_norm": F.col(b) * 2 for b in ("sub_low", "low_mid", "mid", "high", "air")})
    return M.band_evidence(rows).select("id", *[F.round(c, 6).alias(c) for c in M3_NAMES])


@query("m4_band_simple", f"""WITH {HITS} SELECT id, CASE WHEN ev_vocals >= greatest(ev_drums, ev_other) THEN 'low_hit'
  WHEN ev_other >= greatest(ev_drums, ev_vocals) THEN 'high_hit' ELSE 'mid_hit' END AS band FROM hits""")
def m4(spark, d):
    ev = F.col("evidence")
    return hits(spark, d).select("id", M.band_simple(ev["vocals"], ev["drums"], ev["other"]).alias("band"))


@query("m5_band_relative", f"""WITH {HITS}, {BANDS},
x AS (SELECT b.*, q.* EXCLUDE (track_id), up_s / greatest(low_s, 1e-10) AS ur, low_mid / greatest(sub_low, 1e-10) AS lmr,
  hi_s / greatest(low_s + up_s, 1e-10) AS fo, low_s / greatest(low_s + up_s, 1e-10) AS sh FROM bands b JOIN q USING (track_id))
SELECT id, CASE WHEN mid >= mid_floor AND hi_s >= high_floor AND mid >= hi_s * 0.38 AND (sh >= 0.55 OR (sh >= 0.34 AND low_s >= balanced_low)) THEN 'full_band_accent'
  WHEN mid >= mid_floor AND (lmr >= 0.38 OR ur >= 0.35) AND mid >= hi_s * 1.12 THEN 'mid_hit'
  WHEN ur <= 0.20 OR (up_s <= upper_floor * 1.08 AND lmr < 0.34) THEN 'low_hit'
  WHEN (ur >= 0.82 OR (hi_s >= mid * 2.0 AND fo >= 0.28)) AND low_s < low_high AND (fo >= 0.20 OR mid >= mid_floor) THEN 'high_hit'
  WHEN lmr >= 0.36 AND low_s < low_high AND mid >= mid_floor THEN 'mid_hit'
  WHEN low_s >= low_floor AND up_s >= upper_floor THEN 'full_band_accent' WHEN fo >= 0.25 THEN 'high_hit' WHEN lmr >= 0.40 THEN 'mid_hit' ELSE 'low_hit' END AS band FROM x""")
def m5(spark, d):
    return M.band_relative(bands(spark, d), ["track_id"]).select("id", "band")


@query("m6_chart_selection", f"""WITH {PLACED.replace('WITH ', '')}, {HITS},
j AS (SELECT h.*, p.bpm, p.beat_offset, 1 + 1 + 1 AS fam0, confidence + 0.28 * salience AS ls FROM hits h JOIN placed p ON p.id = h.id),
w AS (SELECT *, CASE WHEN vote2 IN ('energy_attack', 'low_band') THEN 3 ELSE 2 END AS fam, max(ls) OVER (PARTITION BY track_id ORDER BY pos RANGE BETWEEN 43200 PRECEDING AND 43200 FOLLOWING) AS top,
  60.0::DOUBLE / bpm AS beat FROM j),
r AS (SELECT id, CASE WHEN fam >= 4 AND confidence >= 0.48 THEN 'acoustic_anchor' WHEN confidence >= 0.58 AND salience >= 0.62 THEN 'strong_acoustic'
  WHEN fam >= 3 AND salience >= 0.70 THEN 'loud_acoustic' WHEN fam >= 3 AND confidence >= 0.48 AND ls >= 0.96 * top THEN 'local_standout'
  WHEN fam >= 3 AND confidence >= 0.34 AND least(
   abs(pos - (beat_offset + round_even((pos - beat_offset) / (beat / 2), 0) * (beat / 2))),
   abs(pos - (beat_offset + round_even((pos - beat_offset) / (beat / 3), 0) * (beat / 3))),
   abs(pos - (beat_offset + round_even((pos - beat_offset) / (beat / 4), 0) * (beat / 4)))) <= (300000 + 4.5 * greatest(0, least(1, (k / 100.0::DOUBLE - 0.72) / 0.14))) / 1000.0::DOUBLE THEN 'rhythm_rescue' END AS reason FROM w)
SELECT * FROM r WHERE reason IS NOT NULL""")
def m6(spark, d):
    rows = asof_segment(hits(spark, d), tempo(spark, d), TRACKS, "start_pos", ["bpm", "beat_offset"])
    rows = rows.withColumn("bpm_confidence", F.col("k") / 100)
    config = {**DEFAULTS, **PRESETS["balanced"], "rhythmic_rescue_tolerance_ms": 300_000.0}
    return M.select_chart(rows, TRACKS, RATE, config, rescue_window=12 * HOUR).select("id", "reason")


@query("m7_mora_score", f"""WITH {HITS}, x AS (SELECT id, least(1, ev_vocals) AS h, ev_drums / 4 AS e, confidence / 4 AS s, salience / 4 AS p, salience AS r,
  count(*) OVER (PARTITION BY track_id ORDER BY pos RANGE BETWEEN 43200 PRECEDING AND 43200 FOLLOWING) >= 4 AS dn FROM hits),
y AS (SELECT *, CASE WHEN dn THEN 0.55 * h + 0.15 * e + 0.15 * s + 0.05 * p + 0.10 * r ELSE 0.38 * h + 0.22 * e + 0.18 * s + 0.12 * p + 0.10 * r END AS sc FROM x)
SELECT id, round(sc, 8) AS score, CASE WHEN greatest(e, s, p) < CASE WHEN dn THEN 0.08 ELSE 0.14 END AND h < 0.75 THEN 'rejected'
  WHEN sc >= 0.42 THEN 'accepted' WHEN sc >= 0.28 THEN 'uncertain' ELSE 'rejected' END AS status FROM y""")
def m7(spark, d):
    from ..operators.sequences import density

    ev = F.col("evidence")
    rows = density(hits(spark, d), TRACKS, 12 * HOUR).withColumns({
        "phone_confidence": clip(ev["vocals"]), "energy": ev["drums"] / 4, "spectral": F.col("confidence") / 4,
        "pitch": F.col("salience") / 4, "rhythm": F.col("salience"),
    })
    return M.mora_score(rows, F.col("density") >= 4).select("id", F.round("score", 8).alias("score"), "status")


@query("m8_boundary_refinement", f"""WITH {STEM_FRAMES}, sp AS (SELECT vec_id AS track_id, vec_id AS span_id, label * 6000 + 317 AS raw, label * 6000 + 317 AS lo, label * 6000 + 4800 AS hi,
  label % 2 = 0 AS dn, label / 10.0::DOUBLE AS c FROM embeddings),
fr AS (SELECT track_id, frame_idx, least(1, vocals * 3) AS e, least(1, drums * 3) AS s, least(1, bass * 3) AS p FROM stem_frames),
o AS (SELECT sp.*, f.frame_idx * 1000 AS at_, 0 AS is_raw, e, s, p FROM sp JOIN fr f ON f.track_id = sp.track_id AND f.frame_idx * 1000 BETWEEN lo AND hi
  UNION ALL SELECT sp.*, raw, 1, e, s, p FROM sp JOIN fr f ON f.track_id = sp.track_id AND f.frame_idx = greatest(0, ceil(raw / 1000.0::DOUBLE - 0.5))),
r AS (SELECT *, row_number() OVER (PARTITION BY track_id, span_id ORDER BY round(CASE WHEN dn THEN 0.58 * c + 0.14 * e + 0.18 * s + 0.10 * p
  ELSE 0.34 * c + 0.24 * e + 0.27 * s + 0.15 * p END, 12) DESC, abs(at_ - raw), is_raw DESC, at_) AS rn FROM o)
SELECT b.track_id, b.span_id, b.raw, CASE WHEN greatest(b.e, b.s, b.p) >= CASE WHEN b.dn THEN 0.20 ELSE 0.32 END THEN b.at_ ELSE b.raw END AS refined FROM r b WHERE rn = 1""")
def m8(spark, d):
    label = F.col("label")
    spans = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("track_id"), F.col("vec_id").alias("span_id"), (label * 6000 + 317).alias("raw"),
        (label * 6000 + 317).alias("lower"), (label * 6000 + 4800).alias("upper"), (label % 2 == 0).alias("dense"),
        (label / 10).alias("confidence"),
    )
    curves = stem_frames(spark, d).select(
        "track_id", "frame_idx", clip(F.col("vocals") * 3).alias("energy"), clip(F.col("drums") * 3).alias("spectral"),
        clip(F.col("bass") * 3).alias("pitch"),
    )
    out = M.refine_boundary(spans, curves, ["track_id"], 1000)
    return out.select("track_id", "span_id", "raw", "refined")


@query("m9_anchor_confidence", f"""WITH {HITS}
SELECT id, round(least(0.94, greatest(0, (0.15 + 0.25 * exp(-abs(ln(greatest(k * 11.0::DOUBLE, 1) / 340)) * 0.24) + 0.38 * salience + 0.14 * confidence + 0.08 * ev_drums)
  * exp(-greatest(0, k * 6 - 100) / 520.0::DOUBLE) * (0.62 + 0.38 * ev_drums))), 6) AS confidence FROM hits""")
def m9(spark, d):
    rows = hits(spark, d).withColumns({
        "duration_ms": F.col("k") * 11.0, "shift_ms": F.col("k") * 6, "activity": F.col("salience"),
        "attack": F.col("confidence"), "acoustic_confidence": F.col("evidence")["drums"], "chunk_match": F.col("evidence")["drums"],
    })
    return rows.select("id", F.round(M.anchor_confidence(rows), 6).alias("confidence"))


FOCUS = """focus AS (SELECT track_id, pos AS s, pos + floor(score)::BIGINT * 200 - 5000 AS e, id AS idx,
  CASE WHEN id % 2 = 0 THEN 'vocals' ELSE 'drums' END AS source, score / 500 AS confidence, (id % 10) / 10.0::DOUBLE AS ve, (id % 7) / 7.0::DOUBLE AS va
  FROM points WHERE lane = 'signup' AND track_id % 3 > 0)"""


def focus(spark, d):
    i = F.col("id")
    return points(spark, d).filter("lane = 'signup' and track_id % 3 > 0").select(
        "track_id", F.col("pos").alias("start"), (F.col("pos") + F.floor("score") * 200 - 5000).alias("end"), i.alias("idx"),
        F.when(i % 2 == 0, "vocals").otherwise("drums").alias("source"), (F.col("score") / 500).alias("confidence"),
        ((i % 10) / 10).alias("vocal_evidence"), ((i % 7) / 7).alias("vocal_alternative"),
    )


ROUTED = f"""{FOCUS}, ok AS (SELECT * FROM focus WHERE e > s),
hit AS (SELECT p.id, min(f.idx) AS idx FROM points p LEFT JOIN ok f ON f.track_id = p.track_id AND p.pos >= f.s AND p.pos < f.e GROUP BY p.id),
routed AS (SELECT p.id, p.track_id, CASE WHEN f.idx IS NOT NULL THEN least(1, greatest(ve, va, CASE WHEN source = 'vocals' THEN confidence ELSE 0 END))
  WHEN p.track_id IN (SELECT track_id FROM ok) THEN 0.0 ELSE 0.5 END AS routing FROM points p JOIN hit h ON h.id = p.id LEFT JOIN ok f ON f.idx = h.idx)"""


@query("m10_routing_score", f"WITH {POINTS}, {ROUTED} SELECT id, round(routing, 6) AS routing FROM routed")
def m10(spark, d):
    out = M.routing_score(points(spark, d), focus(spark, d), TRACKS)
    return out.select("id", F.round("routing", 6).alias("routing"))


@query("m11_salience_scores", f"""WITH {HITS}
SELECT id, round(least(1, 0.14 + 0.39 * confidence + 0.23 * salience + 0.14 * ev_drums + 0.10 * 0.5), 6) AS hit, round(least(1, 0.20 + 0.42 * confidence + 0.23 * salience + 0.15 * ev_drums), 6) AS fallback,
  round(least(0.72, 0.18 + 0.25 * salience + 0.22 * ev_drums + 0.17 * confidence + 0.13 * 0.5 + 0.05 * least(1, ev_vocals)), 6) AS energy FROM hits""")
def m11(spark, d):
    c, s, ev = F.col("confidence"), F.col("salience"), F.col("evidence")
    return hits(spark, d).select(
        "id", F.round(M.hit_salience(c, s, ev["drums"], F.lit(0.5)), 6).alias("hit"),
        F.round(M.fallback_salience(c, s, ev["drums"]), 6).alias("fallback"),
        F.round(M.energy_confidence(s, ev["drums"], c, F.lit(0.5), ev["vocals"]), 6).alias("energy"),
    )


def _lane_sql():
    parts, ctes = [], []
    for i, (name, floor) in enumerate(M.LANE_FLOOR.items()):
        gap = round(250 * M.LANE_SPACING_MS[name])
        ctes.append(f"""g{i} AS (SELECT track_id, pos, id, confidence + 0.34 * salience + 0.08 * ev_drums AS q FROM hits WHERE primary_stem = '{name}'
  AND ('{name}' = 'mix' OR ev_vocals >= 0.035) AND (confidence >= {floor} OR salience >= least(0.92, {floor}::DOUBLE + 0.12::DOUBLE))),
""" + spacing_sql(f"g{i}", gap, "q").replace("so AS", f"so{i} AS").replace("sp AS", f"sp{i} AS").replace("FROM so ", f"FROM so{i} ")
            .replace("FROM sp s JOIN so o", f"FROM sp{i} s JOIN so{i} o").replace("FROM sp)", f"FROM sp{i})").replace("kept AS", f"kept{i} AS"))
        parts.append(f"SELECT id, '{name}' AS lane, 'soft_route_{name}' AS route FROM kept{i}")
    return ", ".join(ctes), " UNION ALL ".join(parts)


LANE_CTES, LANE_UNION = _lane_sql()


@query("m12_lane_gate", f"WITH RECURSIVE {HITS}, {LANE_CTES} {LANE_UNION}")
def m12(spark, d):
    rows = hits(spark, d).withColumns({
        "lane": F.col("primary_stem"), "activity": F.col("evidence")["vocals"], "prominence": F.col("evidence")["drums"],
    })
    out = M.soft_route(rows, TRACKS, 250.0)
    return out.select("id", "lane", F.element_at("votes", -1).alias("route"))


@query("m13_fallback_candidates", f"""WITH {POINTS}, {TILES}, failed AS (SELECT * FROM tiles WHERE status <> 'success'),
f1 AS (SELECT p.id, p.pos, f.track_id, f.idx, 'onset' AS level FROM points p JOIN failed f ON f.track_id = p.track_id AND p.pos >= f.s AND p.pos < f.e WHERE lane = 'error'),
f2 AS (SELECT p.id, p.pos, f.track_id, f.idx, 'energy' AS level FROM points p JOIN failed f ON f.track_id = p.track_id AND p.pos >= f.s AND p.pos < f.e WHERE lane = 'view'
  AND NOT EXISTS (SELECT 1 FROM f1 WHERE f1.track_id = f.track_id AND f1.idx = f.idx))
SELECT id, idx, level, (2 * (600 * 12 * 4 + ((2 * (pos - 600) * 48 + 60000) // 120000 * 60000)) + 48) // 96 AS chart
FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2) WHERE pos >= 600
UNION ALL SELECT id, idx, level, CASE WHEN abs(pos - 600) * 48 * 2 >= 60000 THEN -650 ELSE 600 END AS chart FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2) WHERE pos < 600""")
def m13(spark, d):
    p = points(spark, d)
    grid = Lattice(RATE, 0.012, 600)
    out = M.fallback_events(p.filter("lane = 'error'"), p.filter("lane = 'view'"), tiles(spark, d), TRACKS, grid)
    return out.select("id", "idx", "level", "chart")


@query("m14_long_vowel_split", f"""WITH {FRAMES}, {UNITS},
l AS (SELECT u.track_id, u.turn AS mora_idx, u.frame_idx AS phone_idx, u.turn * 500 AS base, x FROM units u JOIN frames f ON f.track_id = u.track_id AND f.frame_idx = u.frame_idx
  WHERE u.turn % 2 = 1 AND x > -0.2),
c AS (SELECT *, count(*) OVER (PARTITION BY track_id, mora_idx) AS n FROM l)
SELECT track_id, mora_idx, phone_idx, phone_idx * 700 AS split_at FROM c WHERE n >= 2 AND phone_idx % 3 < 2 AND least(1, abs(x) * 8) >= 0.20 AND least(1, abs(x) * 5) >= 0.35 AND phone_idx * 700 - base >= 40""")
def m14(spark, d):
    x, i = F.col("x"), F.col("frame_idx")
    phones = frames(spark, d).select(
        "track_id", i.alias("phone_idx"), F.when(i % 3 == 0, "a:").when(i % 3 == 1, "O").otherwise("k").alias("phoneme"),
        clip(F.abs(x) * 8).alias("confidence"), clip(F.abs(x) * 5).alias("pitch"), (i * 700).alias("refined"),
        (x > -0.2).alias("observed"),
    )
    moras = units(spark, d).select(
        "track_id", F.col("turn").alias("mora_idx"), F.when(F.col("turn") % 2 == 1, "sustain").otherwise("mora").alias("kind"),
        (F.col("turn") * 500).alias("refined"), F.col("indices").alias("phone_indices"),
    )
    return M.vowel_splits(moras, phones, ["track_id"], 40).select("track_id", "mora_idx", "phone_idx", "split_at")
