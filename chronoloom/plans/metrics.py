"""Evaluation, coverage and roll-up queries over the given tables."""

from pyspark.sql import functions as F

from ..operators import metrics as A
from ..operators import pyramid
from ..operators.projections import clip
from .joins import STEM_FRAMES, UNITS, greedy_match_sql, stem_frames, truth_and_prediction, units
from .lattice import PLACED
from .registry import ORACLES, query
from .views import DAY, FRAMES, HITS, HOUR, POINTS, RATE, TEMPO, TRACKS, frames, hits, points, table, tempo

WINDOWS = [HOUR, 4 * HOUR]


def f_sql(tp, fp, fn):
    p = f"(CASE WHEN {tp} + {fp} > 0 THEN {tp}::DOUBLE / ({tp} + {fp}) ELSE 1.0 END)"
    r = f"(CASE WHEN {tp} + {fn} > 0 THEN {tp}::DOUBLE / ({tp} + {fn}) ELSE 1.0 END)"
    return f"""round({p}, 6) AS precision, round({r}, 6) AS recall,
       CASE WHEN {p} + {r} > 0 THEN round(2 * {p} * {r} / ({p} + {r}), 6) ELSE 0.0 END AS f1"""


@query("a1_f_scores", f"""WITH {POINTS},
c AS (SELECT track_id, count(*) FILTER (lane = 'view') AS tp, count(*) FILTER (lane = 'click' AND score > 100) AS fp,
             count(*) FILTER (lane = 'error' AND score > 100) AS fn FROM points GROUP BY track_id)
SELECT track_id, {f_sql('tp', 'fp', 'fn')} FROM c""")
def a1(spark, d):
    p = points(spark, d)
    loud = F.col("score") > 100
    counts = p.groupBy("track_id").agg(
        F.count_if(F.col("lane") == "view").alias("tp"),
        F.count_if((F.col("lane") == "click") & loud).alias("fp"),
        F.count_if((F.col("lane") == "error") & loud).alias("fn"),
    )
    scores = A.f_scores(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select("track_id", *[c.alias(n) for n, c in scores.items()])


def tracks(spark, d):
    return points(spark, d).groupBy("track_id").agg(F.max("pos").alias("duration_sec"))


def block_sql(tag, window, tp_from, truth_count):
    return f"""SELECT track_id, {window} AS window, tp, fp, fn, {f_sql('tp', 'fp', 'fn')},
  round(med * 1000, 6) AS median_error_ms, round(p95 * 1000.0::DOUBLE, 6) AS p95_error_ms,
  round(fp / greatest(dur / 60.0::DOUBLE, 1 / 60.0::DOUBLE), 6) AS fp_per_minute,
  round(fn / greatest(dur / 60.0::DOUBLE, 1 / 60.0::DOUBLE), 6) AS fn_per_minute
FROM (SELECT s.track_id, s.dur, coalesce(m.tp, 0) AS tp, s.pn - coalesce(n.matched, 0) AS fp,
             s.{truth_count} - coalesce(m.tp, 0) AS fn, m.med, m.p95
      FROM sizes s LEFT JOIN (SELECT track_id, count(*) AS tp, quantile_cont(distance, 0.5) AS med,
                                     quantile_disc(distance, 0.95) AS p95 FROM {tp_from} GROUP BY track_id) m USING (track_id)
      LEFT JOIN (SELECT track_id, count(*) AS matched FROM matches{tag} GROUP BY track_id) n USING (track_id))"""


SIZES = """sizes AS (SELECT track_id, max(pos) AS dur, count(*) FILTER (lane = 'purchase') AS tn,
  count(*) FILTER (lane = 'click') AS pn, count(*) FILTER (lane = 'purchase' AND score >= 50) AS sn FROM points GROUP BY track_id)"""


@query("a2_event_metrics", f"""WITH RECURSIVE {POINTS}, {SIZES}, {greedy_match_sql(WINDOWS[0], '1')}, {greedy_match_sql(WINDOWS[1], '2')}
{block_sql('1', WINDOWS[0], 'matches1', 'tn')} UNION ALL {block_sql('2', WINDOWS[1], 'matches2', 'tn')}""")
def a2(spark, d):
    truth, predicted = truth_and_prediction(spark, d)
    return A.event_metrics(truth, predicted, tracks(spark, d), TRACKS, WINDOWS, RATE)


STRONG = "(SELECT m.* FROM matches2 m JOIN points p ON p.id = m.truth_idx AND p.score >= 50)"


@query("a3_strong_metrics", f"""WITH RECURSIVE {POINTS}, {SIZES}, {greedy_match_sql(WINDOWS[1], '2')}
{block_sql('2', WINDOWS[1], STRONG, 'sn')}""")
def a3(spark, d):
    truth, predicted = truth_and_prediction(spark, d)
    return A.strong_metrics(truth, predicted, tracks(spark, d), TRACKS, [WINDOWS[1]], RATE, 50.0)


def anchors_sql(window, source="points", key="track_id"):
    """Recursive fold: next anchor is the first position beyond the window."""
    return f"""ordered AS (SELECT {key}, pos, row_number() OVER (PARTITION BY {key} ORDER BY pos) AS rn
  FROM (SELECT DISTINCT {key}, pos FROM {source})),
fold AS (SELECT {key}, rn, pos, pos AS anchor FROM ordered WHERE rn = 1
  UNION ALL SELECT o.{key}, o.rn, o.pos, CASE WHEN o.pos - f.anchor > {window} THEN o.pos ELSE f.anchor END
  FROM fold f JOIN ordered o ON o.{key} = f.{key} AND o.rn = f.rn + 1)"""


@query("a4_duplicate_clusters", f"""WITH RECURSIVE {POINTS}, {anchors_sql(6 * HOUR)}
SELECT p.track_id, p.n - a.n AS duplicates FROM (SELECT track_id, count(*) AS n FROM points GROUP BY track_id) p
JOIN (SELECT track_id, count(*) AS n FROM fold WHERE pos = anchor GROUP BY track_id) a USING (track_id)""")
def a4(spark, d):
    return A.duplicate_count(points(spark, d), TRACKS, 6 * HOUR)


@query("a5_cell_jaccard", f"""WITH {POINTS},
t AS (SELECT DISTINCT track_id, round_even((pos - 500) / 20000.0::DOUBLE, 0)::BIGINT AS c FROM points WHERE lane = 'purchase'),
p AS (SELECT DISTINCT track_id, round_even((pos - 500) / 20000.0::DOUBLE, 0)::BIGINT AS c FROM points WHERE lane = 'click'),
j AS (SELECT coalesce(t.track_id, p.track_id) AS track_id, count(*) FILTER (t.c IS NOT NULL AND p.c IS NOT NULL) AS correct,
  count(*) FILTER (t.c IS NULL) AS extra, count(*) FILTER (p.c IS NULL) AS missing
  FROM t FULL OUTER JOIN p ON t.track_id = p.track_id AND t.c = p.c GROUP BY 1)
SELECT track_id, correct, extra, missing, round(correct::DOUBLE / (correct + extra + missing), 6) AS accuracy,
  {f_sql('correct', 'extra', 'missing')} FROM j""")
def a5(spark, d):
    truth, predicted = truth_and_prediction(spark, d)
    width = F.lit(RATE * 60.0) / F.lit(0.00075) / 4
    return A.cell_accuracy(truth, predicted, ["track_id"], "pos", width, F.lit(500))


@query("a6_tempo_error", f"""WITH {POINTS}, {TEMPO},
x AS (SELECT track_id, max_by(bpm, start_pos) AS eb, max_by(beat_offset, start_pos) AS eo, min_by(bpm, start_pos) AS b,
             min_by(beat_offset, start_pos) AS o FROM tempo GROUP BY track_id)
SELECT track_id, round(abs(eb - b), 6) AS absolute_error, round(abs(eb - b) / eb, 6) AS relative_error,
       round(abs(o - eo) * 1000.0::DOUBLE, 6) AS offset_error_ms FROM x""")
def a6(spark, d):
    by_track = tempo(spark, d).groupBy("track_id")
    expected = by_track.agg(
        F.max_by("bpm", "start_pos").alias("expected_bpm"), F.max_by("beat_offset", "start_pos").alias("expected_offset")
    )
    estimated = by_track.agg(
        F.min_by("bpm", "start_pos").alias("estimated_bpm"), F.min_by("beat_offset", "start_pos").alias("estimated_offset")
    )
    return A.tempo_error(expected, estimated, ["track_id"], RATE)


MEASURES = ["tp", "fp", "fn", "precision", "recall", "f1", "median_error_ms", "p95_error_ms", "fp_per_minute", "fn_per_minute"]


def long_sql(part, window, measures, rows):
    names, values = ", ".join(f"'{m}'" for m in measures), ", ".join(f"{m}::DOUBLE" for m in measures)
    return f"SELECT track_id, '{part}' AS part, {window}::BIGINT AS window, unnest([{names}]) AS measure, unnest([{values}]) AS value FROM ({rows})"


def report_sql():
    weak = ORACLES["a5_cell_jaccard"].split("SELECT track_id, correct", 1)
    tempo_rows = ORACLES["a6_tempo_error"].split("SELECT track_id, round(abs(eb - b), 6)", 1)
    blocks = []
    for tag, window in (("1", WINDOWS[0]), ("2", WINDOWS[1])):
        blocks.append(long_sql("all", window, MEASURES, block_sql(tag, window, f"matches{tag}", "tn")))
        blocks.append(long_sql("strong", window, MEASURES, block_sql(tag, window, STRONG.replace("matches2", f"matches{tag}"), "sn")))
    blocks.append(long_sql("grid", "NULL", ["correct", "extra", "missing", "accuracy", "precision", "recall", "f1"], "SELECT track_id, correct" + weak[1]))
    blocks.append(long_sql("tempo", "NULL", ["absolute_error", "relative_error", "offset_error_ms"], "SELECT track_id, round(abs(eb - b), 6)" + tempo_rows[1]))
    doubled = "SELECT p.track_id, p.n - a.n AS duplicates FROM (SELECT track_id, count(*) AS n FROM clicks GROUP BY 1) p JOIN (SELECT track_id, count(*) AS n FROM fold WHERE pos = anchor GROUP BY 1) a USING (track_id)"
    blocks.append(long_sql("duplicates", "NULL", ["duplicates"], doubled))
    blocks.append(long_sql("missing", "NULL", ["truths"], "SELECT track_id, tn AS truths FROM sizes WHERE tn > 0 AND pn = 0"))
    parts = [
        "WITH RECURSIVE " + POINTS, TEMPO, SIZES, greedy_match_sql(WINDOWS[0], "1"), greedy_match_sql(WINDOWS[1], "2"),
        "clicks AS (SELECT * FROM points WHERE lane = 'click')", anchors_sql(6 * HOUR, "clicks"),
        weak[0].split(POINTS + ",", 1)[1].strip(), tempo_rows[0].split(TEMPO + ",", 1)[1].strip(),
    ]
    return ", ".join(parts) + "\n" + " UNION ALL ".join(blocks)


@query("a2_evaluation_report", report_sql())
def report(spark, d):
    truth, predicted = truth_and_prediction(spark, d)
    by_track = tempo(spark, d).groupBy("track_id")
    expected = by_track.agg(
        F.max_by("bpm", "start_pos").alias("expected_bpm"), F.max_by("beat_offset", "start_pos").alias("expected_offset")
    )
    estimated = by_track.agg(
        F.min_by("bpm", "start_pos").alias("estimated_bpm"), F.min_by("beat_offset", "start_pos").alias("estimated_offset")
    )
    return A.evaluation_report(
        truth, predicted, tracks(spark, d), expected, estimated, TRACKS, windows=WINDOWS, rate=RATE, threshold=50.0,
        duplicate_window=6 * HOUR, cell_width=F.lit(RATE * 60.0) / F.lit(0.00075) / 4, offset=F.lit(500),
    )


@query("a7_project_summary", f"""WITH {POINTS}, {TEMPO}
SELECT c.c_custkey AS project_id, c.c_name AS title, t.track_id, coalesce(f.bpm, t.est) AS bpm, t.dur AS duration_sec,
       coalesce(h.n, 0) AS hit_count, t.mode
FROM customer c
LEFT JOIN (SELECT track_id, round(avg(score), 3) / 1000 AS est, max(pos) AS dur, max(lane) AS mode FROM points
           WHERE lane <> 'signup' GROUP BY track_id) t ON t.track_id = c.c_custkey
LEFT JOIN (SELECT track_id, count(*) AS n FROM points WHERE lane = 'view' GROUP BY track_id) h ON h.track_id = t.track_id
LEFT JOIN (SELECT track_id, min_by(bpm, start_pos) AS bpm FROM tempo GROUP BY track_id) f ON f.track_id = t.track_id""")
def a7(spark, d):
    p = points(spark, d)
    songs = p.filter("lane <> 'signup'").groupBy("track_id").agg(
        (F.round(F.avg("score"), 3) / 1000).alias("estimated_bpm"), F.max("pos").alias("duration_sec"),
        F.max("lane").alias("mode"),
    ).withColumn("project_id", F.col("track_id"))
    owners = table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("title"))
    return A.project_summary(owners, songs, p.filter("lane = 'view'"), tempo(spark, d))


@query("a8_selection_stats", f"""WITH {HITS}
SELECT track_id, count(*) FILTER (primary_stem = 'vocals') AS vocals, count(*) FILTER (primary_stem = 'drums') AS drums,
  count(*) FILTER (primary_stem = 'bass') AS bass, count(*) FILTER (primary_stem = 'other') AS other,
  count(*) FILTER (primary_stem = 'mix') AS mix, count(*) FILTER (primary_stem = 'piano') AS piano, count(*) AS total
FROM hits GROUP BY track_id""")
def a8(spark, d):
    return A.counts_by(hits(spark, d), ["track_id"], "primary_stem", ["vocals", "drums", "bass", "other", "mix", "piano"])


TILES = """tiles AS (
  SELECT track_id, pos // 86400 AS idx, pos // 86400 * 86400 AS s, pos // 86400 * 86400 + 86400 AS e, count(*) AS n,
         CASE count(*) % 4 WHEN 0 THEN 'silent' WHEN 1 THEN 'alignment_failed' WHEN 2 THEN 'success' ELSE 'ok' END AS status
  FROM points GROUP BY track_id, pos // 86400)"""


def tiles(spark, d):
    """Days of a track with a status derived from their row count."""
    day = F.floor(F.col("pos") / DAY)
    left = F.col("n") % 4
    return (
        points(spark, d).groupBy("track_id", day.alias("idx")).agg(F.count("*").alias("n"))
        .select(
            "track_id", "idx", (F.col("idx") * DAY).alias("start"), ((F.col("idx") + 1) * DAY).alias("end"), "n",
            F.when(left == 0, "silent").when(left == 1, "alignment_failed").when(left == 2, "success")
            .otherwise("ok").alias("status"),
        )
    )


@query("a9_chunk_summary", f"""WITH {POINTS}, {TILES}
SELECT track_id, status, count(*) AS chunks, sum(CASE WHEN status <> 'success' THEN e - s ELSE 0 END)::BIGINT AS uncovered
FROM tiles GROUP BY track_id, status""")
def a9(spark, d):
    return A.chunk_summary(tiles(spark, d), ["track_id"])


@query("a9_regions_with_events", f"""WITH {POINTS}, {TILES}
SELECT t.track_id, count(*) AS regions, count(*) FILTER (EXISTS (SELECT 1 FROM points p WHERE p.lane = 'error'
   AND p.track_id = t.track_id AND p.pos >= t.s AND p.pos < t.e)) AS filled FROM tiles t GROUP BY t.track_id""")
def a9_regions(spark, d):
    events = points(spark, d).filter("lane = 'error'")
    marked = A.regions_with_events(tiles(spark, d), events, TRACKS, "start", "end")
    return marked.groupBy("track_id").agg(F.count("*").alias("regions"), F.count_if("has_event").alias("filled"))


@query("a10_line_coverage", f"""WITH {POINTS}, {TILES},
m AS (SELECT t.*, idx AS l0, idx + n AS l1, EXISTS (SELECT 1 FROM points p WHERE p.lane = 'error' AND p.track_id = t.track_id
   AND p.pos >= t.s AND p.pos < t.e) AS has FROM tiles t),
lines AS (SELECT track_id, line, bool_or(has AND CASE WHEN idx % 2 = 0 THEN status = 'success' ELSE status = 'ok' END) AS ok
  FROM (SELECT *, unnest(range(greatest(l0, 0), greatest(l0, l1))) AS line FROM m) GROUP BY track_id, line)
SELECT track_id, n_lines, count(line) AS assigned, count(*) FILTER (ok) AS covered, n_lines - count(*) FILTER (ok) AS uncovered,
  round(count(*) FILTER (ok) / n_lines::DOUBLE * 100, 3) AS coverage_pct
FROM (SELECT track_id, max(l1) AS n_lines FROM m GROUP BY track_id) LEFT JOIN lines USING (track_id) GROUP BY track_id, n_lines""")
def a10(spark, d):
    chunks = tiles(spark, d)
    diagnostics = chunks.select(
        "track_id", "idx", "start", "end", F.col("idx").alias("line_start"),
        (F.col("idx") + F.col("n")).alias("line_end"), "status", F.col("status").alias("alignment_status"),
    )
    explicit = chunks.filter("idx % 2 = 0").select("track_id", "idx", F.col("status").alias("chunk_status"))
    phrases = chunks.groupBy("track_id").agg(F.max(F.col("idx") + F.col("n")).cast("bigint").alias("n_lines"))
    return A.line_coverage(phrases, diagnostics, explicit, points(spark, d).filter("lane = 'error'"), TRACKS)


RUNS = """active AS (SELECT track_id, pos FROM points WHERE lane IN ('view', 'click')),
ev AS (SELECT DISTINCT track_id, pos AS at FROM points WHERE lane = 'error'),
dist AS (SELECT a.track_id, a.pos, least(a.pos - l.at, r.at - a.pos) AS distance FROM active a
  ASOF LEFT JOIN ev l ON a.track_id = l.track_id AND a.pos >= l.at
  ASOF LEFT JOIN ev r ON a.track_id = r.track_id AND a.pos <= r.at)"""


def runs_sql(source, tag):
    return f"""r1{tag} AS (SELECT *, pos - lag(pos) OVER (PARTITION BY track_id ORDER BY pos) AS g FROM {source}),
r2{tag} AS (SELECT *, sum(CASE WHEN g IS NULL OR g > 54000 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY pos) AS run FROM r1{tag}),
runs{tag} AS (SELECT track_id, run, min(pos) - 18000 AS s, max(pos) + 18000 AS e, count(*) AS frames FROM r2{tag} GROUP BY track_id, run)"""


HOP = 10 * HOUR


@query("w9_contiguous_runs", f"""WITH {POINTS}, {RUNS}, {runs_sql('active', '')}
SELECT track_id, s AS start, e AS "end", frames FROM runs""")
def w9(spark, d):
    active = points(spark, d).filter("lane in ('view', 'click')")
    return A.runs(active, TRACKS, HOP).select("track_id", "start", "end", "frames")


@query("a11_active_coverage", f"""WITH {POINTS}, {RUNS}, {runs_sql('active', '')},
sec AS (SELECT *, EXISTS (SELECT 1 FROM ev WHERE ev.track_id = runs.track_id AND ev.at BETWEEN s - 7200 AND e + 7200) AS hit
        FROM runs WHERE frames * 36000 >= 72000)
SELECT f.*, coalesce(s.sections, 0) AS sections, coalesce(s.covered_sections, 0) AS covered_sections,
   round(s.covered_sections / s.sections::DOUBLE * 100, 3) AS section_pct FROM (
  SELECT track_id, count(*) AS active_frames, round(avg((coalesce(distance <= 7200, false))::INT) * 100, 3) AS near_pct,
    round(avg((coalesce(distance <= 14400, false))::INT) * 100, 3) AS far_pct,
    round(count(*) FILTER (NOT coalesce(distance <= 7200, false)) * 36000.0::DOUBLE, 3) AS uncovered_sec,
    round(quantile_cont(distance, 0.95), 3) AS nearest_p95_sec FROM dist GROUP BY track_id) f
LEFT JOIN (SELECT track_id, count(*) AS sections, count(*) FILTER (hit) AS covered_sections FROM sec GROUP BY track_id) s USING (track_id)""")
def a11(spark, d):
    p = points(spark, d)
    return A.coverage_metrics(
        p.filter("lane in ('view', 'click')"), p.filter("lane = 'error'"), TRACKS, RATE, HOP,
        near_sec=7200, far_sec=14_400, section_sec=72_000,
    )


@query("o3_longest_uncovered_runs", f"""WITH {POINTS}, {RUNS}, far AS (SELECT track_id, pos FROM dist WHERE distance IS NULL OR distance > 7200),
{runs_sql('far', '')}
SELECT track_id, s AS start, e AS "end", frames, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frames DESC, s) AS rank FROM runs) WHERE rank <= 8""")
def o3(spark, d):
    p = points(spark, d)
    found = A.uncovered_runs(p.filter("lane in ('view', 'click')"), p.filter("lane = 'error'"), TRACKS, HOP, 7200)
    return A.longest_runs(found, ["track_id"]).select("track_id", "start", "end", "frames", "rank")


TOKENS = f"""tokens AS (SELECT track_id, id AS idx, pos - (k * 977) % 40000 AS s,
  pos - (k * 977) % 40000 + (k - 3) * 60 AS e, k FROM hits)"""


def tokens(spark, d):
    k = F.col("k")
    start = F.col("pos") - k * 977 % 40_000
    return hits(spark, d).select(
        "track_id", F.col("id").alias("idx"), start.alias("start"), (start + (k - 3) * 60).alias("end"), "k"
    )


STABILITY = f"""{HITS}, {TOKENS},
o AS (SELECT *, lag(s) OVER (PARTITION BY track_id ORDER BY idx) AS ps FROM tokens),
u AS (SELECT track_id, s, s - lag(s) OVER (PARTITION BY track_id ORDER BY s) AS g FROM (SELECT DISTINCT track_id, s FROM tokens)),
st AS (SELECT track_id, n, reversed, n - different AS duplicates, dense, invalid FROM (
  SELECT track_id, count(*) AS n, count(*) FILTER (s < ps) AS reversed, count(DISTINCT (s, e)) AS different,
    count(*) FILTER (e < s OR s < 0 OR e > length) AS invalid FROM o JOIN (SELECT track_id, max(pos) + 1 AS length FROM hits GROUP BY track_id) USING (track_id) GROUP BY track_id)
  JOIN (SELECT track_id, count(*) FILTER (g > 0 AND g < 1800) AS dense FROM u GROUP BY track_id) USING (track_id)),
stable AS (SELECT *, round(greatest(0, least(1, 1 - (0.35::DOUBLE * reversed / n + 0.30::DOUBLE * duplicates / n + 0.15::DOUBLE * dense / n
  + 0.20::DOUBLE * invalid / n))), 6) AS stability FROM st)"""

# the dense threshold is 5 ms: read the second-sized positions as 360 kHz samples
STABILITY_RATE = 360_000


def stable(spark, d):
    lengths = hits(spark, d).groupBy("track_id").agg((F.max("pos") + 1).alias("length"))
    rows = A.attach(tokens(spark, d), lengths, ["track_id"])
    return A.stability(rows, ["track_id"], STABILITY_RATE, F.col("length"), 2 * DAY, 4096)


@query("a12_sequence_stability", f"WITH {STABILITY} SELECT * FROM stable")
def a12(spark, d):
    return stable(spark, d)


RHYTHM = """rhythm AS (SELECT track_id, round(avg(exp(-pow(dist / (step / 2), 2))), 6) AS rhythm,
    round(avg(dist * 1000), 6) AS mean_distance_ms
  FROM (SELECT *, abs(pos - (beat_offset + round_even((pos - beat_offset) / step, 0) * step)) AS dist
        FROM (SELECT *, 60.0::DOUBLE / bpm / 4 AS step FROM placed)) GROUP BY track_id)"""


@query("a13_rhythm_score", f"WITH {PLACED}, {RHYTHM} SELECT * FROM rhythm")
def a13(spark, d):
    return A.rhythm_agg(points(spark, d), tempo(spark, d), TRACKS, RATE)


HIERARCHY = """per_unit AS (SELECT track_id, turn, bool_and(x > -0.2) AS full, avg(least(1, abs(x) * 4)) FILTER (x > -0.2) AS conf
  FROM units JOIN frames USING (track_id, frame_idx) GROUP BY track_id, turn),
cov AS (SELECT track_id, count(*) AS units, count(*) FILTER ("full") AS forced,
  count(*) FILTER ("full" AND conf >= 0.2) AS aligned FROM per_unit GROUP BY track_id)"""


def phones(spark, d):
    return frames(spark, d).select(
        "track_id", "frame_idx", (F.col("x") > -0.2).alias("observed"), clip(F.abs("x") * 4).alias("confidence")
    )


def covered_units(spark, d):
    owned = units(spark, d).join(
        frames(spark, d).select("track_id").distinct(), "track_id", "left_semi"
    )
    return A.hierarchy_coverage(owned, phones(spark, d), ["track_id"], "indices", "frame_idx")


@query("a16_hierarchy_coverage", f"""WITH {FRAMES}, {UNITS}, {HIERARCHY}
SELECT *, round(aligned / units::DOUBLE, 6) AS coverage, round(forced / units::DOUBLE, 6) AS forced_coverage FROM cov""")
def a16(spark, d):
    return covered_units(spark, d)


CONSISTENCY = """consistent AS (SELECT track_id, round(greatest(0, least(1, avg(0.45 * least(1, vocals * 4) + 0.25 * drums + 0.20 * bass + 0.10 * other))), 6) AS consistency
  FROM stem_frames GROUP BY track_id)"""


def consistency(spark, d):
    return A.acoustic_consistency(
        stem_frames(spark, d), ["track_id"], clip(F.col("vocals") * 4), F.col("drums"), F.col("bass"), F.col("other")
    )


@query("a17_acoustic_consistency", f"WITH {STEM_FRAMES}, {CONSISTENCY} SELECT * FROM consistent")
def a17(spark, d):
    return consistency(spark, d)


@query("a14_alignment_report", f"""WITH {PLACED}, {RHYTHM}, {STABILITY}, {FRAMES}, {UNITS}, {HIERARCHY}, {STEM_FRAMES}, {CONSISTENCY}
SELECT t.track_id, coalesce(c.aligned / c.units::DOUBLE, 0) AS coverage, coalesce(a.consistency, 0) AS acoustic,
  coalesce(r.rhythm, 0) AS rhythm, coalesce(s.stability, 0) AS stability,
  round(greatest(0, least(1, 0.35 * coalesce(round(c.aligned / c.units::DOUBLE, 6), 0) + 0.30 * coalesce(a.consistency, 0)
    + 0.20 * coalesce(r.rhythm, 0) + 0.15 * coalesce(s.stability, 0))), 10) AS score
FROM (SELECT DISTINCT track_id FROM points) t LEFT JOIN cov c USING (track_id) LEFT JOIN consistent a USING (track_id)
LEFT JOIN rhythm r USING (track_id) LEFT JOIN stable s USING (track_id)""".replace(
    "coalesce(c.aligned / c.units::DOUBLE, 0) AS coverage", "coalesce(round(c.aligned / c.units::DOUBLE, 6), 0) AS coverage"))
def a14(spark, d):
    return A.alignment_report(
        points(spark, d), covered_units(spark, d),
        consistency(spark, d).withColumnRenamed("consistency", "acoustic"),
        A.rhythm_agg(points(spark, d), tempo(spark, d), TRACKS, RATE), stable(spark, d), ["track_id"],
        digits=10,  # the parts have six decimals, so their mix has exact ties at six
    )


@query("a15_method_comparison", """
WITH r AS (SELECT o_custkey AS track_id, o_orderpriority AS method, o_orderkey AS run_id, o_orderstatus AS status, o_orderdate,
  row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders),
rep AS (SELECT l_orderkey AS run_id, count(*) AS tokens, round(avg(l_discount), 6) AS score FROM lineitem GROUP BY l_orderkey)
SELECT track_id, method, run_id, status, CASE WHEN status = 'F' THEN 'failed' END AS error, tokens, score
FROM r LEFT JOIN rep USING (run_id) WHERE rn = 1""")
def a15(spark, d):
    all_runs = table(spark, d, "orders").select(
        F.col("o_custkey").alias("track_id"), F.col("o_orderpriority").alias("method"),
        F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), "o_orderdate",
        F.when(F.col("o_orderstatus") == "F", "failed").alias("error"),
    )
    reports = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(
        F.count("*").alias("tokens"), F.round(F.avg("l_discount"), 6).alias("score")
    )
    return A.compare_methods(all_runs, reports, ["track_id"], ["o_orderdate", "run_id"]).drop("o_orderdate")


@query("a18_stage_timings", f"""WITH {POINTS},
c AS (SELECT *, lag(lane) OVER w AS prev FROM points WINDOW w AS (PARTITION BY track_id ORDER BY pos, id)),
g AS (SELECT track_id, id, lane AS stage, pos AS started FROM c WHERE prev IS NULL OR prev <> lane)
SELECT *, (lead(started) OVER (PARTITION BY track_id ORDER BY started, id) - started) * 1000.0::DOUBLE AS duration_ms FROM g""")
def a18(spark, d):
    return A.stage_timings(points(spark, d), TRACKS, "lane")


@query("a19_chunk_status", f"""WITH {HITS}, {POINTS}, {TILES},
diag AS (SELECT track_id, idx, s, e, n, CASE n % 7 WHEN 0 THEN 'silent' WHEN 5 THEN 'asr_error' ELSE 'ok' END AS status,
  CASE n % 5 WHEN 0 THEN NULL WHEN 4 THEN 'failed' ELSE 'ok' END AS astatus, n / 5.0::DOUBLE AS match FROM tiles),
raw AS (SELECT track_id, pos // 86400 AS idx, count(*) AS c FROM hits WHERE primary_stem <> 'mix' GROUP BY 1, 2),
anc AS (SELECT track_id, pos // 86400 AS idx, count(*) AS c, avg(confidence * 4) AS conf FROM hits WHERE k > 20 AND primary_stem <> 'bass' GROUP BY 1, 2),
j AS (SELECT d.*, coalesce(raw.c, 0) AS rc, coalesce(anc.c, 0) AS ac, coalesce(anc.conf, 0) AS aconf FROM diag d
  LEFT JOIN raw USING (track_id, idx) LEFT JOIN anc USING (track_id, idx))
SELECT track_id, idx, s * 2 AS start, e * 2 AS "end", CASE WHEN status = 'silent' THEN 'silent' WHEN status <> 'ok' THEN 'asr_failed'
  WHEN astatus IS NULL THEN 'unassigned' WHEN astatus <> 'ok' THEN 'alignment_failed' WHEN match < 0.28 THEN 'low_confidence'
  WHEN rc > 0 AND ac = 0 THEN 'alignment_collapse' WHEN ac < 2 THEN 'insufficient_anchors'
  WHEN least(match, aconf) < 0.28 THEN 'low_confidence' ELSE 'success' END AS status,
  round(greatest(0, least(1, least(match, aconf))), 6) AS confidence, ac AS anchor_count, rc AS raw_count FROM j""")
def a19(spark, d):
    n = F.col("n")
    diagnostics = tiles(spark, d).select(
        "track_id", "idx", "start", "end",
        F.when(n % 7 == 0, "silent").when(n % 7 == 5, "asr_error").otherwise("ok").alias("status"),
        F.when(n % 5 == 0, None).when(n % 5 == 4, "failed").otherwise("ok").alias("alignment_status"),
        (n / 5).alias("match_confidence"),
    )
    rows = hits(spark, d).withColumn("idx", F.floor(F.col("pos") / DAY))
    anchors = rows.select(
        "track_id", "idx", (F.col("confidence") * 4).alias("confidence"), (F.col("k") > 20).alias("active"),
        (F.col("primary_stem") != "bass").alias("chart_candidate"),
    )
    return A.chunk_coverage(
        diagnostics, rows.filter("primary_stem <> 'mix'"), anchors, ["track_id"], remap=lambda pos: pos * 2
    )


@query("a20_chunk_activity", f"""WITH {FRAMES}, q AS (SELECT track_id, quantile_cont(abs(x), 0.9) AS hi, quantile_cont(abs(x), 0.2) AS lo FROM frames GROUP BY track_id),
f AS (SELECT track_id, greatest(pow(10, -55 / 20.0::DOUBLE), greatest(hi, 1e-9) * 0.02, least(greatest(lo, 1e-9) * 4, greatest(hi, 1e-9) * 0.25)) AS floor FROM q),
r AS (SELECT track_id, frame_idx // 8 AS chunk, round(avg((abs(x) >= floor)::INT), 6) AS active_ratio FROM frames JOIN f USING (track_id) GROUP BY 1, 2)
SELECT *, active_ratio < 0.02 AS silent FROM r""")
def a20(spark, d):
    level = frames(spark, d).select(
        "track_id", F.abs("x").alias("rms"), F.floor(F.col("frame_idx") / 8).alias("chunk")
    )
    return A.chunk_activity(level, ["track_id"], "rms", "chunk")


@query("a21_rejection_funnel", f"""WITH {HITS},
t AS (SELECT track_id, CASE WHEN k < 8 THEN 'chunk_match' WHEN k * 2 < 30 THEN 'short' WHEN acoustic IS NULL OR confidence < 0.02 THEN 'silent'
  WHEN salience < 0.25 AND confidence < 0.1 THEN 'weak_attack' WHEN confidence * 4 < 0.34 THEN 'low_confidence' ELSE 'accepted' END AS reason
  FROM (SELECT * FROM hits))
SELECT track_id, reason, count(*) AS n FROM t GROUP BY 1, 2""")
def a21(spark, d):
    k = F.col("k")
    rows = hits(spark, d).select(
        "track_id", (k * 0.035 + 0.01).alias("chunk_match"), (k * 2.0).alias("duration_ms"),
        F.col("acoustic").alias("active_start"), F.col("confidence").alias("rms"), F.lit(0.02).alias("activity_floor"),
        (F.col("salience") * 0.32).alias("activity"), (F.col("confidence") * 1.6).alias("attack"),
        (F.col("confidence") * 4).alias("confidence"),
    )
    return A.rejection_stats(rows, ["track_id"], A.anchor_rejections())


@query("a22_span_rollup", f"""WITH {HITS}
SELECT track_id, pos // 86400 AS unit, min(detected) AS aligned_start, max(detected + k) AS aligned_end, min(refined) AS refined_start,
  max(refined + 2 * k) AS refined_end, round(avg(confidence), 9) AS confidence, round(max(ev_vocals), 9) AS energy,
  round(max(ev_drums), 9) AS spectral_change, round(max(ev_other), 9) AS pitch_change FROM hits GROUP BY 1, 2""")
def a22(spark, d):
    children = hits(spark, d).select(
        "track_id", F.floor(F.col("pos") / DAY).alias("unit"), F.col("detected").alias("aligned_start"),
        (F.col("detected") + F.col("k")).alias("aligned_end"), F.col("refined").alias("refined_start"),
        (F.col("refined") + 2 * F.col("k")).alias("refined_end"), "confidence",
        F.col("evidence")["vocals"].alias("energy"), F.col("evidence")["drums"].alias("spectral_change"),
        F.col("evidence")["other"].alias("pitch_change"),
    )
    out = A.span_rollup(children, ["track_id", "unit"])
    names = ("confidence", "energy", "spectral_change", "pitch_change")
    return out.withColumns({c: F.round(c, 9) for c in names})


BANDS = """bands AS (SELECT track_id, id, ev_vocals AS sub_low, ev_drums AS low_mid, ev_other AS mid, salience AS high, confidence AS air,
  ev_vocals + 0.65 * ev_drums AS low_s, ev_other + 0.65 * salience + 0.35 * confidence AS up_s, 0.65 * salience + 0.35 * confidence AS hi_s FROM hits),
q AS (SELECT track_id, quantile_cont(low_s, 0.24) AS low_floor, quantile_cont(low_s, 0.76) AS low_high,
  CASE WHEN count(*) >= 12 THEN quantile_cont(low_s, 0.82) ELSE quantile_cont(low_s, 0.24) END AS balanced_low,
  quantile_cont(up_s, 0.24) AS upper_floor, quantile_cont(mid, 0.30) AS mid_floor, quantile_cont(hi_s, 0.30) AS high_floor
  FROM bands GROUP BY track_id)"""
QUANTILES = ("low_floor", "low_high", "balanced_low", "upper_floor", "mid_floor", "high_floor")


def bands(spark, d):
    ev = F.col("evidence")
    return hits(spark, d).select(
        "track_id", "id", ev["vocals"].alias("sub_low"), ev["drums"].alias("low_mid"), ev["other"].alias("mid"),
        F.col("salience").alias("high"), F.col("confidence").alias("air"),
    )


@query("a23_strength_quantiles", f"WITH {HITS}, {BANDS} SELECT track_id, {', '.join(f'round({c}, 9) AS {c}' for c in QUANTILES)} FROM q")
def a23(spark, d):
    out = A.strength_quantiles(bands(spark, d), ["track_id"])
    return out.select("track_id", *[F.round(c, 9).alias(c) for c in QUANTILES])


@query("a24_robust_unit", f"""WITH {FRAMES}, q AS (SELECT track_id, quantile_cont(x, 0.10) AS lo, quantile_cont(x, 0.95) AS hi,
  quantile_cont(abs(x), 0.98) AS ref FROM frames GROUP BY track_id)
SELECT track_id, frame_idx, round(greatest(0, least(1, (x - lo) / (hi - lo))), 6) AS unit,
  round(greatest(0, least(1.5, abs(x) / greatest(ref, 1e-12))), 6) AS scaled FROM frames JOIN q USING (track_id)""")
def a24(spark, d):
    unit = A.robust_unit(frames(spark, d), ["track_id"], "x").withColumn("a", F.abs("x"))
    both = A.reference_unit(unit, ["track_id"], "a", 0.98, 1.5)
    return both.select("track_id", "frame_idx", F.round("x_unit", 6).alias("unit"), F.round("a_unit", 6).alias("scaled"))


@query("a25_vote_families", f"""WITH {HITS} SELECT id, (CASE WHEN vote1 = 'spectral_flux' THEN 1 ELSE 0 END + CASE WHEN vote1 = 'percussive_flux' THEN 1 ELSE 0 END
  + CASE WHEN vote2 = 'energy_attack' THEN 1 ELSE 0 END + CASE WHEN vote2 = 'low_band' THEN 1 ELSE 0 END + 1) AS families FROM hits""")
def a25(spark, d):
    return hits(spark, d).select("id", A.family_count(F.col("votes")).alias("families"))


PCM = """pcm AS (SELECT l_suppkey AS track_id, l_orderkey * 7 + l_linenumber AS pos, l_quantity AS value FROM lineitem)"""


def pcm(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("track_id"), (F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("pos"),
        F.col("l_quantity").alias("value"),
    )


LODS = f"""{PCM}, base AS (SELECT track_id, pos // 256 AS bin, min(value) AS mn, max(value) AS mx FROM pcm GROUP BY 1, 2),
nb AS (SELECT track_id, max(bin) + 1 AS n FROM base GROUP BY track_id),
lods AS (SELECT track_id, level, 256 * 4 ** level AS win, bin // (4 ** level)::BIGINT AS bin, round(min(mn), 7) AS mn, round(max(mx), 7) AS mx
  FROM base JOIN nb USING (track_id), (SELECT unnest(range(0, 8)) AS level) l
  WHERE level = 0 OR ceil(n / (4.0 ** (level - 1))) > 32 GROUP BY ALL)"""


@query("a26_minmax_pyramid", f"""WITH {LODS} SELECT track_id, level, win::BIGINT AS "window", bin, mn AS "min", mx AS "max" FROM lods""")
def a26(spark, d):
    return pyramid.build_lods(pcm(spark, d), ["track_id"], "pos", "value")


@query("a27_lod_selection", f"""WITH {LODS}, sz AS (SELECT track_id, level, count(*) AS n FROM lods GROUP BY 1, 2),
ch AS (SELECT track_id, coalesce(min(level) FILTER (n <= 100), max(level)) AS level FROM sz GROUP BY 1)
SELECT track_id, level, win::BIGINT AS "window", bin, mn AS "min", mx AS "max" FROM lods JOIN ch USING (track_id, level)""")
def a27(spark, d):
    lods = pyramid.build_lods(pcm(spark, d), ["track_id"], "pos", "value", block="block")
    return pyramid.select_lod(lods, ["track_id"], 100, block="block")


@query("a28_loudness_rescore", f"""WITH {HITS}, amp AS (SELECT track_id, quantile_cont(ev_other, 0.995) AS a, count(*) / (max(pos) / 86400.0::DOUBLE) AS r FROM hits GROUP BY track_id),
l AS (SELECT *, greatest(a, 1e-5) * greatest(0.40, least(0.68, 0.36 + 0.055 * r)) AS lim FROM amp),
s AS (SELECT h.*, 1.0 / (1 + exp(greatest(-20, least(20, -(ev_other - lim) / greatest(lim * 0.16, 1e-4))))) AS lv FROM hits h JOIN l USING (track_id)),
o AS (SELECT id, least(1, confidence * (0.54 + 0.46 * lv)) AS confidence, least(1, 0.34 * salience + 0.66 * lv) AS salience FROM s)
SELECT id, round(confidence, 6) AS confidence, round(salience, 6) AS salience FROM o WHERE confidence >= 0.34 OR salience >= 0.46""")
def a28(spark, d):
    rows = hits(spark, d).withColumn("loudness", F.col("evidence")["other"])
    amplitude = A.exact_quantiles(rows, ["track_id"], F.col("loudness"), {"amplitude": 0.995}).drop("n")
    length = rows.groupBy("track_id").agg((F.max("pos") / DAY).alias("duration_sec"))
    out = A.loudness_rescore(rows, amplitude.join(length, "track_id"), ["track_id"], 0.34)
    return out.select("id", F.round("confidence", 6).alias("confidence"), F.round("salience", 6).alias("salience"))
