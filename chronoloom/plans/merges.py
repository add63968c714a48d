"""Set operations, merges, ranking and text over the given tables."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import fusion
from ..operators import merge as M
from ..operators.scoring import semantic_score
from .metrics import TILES, anchors_sql, tiles
from .registry import query
from .views import HITS, HOUR, POINTS, TRACKS, hits, points, table


@query("u1_union_near_dedupe", f"""WITH RECURSIVE {POINTS}, ab AS (SELECT * FROM points WHERE lane IN ('view', 'click')), {anchors_sql(3 * HOUR, 'ab')}
SELECT track_id, pos FROM fold WHERE pos = anchor""")
def u1(spark, d):
    p = points(spark, d)
    return M.merge_nearby(p.filter("lane = 'view'"), p.filter("lane = 'click'"), TRACKS, 3 * HOUR)


@query("u2_cell_sets", f"""WITH {POINTS}, a AS (SELECT DISTINCT track_id, pos // 7200 AS cell FROM points WHERE lane = 'view'),
b AS (SELECT DISTINCT track_id, pos // 7200 AS cell FROM points WHERE lane = 'click')
SELECT *, 'common' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT *, 'left' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def u2(spark, d):
    p = points(spark, d).withColumn("cell", F.floor(F.col("pos") / 7200))
    return M.cell_sets(p.filter("lane = 'view'"), p.filter("lane = 'click'"), ["track_id"], "cell")


def old_and_new(spark, d):
    h = hits(spark, d).select("track_id", "id", "pos", "edited", "locked", "source", "k")
    return h.filter("k < 60"), h.filter("k >= 40 and not edited and not locked").withColumn("id", F.col("id") + 1_000_000_000)


MERGED = f"""{HITS}, old AS (SELECT * FROM hits WHERE k < 60), prot AS (SELECT * FROM old WHERE edited OR locked OR source = 'manual'),
new AS (SELECT * FROM hits WHERE k >= 40 AND NOT edited AND NOT locked),
merged AS (SELECT track_id, id, 'kept' AS origin FROM prot UNION ALL SELECT track_id, id + 1000000000, 'new' FROM new n
  WHERE NOT EXISTS (SELECT 1 FROM prot p WHERE p.track_id = n.track_id AND abs(p.pos - n.pos) <= 7200))"""


@query("u3_reanalysis_merge", f"WITH {MERGED} SELECT * FROM merged")
def u3(spark, d):
    old, new = old_and_new(spark, d)
    return M.reanalysis_merge(old, new, TRACKS, 2 * HOUR).select("track_id", "id", "origin")


@query("u3_merge_status", f"""WITH {MERGED} SELECT t.track_id, CASE WHEN coalesce(bool_or(origin = 'kept'), false) THEN 'edited' ELSE 'completed' END AS status
FROM (SELECT DISTINCT track_id FROM hits) t LEFT JOIN merged m USING (track_id) GROUP BY t.track_id""")
def u3_status(spark, d):
    old, new = old_and_new(spark, d)
    merged = M.reanalysis_merge(old, new, TRACKS, 2 * HOUR)
    return M.merge_status(merged, hits(spark, d).select("track_id").distinct(), ["track_id"])


@query("u4_generator_upsert", f"""WITH {POINTS}, cur AS (SELECT id, track_id, lane AS generator, score FROM points),
inc AS (SELECT id, track_id, 'click' AS generator, score + 1 AS score FROM points WHERE score > 100 AND lane IN ('click', 'view')),
t AS (SELECT DISTINCT track_id FROM points WHERE track_id % 2 = 0)
SELECT * FROM inc UNION ALL SELECT * FROM cur WHERE id NOT IN (SELECT id FROM inc) AND (generator <> 'click' OR track_id NOT IN (SELECT track_id FROM t))""")
def u4(spark, d):
    p = points(spark, d)
    current = p.select("id", "track_id", F.col("lane").alias("generator"), "score")
    incoming = p.filter("score > 100 and lane in ('click', 'view')").select("id", "track_id", (F.col("score") + 1).alias("score"))
    return M.upsert_generator(current, incoming, "click", p.filter("track_id % 2 = 0"))


@query("u5_interval_sync", f"""WITH {POINTS}, {TILES}, cur AS (SELECT id, track_id, pos, CASE WHEN lane IN ('view', 'click') THEN 'vocals' ELSE 'mix' END AS lane, score FROM points),
des AS (SELECT id, track_id, pos, 'vocals' AS lane, score * 2 AS score FROM points WHERE lane = 'view' AND score < 60),
ok AS (SELECT * FROM tiles WHERE status = 'success')
SELECT * FROM des UNION ALL SELECT * FROM cur c WHERE id NOT IN (SELECT id FROM des) AND NOT (lane = 'vocals' AND EXISTS (
  SELECT 1 FROM ok WHERE ok.track_id = c.track_id AND c.pos >= ok.s AND c.pos < ok.e))""")
def u5(spark, d):
    p = points(spark, d)
    lane = F.when(F.col("lane").isin("view", "click"), "vocals").otherwise("mix")
    current = p.select("id", "track_id", "pos", lane.alias("lane"), "score")
    desired = p.filter("lane = 'view' and score < 60").select(
        "id", "track_id", "pos", F.lit("vocals").alias("lane"), (F.col("score") * 2).alias("score")
    )
    return M.sync_candidates(current, desired, tiles(spark, d), TRACKS)


SPANS = f"""{HITS}, sp AS (SELECT track_id, pos // 172800 AS unit, primary_stem AS method, pos - k * 977 AS s, pos - k * 977 + 1000 + k AS e, confidence AS c, salience AS a, ev_drums AS b, id FROM hits),
md AS (SELECT track_id, unit, median(s) AS ms, median(e) AS me, count(DISTINCT method) AS sup FROM sp GROUP BY 1, 2),
nm AS (SELECT track_id, count(DISTINCT method) AS n FROM sp GROUP BY 1),
sc AS (SELECT sp.*, sup, sup / n::DOUBLE AS agr, 0.35 * c + 0.30 * exp(-((abs(s - ms) + abs(e - me)) / 2.0::DOUBLE) / 20000.0::DOUBLE) + 0.20 * a + 0.15 * b AS score
  FROM sp JOIN md USING (track_id, unit) JOIN nm USING (track_id) WHERE n >= 2),
un AS (SELECT track_id, unit, list({{'k': -score, 'i': id, 's': s}} ORDER BY -score, id) AS cs, row_number() OVER (PARTITION BY track_id ORDER BY unit) AS rn FROM sc GROUP BY track_id, unit),
w AS (SELECT track_id, rn, cs[1].i AS pick, cs[1].s AS st FROM un WHERE rn = 1
  UNION ALL SELECT u.track_id, u.rn, list_filter(u.cs, lambda x: x.s >= w.st)[1].i, coalesce(list_filter(u.cs, lambda x: x.s >= w.st)[1].s, w.st)
  FROM w JOIN un u ON u.track_id = w.track_id AND u.rn = w.rn + 1)"""


@query("u6_method_fusion", f"""WITH RECURSIVE {SPANS}
SELECT sc.track_id, sc.unit, sc.method, sc.s AS start, round(least(1, greatest(0, score * (0.65 + 0.35 * agr))), 6) AS confidence, sup AS support
FROM sc JOIN w ON w.track_id = sc.track_id AND w.pick = sc.id""")
def u6(spark, d):
    k = F.col("k")
    start = F.col("pos") - k * 977
    spans = hits(spark, d).select(
        "track_id", F.floor(F.col("pos") / 172_800).alias("unit"), F.col("primary_stem").alias("method"),
        start.alias("start"), (start + 1000 + k).alias("end"), "confidence", F.col("salience").alias("acoustic"),
        F.col("evidence")["drums"].alias("beat"), F.col("id").alias("span_id"),
    )
    out = fusion.fuse_methods(spans, ["track_id"], "unit", 20_000.0)
    return out.select("track_id", "unit", "method", "start", F.round("confidence", 6).alias("confidence"), "support")


@query("u7_votes_union", f"""WITH {HITS}
SELECT track_id, array_to_string(list_sort(list_distinct(flatten([list(vote1), list(vote2), list('stem_' || primary_stem)]))), ',') AS votes FROM hits GROUP BY track_id""")
def u7(spark, d):
    return M.union_votes(hits(spark, d), ["track_id"], "votes").select("track_id", F.array_join("votes", ",").alias("votes"))


@query("o1_export_order", f"""WITH {HITS} SELECT track_id, id, c AS chart, a AS acoustic FROM (SELECT *, coalesce(chart, snapped) AS c, coalesce(acoustic, refined) AS a FROM hits)""")
def o1(spark, d):
    out = hits(spark, d).select(
        "track_id", "id", F.coalesce("chart", "snapped").alias("chart"), F.coalesce("acoustic", "refined").alias("acoustic")
    )
    return out.orderBy("chart", "acoustic", "id")


SCORED = "scored AS (SELECT track_id, id, 50 + floor(score)::BIGINT % 150 AS bpm, salience AS s FROM (SELECT *, confidence * 500 AS score FROM hits))"


def scored_tempos(spark, d):
    return hits(spark, d).select("track_id", "id", (F.floor(F.col("confidence") * 500) % 150 + 50).alias("bpm"), F.col("salience").alias("s"))


@query("o2_top_tempos", f"""WITH {HITS}, {SCORED}
SELECT track_id, bpm, s, rank FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY s DESC, bpm, id) AS rank FROM scored) WHERE rank <= 8""")
def o2(spark, d):
    return M.top_k(scored_tempos(spark, d), ["track_id"], [F.desc("s"), F.col("bpm"), F.col("id")], 8).select("track_id", "bpm", "s", "rank")


@query("o5_salient", f"""WITH {HITS} SELECT track_id, id, pos FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY salience DESC, pos, id) AS rn FROM hits) WHERE rn <= 20""")
def o5(spark, d):
    best = M.top_k(hits(spark, d), ["track_id"], [F.desc("salience"), F.col("pos"), F.col("id")], 20)
    return best.select("track_id", "id", "pos").sortWithinPartitions("track_id", "pos", "id")


@query("o6_latest_run", """SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority
  ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus = 'F') WHERE rn = 1""")
def o6(spark, d):
    done = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    out = M.latest(done, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"])
    return out.select("o_custkey", "o_orderpriority", "o_orderkey")


@query("o7_runner_up_tempo", f"""WITH {HITS}, {SCORED}, b AS (SELECT track_id, arg_max(bpm, [s, -bpm, -id]) AS best FROM scored GROUP BY track_id)
SELECT track_id, best, arg_max(bpm, [s, -bpm, -id]) FILTER (abs(bpm - best) > greatest(1.0, best * 0.015)) AS runner_up FROM scored JOIN b USING (track_id) GROUP BY track_id, best""")
def o7(spark, d):
    return runner_up(scored_tempos(spark, d), ["track_id"])


def runner_up(scored, keys):
    """Best tempo and the best one that is clearly different from it."""
    from ..core.quantiles import attach

    rank = F.struct("s", (-F.col("bpm")).alias("b"), (-F.col("id")).alias("i"))
    best = scored.groupBy(*keys).agg(F.max_by("bpm", rank).alias("best"))
    far = F.abs(F.col("bpm") - F.col("best")) > F.greatest(F.lit(1.0), F.col("best") * 0.015)
    return attach(scored, best, keys).groupBy(*keys, "best").agg(F.max_by("bpm", F.when(far, rank)).alias("runner_up"))


@query("f1_clean_lyrics", r"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(text, '\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]'),
  lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS text FROM documents""")
def f1(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clean_lyrics(F.col("text")).alias("text"))


@query("f1_timed_lyrics", r"""SELECT conv_id, turn, array_to_string(list_filter(list_transform(list_filter(list_transform(string_split_regex('[ar: ' || role || ']' || chr(10) || '[00:' || lpad((turn % 60)::VARCHAR, 2, '0') || '.50] ' || text, '\r\n|[\n\r]'),
  lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: NOT regexp_full_match(x, '\[[a-zA-Z]+:[^\]]*\]\s*')),
  lambda x: regexp_replace(regexp_replace(x, '\[(?:\d{1,3}:)?\d{1,2}:\d{2}(?:[.:]\d{1,3})?\]', '', 'g'), '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS text FROM conversations""")
def f1_timed(spark, d):
    stamp = F.lpad((F.col("turn") % 60).cast("string"), 2, "0")
    timed = F.concat(F.lit("[ar: "), F.col("role"), F.lit("]\n[00:"), stamp, F.lit(".50] "), F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", X.clean_lyrics(timed, timed=True).alias("text"))


@query("f2_match_key", r"""SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS key FROM documents""")
def f2(spark, d):
    return table(spark, d, "documents").select("doc_id", X.match_key(F.col("text")).alias("key"))


@query("f3_text_units", r"""SELECT doc_id, len(u) AS n, lower(u[1]) AS first, lower(u[len(u)]) AS last FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+|[\p{L}\p{N}]') AS u FROM documents)""")
def f3(spark, d):
    units = table(spark, d, "documents").select("doc_id", X.text_units(F.col("text")).alias("u"))
    return units.select("doc_id", F.size("u").cast("bigint").alias("n"), F.get("u", F.lit(0)).alias("first"), F.try_element_at("u", F.lit(-1)).alias("last"))


LATIN, AS_KANA = "aiueonrstmkh", "あいうえおんゃっーァカひ"


@query("f4_kana_moras", f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(lower(text), '{LATIN}', '{AS_KANA}'), '{X.LONG}|[{X.SOKUON}]|[{X.NASAL}]|[{X.KANA}][{X.SMALL}]*')) AS m FROM documents)
SELECT doc_id, CASE WHEN m = 'ー' THEN 'long_vowel' WHEN m IN ('っ', 'ッ') THEN 'sokuon' WHEN m IN ('ん', 'ン') THEN 'nasal' WHEN regexp_matches(m, '^..*[ゃゅょャュョ]') AND len(m) > 1 THEN 'yoon' ELSE 'mora' END AS kind,
  count(*) AS n FROM t GROUP BY 1, 2""")
def f4(spark, d):
    kana = F.translate(F.lower("text"), LATIN, AS_KANA)
    tokens = table(spark, d, "documents").select("doc_id", F.explode(X.mora_tokens(kana)).alias("m"))
    return tokens.groupBy("doc_id", X.mora_kind(F.col("m")).alias("kind")).agg(F.count("*").alias("n"))


@query("f6_kana_fold", f"""SELECT conv_id, turn, translate(translate(lower(text), '{LATIN}', '{AS_KANA}'), 'ァカ', 'ぁか') AS folded FROM conversations""")
def f6(spark, d):
    kana = F.translate(F.lower("text"), LATIN, AS_KANA)
    return table(spark, d, "conversations").select("conv_id", "turn", X.hiragana(kana).alias("folded"))


SYLLABLES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in X.ROMAJI.items()) + "}"
PAIRS = "|".join(k for k in X.ROMAJI if len(k) == 2)


@query("f6_romaji", f"""WITH k AS (SELECT row_number() OVER () AS r, conv_id, turn, translate(lower(text), '{LATIN}', 'アイウエオンャッーァカヒ') AS kana FROM conversations),
l AS (SELECT r, regexp_extract_all(kana, '{PAIRS}|(?s:.)') AS tokens FROM k),
t AS (SELECT r, unnest(range(len(tokens))) AS i, unnest(tokens) AS token FROM l),
s AS (SELECT *, coalesce({SYLLABLES}[token], token) AS spoken,
  last_value(CASE WHEN token <> 'ー' THEN token END IGNORE NULLS) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM t),
p AS (SELECT *, CASE WHEN token = 'ッ' THEN '' WHEN token = 'ー' THEN NULL
  WHEN prior = 'ッ' AND NOT regexp_matches(spoken, '^[aeioun]') THEN spoken[1] || spoken ELSE spoken END AS piece FROM s),
v AS (SELECT *, last_value(nullif(piece, '') IGNORE NULLS) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM p),
o AS (SELECT r, string_agg(CASE WHEN token = 'ー' THEN regexp_extract(coalesce(last, ''), '([aeiou])[^aeiou]*$', 1) ELSE piece END, '' ORDER BY i) AS out FROM v GROUP BY r)
SELECT conv_id, turn, CASE WHEN kana IS NOT NULL THEN coalesce(out, '') END AS romaji FROM k LEFT JOIN o USING (r)""")
def f6_romaji(spark, d):
    kana = X.katakana(F.translate(F.lower("text"), LATIN, AS_KANA))
    return table(spark, d, "conversations").select("conv_id", "turn", X.romaji(kana).alias("romaji"))


@query("f7_path_redaction", r"""WITH t AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/srv/' || url WHEN 1 THEN 'see /home/' || url || ' now' WHEN 2 THEN 'C:\Users\' || url ELSE url END AS v FROM pages)
SELECT page_id, CASE WHEN regexp_matches(v, '^(?:/|~/|\./|\.\./|file://|[A-Za-z]:[\\/])') THEN '<local-path>/' || CASE WHEN nm = '' THEN 'local-model' ELSE nm END
  ELSE regexp_replace(regexp_replace(v, '(?i)[A-Za-z]:[\\/](?:Users|Documents and Settings)[\\/][^\s"''<>]+', '<local-path>', 'g'), '/(?:Users|home|var/folders|private/var/folders)/[^\s"''<>]+', '<local-path>', 'g') END AS safe
FROM (SELECT *, list_last(string_split(regexp_replace(replace(v, '\', '/'), '/+$', ''), '/')) AS nm FROM t)""")
def f7(spark, d):
    m = F.col("page_id") % 4
    v = (
        F.when(m == 0, F.concat(F.lit("/srv/"), "url")).when(m == 1, F.concat(F.lit("see /home/"), "url", F.lit(" now")))
        .when(m == 2, F.concat(F.lit("C:\\Users\\"), "url")).otherwise(F.col("url"))
    )
    return table(spark, d, "pages").select("page_id", X.redact(v).alias("safe"))


@query("f8_stable_id", f"""SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ('89ab')[(instr('0123456789abcdef', h[17:17]) - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] AS uid
FROM (SELECT doc_id, sha1(unhex('{X.URL_NAMESPACE}') || encode('candidate:' || doc_id || ':' || lang)) AS h FROM documents)""")
def f8(spark, d):
    key = F.concat(F.lit("candidate:"), F.col("doc_id").cast("string"), F.lit(":"), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", X.stable_id(key).alias("uid"))


@query("f9_json_fallback", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(props->>'$.k' AS DOUBLE) END AS k, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS n FROM events""")
def f9(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{broken"), "props")).otherwise(F.col("props"))
    out = table(spark, d, "events").withColumn("m", X.evidence(raw))
    return out.select("event_id", F.col("m")["k"].alias("k"), F.size("m").alias("n"))


@query("f10_semantic_max", f"""WITH {HITS} SELECT id, round(least(1, greatest(ev_vocals, confidence, 0)), 6) AS semantic FROM hits""")
def f10(spark, d):
    m = F.create_map(F.lit("lyricAlignment"), F.col("evidence")["vocals"], F.lit("pitchConfidence"), F.col("confidence"), F.lit("attackConfidence"), F.lit(5.0))
    return hits(spark, d).select("id", F.round(semantic_score(m), 6).alias("semantic"))
