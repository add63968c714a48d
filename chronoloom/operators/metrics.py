"""Evaluation metrics, coverage, stability and roll-ups per track."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.chains import keep_distant
from ..core.durable import checkpointed
from ..core.quantiles import attach, curve_quantiles, exact_quantiles, union_all
from ..core.timeline import Timeline, carried, islands
from ..functions.lattice import line_distance, rhythm_score
from .joins import asof_segment, match_events, nearest_distance, within
from .merge import cell_sets, latest, top_k
from .projections import clip


# --------------------------------------------------------------------------
# matching quality


def f_scores(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall, F1 with six decimals; empty denominators count as 1."""
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(1.0))
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(1.0))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return {
        "precision": F.round(precision, 6),
        "recall": F.round(recall, 6),
        "f1": F.round(f1, 6),
    }


def counted(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def _report(stats: DataFrame, errors: DataFrame, keys: Sequence[str], window: int, rate: int,
            duration_sec: Column, columns: Sequence[str]) -> DataFrame:
    """Scores, error quantiles and rates per minute from tp/fp/fn."""
    middle = exact_quantiles(errors, keys, F.col("distance"), {"_median": 0.5})
    high = exact_quantiles(errors, keys, F.col("distance"), {"_p95": 0.95}, nearest_rank=True)
    joined = stats.join(middle.drop("n"), list(keys), "left").join(high.drop("n"), list(keys), "left")
    minutes = F.greatest(duration_sec / 60.0, F.lit(1 / 60))
    scored = joined.withColumns(f_scores(F.col("tp"), F.col("fp"), F.col("fn")))
    return scored.select(
        *columns, F.lit(window).alias("window"), "tp", "fp", "fn", "precision", "recall", "f1",
        F.round(F.col("_median") * 1000 / rate, 6).alias("median_error_ms"),
        F.round(F.col("_p95") * 1000 / rate, 6).alias("p95_error_ms"),
        F.round(F.col("fp") / minutes, 6).alias("fp_per_minute"),
        F.round(F.col("fn") / minutes, 6).alias("fn_per_minute"),
    )


def _all_stats(sizes: DataFrame, pairs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    stats = sizes.join(counted(pairs, keys, "tp"), keys, "left").na.fill(0, ["tp"])
    return stats.withColumns({"fp": F.col("predictions") - F.col("tp"), "fn": F.col("truths") - F.col("tp")}), pairs


def _strong_stats(sizes: DataFrame, pairs: DataFrame, strong: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    hits = pairs.join(strong, [*keys, "truth_idx"], "left_semi")
    stats = (
        sizes.join(counted(hits, keys, "tp"), keys, "left").join(counted(pairs, keys, "_matched"), keys, "left")
        .na.fill(0, ["tp", "_matched"])
        .withColumns({"fp": F.col("predictions") - F.col("_matched"), "fn": F.col("strong") - F.col("tp")})
    )
    return stats, hits


def _strong_rows(truth: DataFrame, tl: Timeline, threshold: float, strength: str, index: str) -> DataFrame:
    """A truth counts as strong when any truth at its position is strong."""
    keys = list(tl.keys)
    places = truth.filter(F.col(strength) >= threshold).select(*keys, tl.pos).distinct()
    return truth.join(places, [*keys, tl.pos], "left_semi").select(*keys, F.col(index).alias("truth_idx"))


def event_metrics(
    truth: DataFrame, predictions: DataFrame, tracks: DataFrame, tl: Timeline,
    windows: Sequence[int], rate: int,
) -> DataFrame:
    """One row per track and window; ``tracks`` has keys and ``duration_sec``."""
    keys = list(tl.keys)
    sizes = _sizes(tracks, {"truths": truth, "predictions": predictions}, keys)
    blocks = []
    for window in windows:
        stats, errors = _all_stats(sizes, match_events(truth, predictions, tl, window), keys)
        blocks.append(_report(stats, errors, keys, window, rate, F.col("duration_sec"), keys))
    return union_all(blocks)


def _sizes(tracks: DataFrame, sides: Mapping[str, DataFrame], keys: list[str]) -> DataFrame:
    for name, rows in sides.items():
        tracks = tracks.join(counted(rows, keys, name), keys, "left")
    return tracks.na.fill(0, list(sides))


def strong_metrics(
    truth: DataFrame, predictions: DataFrame, tracks: DataFrame, tl: Timeline,
    windows: Sequence[int], rate: int, threshold: float, strength: str = "score", index: str = "idx",
) -> DataFrame:
    """Strong subset: match against all truth; matched weak truth is neutral."""
    keys = list(tl.keys)
    strong = _strong_rows(truth, tl, threshold, strength, index)
    sizes = _sizes(tracks, {"strong": truth.filter(F.col(strength) >= threshold), "predictions": predictions}, keys)
    blocks = []
    for window in windows:
        stats, hits = _strong_stats(sizes, match_events(truth, predictions, tl, window), strong, keys)
        blocks.append(_report(stats, hits, keys, window, rate, F.col("duration_sec"), keys))
    return union_all(blocks)


def evaluation_report(
    truth: DataFrame, predictions: DataFrame, tracks: DataFrame, expected: DataFrame, estimated: DataFrame, tl: Timeline, *,
    windows: Sequence[int], rate: int, threshold: float, duplicate_window: int, cell_width: Column, offset: Column,
    strength: str = "score", index: str = "idx",
) -> DataFrame:
    """The whole evaluation in long form: keys, part, window, measure, value.

    Parts: ``all`` and ``strong`` events per window (one match per window serves both), ``grid`` cells,
    ``tempo`` errors, ``duplicates``, and ``missing`` with one row for every track that has truth and no
    prediction.  ``window`` is null where there is none, ``value`` where there is nothing to measure.
    Arguments as in the single metrics.
    """
    keys = list(tl.keys)
    strong = _strong_rows(truth, tl, threshold, strength, index)
    sides = {"truths": truth, "predictions": predictions, "strong": truth.filter(F.col(strength) >= threshold)}
    sizes = checkpointed(_sizes(tracks, sides, keys))

    def long(rows: DataFrame, part: str, measures: Sequence[str], window: Column) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures))
        return rows.select(*keys, F.lit(part).alias("part"), window.cast("bigint").alias("window"), F.inline(pairs))

    scores = ["precision", "recall", "f1"]
    measures = ["tp", "fp", "fn", *scores, "median_error_ms", "p95_error_ms", "fp_per_minute", "fn_per_minute"]
    blocks = []
    for window in windows:
        pairs = match_events(truth, predictions, tl, window)
        for part, (stats, errors) in (("all", _all_stats(sizes, pairs, keys)), ("strong", _strong_stats(sizes, pairs, strong, keys))):
            block = _report(stats, errors, keys, window, rate, F.col("duration_sec"), keys)
            blocks.append(long(block, part, measures, F.col("window")))
    none = F.lit(None)
    cells = cell_accuracy(truth, predictions, keys, tl.pos, cell_width, offset)
    blocks.append(long(cells, "grid", ["correct", "extra", "missing", "accuracy", *scores], none))
    blocks.append(long(tempo_error(expected, estimated, keys, rate), "tempo", ["absolute_error", "relative_error", "offset_error_ms"], none))
    blocks.append(long(duplicate_count(predictions, tl, duplicate_window), "duplicates", ["duplicates"], none))
    absent = sizes.filter("truths > 0 and predictions = 0")
    blocks.append(long(absent, "missing", ["truths"], none))
    return union_all(blocks)


def duplicate_count(df: DataFrame, tl: Timeline, window: int) -> DataFrame:
    """Rows within ``window`` of their cluster anchor, the anchor not counted."""
    keys = list(tl.keys)
    heads = counted(keep_distant(df, tl, window), keys, "anchors")
    return counted(df, keys, "n").join(heads, keys).select(
        *keys, (F.col("n") - F.col("anchors")).alias("duplicates")
    )


def cell_accuracy(
    truth: DataFrame, predictions: DataFrame, keys: Sequence[str], pos: str, cell_width: Column,
    offset: Column,
) -> DataFrame:
    """Jaccard and scores of occupied lattice cells (double arithmetic, half-even)."""
    keys = list(keys)
    cell = F.rint((F.col(pos) - offset) / cell_width).cast("bigint").alias("cell")
    sides = cell_sets(truth.select(*keys, cell), predictions.select(*keys, cell), keys, "cell")
    counts = sides.groupBy(*keys).agg(
        F.count_if(F.col("side") == "common").alias("correct"),
        F.count_if(F.col("side") == "right").alias("extra"),
        F.count_if(F.col("side") == "left").alias("missing"),
    )
    union = F.col("correct") + F.col("extra") + F.col("missing")
    return counts.withColumn("accuracy", F.round(F.col("correct") / union, 6)).withColumns(
        f_scores(F.col("correct"), F.col("extra"), F.col("missing"))
    )


def tempo_error(expected: DataFrame, estimated: DataFrame, keys: Sequence[str], rate: int) -> DataFrame:
    """Absolute and relative bpm error and offset error per track; no estimate counts as 0."""
    bpm = F.coalesce(F.col("estimated_bpm"), F.lit(0.0))
    offset = F.coalesce(F.col("estimated_offset"), F.lit(0))
    gap = F.abs(F.col("expected_bpm") - bpm)
    return expected.join(estimated, list(keys), "left").select(
        *keys, F.round(gap, 6).alias("absolute_error"),
        F.round(gap / F.col("expected_bpm"), 6).alias("relative_error"),
        F.round(F.abs(offset - F.col("expected_offset")) * 1000.0 / rate, 6).alias("offset_error_ms"),
    )


# --------------------------------------------------------------------------
# roll-ups


def first_segment(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    return segments.groupBy(*keys).agg(
        F.min_by("bpm", "start_pos").alias("first_bpm"), F.min("start_pos").alias("first_start")
    )


def project_summary(projects: DataFrame, tracks: DataFrame, hits: DataFrame, segments: DataFrame) -> DataFrame:
    """Hit count, bpm of the first segment (else the estimate), duration and mode."""
    n = counted(hits, ["track_id"], "hit_count")
    first = first_segment(segments, ["track_id"]).select("track_id", "first_bpm")
    return (
        projects.join(tracks, "project_id", "left")
        .join(n, "track_id", "left")
        .join(first, "track_id", "left")
        .select(
            "project_id", "title", "track_id", F.coalesce("first_bpm", "estimated_bpm").alias("bpm"),
            "duration_sec", F.coalesce("hit_count", F.lit(0)).alias("hit_count"), "mode",
        )
    )


def counts_by(df: DataFrame, keys: Sequence[str], category: str, values: Sequence[str]) -> DataFrame:
    """Row count per listed category, zeros kept."""
    return df.groupBy(*keys).agg(
        *[F.count_if(F.col(category) == v).alias(v) for v in values], F.count("*").alias("total")
    )


def chunk_summary(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chunks per status and the duration of everything not successful."""
    length = F.greatest(F.lit(0), F.col("end") - F.col("start"))
    return chunks.groupBy(*keys, "status").agg(
        F.count("*").alias("chunks"),
        F.sum(F.when(F.col("status") != "success", length).otherwise(0)).alias("uncovered"),
    )


def regions_with_events(regions: DataFrame, events: DataFrame, tl: Timeline, start: str, end: str) -> DataFrame:
    """Flag regions [start, end) that hold an event: the next event after start is inside."""
    ahead = _next_event(regions, events, tl, F.col(start))
    return ahead.withColumn("has_event", F.coalesce(F.col("_next") < F.col(end), F.lit(False))).drop("_next")


def _next_event(rows: DataFrame, events: DataFrame, tl: Timeline, at: Column) -> DataFrame:
    """First event position at or after ``at`` of the same key, as ``_next``."""
    asked = rows.select(
        *tl.keys, at.cast("bigint").alias("_at"), F.lit(0).alias("_kind"), F.struct(*rows.columns).alias("_row")
    )
    known = events.select(*tl.keys, F.col(tl.pos).cast("bigint").alias("_at"), F.lit(1).alias("_kind")).distinct()
    merged = asked.unionByName(known, allowMissingColumns=True)
    line = Timeline(tl.keys, "_at", ["_kind"], tl.width)
    found = carried(merged, line, upcoming={"_next": F.when(F.col("_kind") == 1, F.col("_at"))})
    return found.filter("_kind = 0").select("_row.*", "_next")


def line_coverage(
    phrases: DataFrame, diagnostics: DataFrame, coverage: DataFrame, events: DataFrame, tl: Timeline
) -> DataFrame:
    """Lines assigned by chunks and covered by successful chunks that hold an event.

    ``phrases``: keys, n_lines.  ``diagnostics``: keys, idx, start, end, line_start,
    line_end, status, alignment_status.  ``coverage``: keys, idx, chunk_status.
    """
    keys = list(tl.keys)
    marked = regions_with_events(diagnostics, events, tl, "start", "end")
    marked = marked.join(coverage, [*keys, "idx"], "left").join(phrases, keys)
    success = F.when(F.col("chunk_status").isNotNull(), F.col("chunk_status") == "success").otherwise(
        (F.col("status") == "ok") & (F.col("alignment_status") == "ok")
    )
    low = F.greatest(F.col("line_start"), F.lit(0))
    high = F.least(F.col("n_lines"), F.greatest("line_start", "line_end"))
    lines = (
        marked.filter("line_start is not null and line_end is not null")
        .filter(low < high)
        .select(*keys, F.explode(F.sequence(low, high - 1)).alias("line"),
                (F.coalesce(success, F.lit(False)) & F.col("has_event")).alias("ok"))
        .groupBy(*keys, "line").agg(F.max("ok").alias("ok"))
    )
    stats = lines.groupBy(*keys).agg(F.count("*").alias("assigned"), F.count_if("ok").alias("covered"))
    return phrases.join(stats, keys, "left").na.fill(0, ["assigned", "covered"]).select(
        *keys, "n_lines", "assigned", "covered", (F.col("n_lines") - F.col("covered")).alias("uncovered"),
        F.when(F.col("n_lines") > 0, F.round(F.col("covered") / F.col("n_lines") * 100, 3)).alias("coverage_pct"),
    )


# --------------------------------------------------------------------------
# coverage of active frames


def runs(df: DataFrame, tl: Timeline, hop: int) -> DataFrame:
    """Contiguous runs of positions; a gap above 1.5 hops starts a new one."""
    marked = islands(df, tl, int(1.5 * hop) + 1, "run")
    return marked.groupBy(*tl.keys, "run").agg(
        (F.min(tl.pos) - hop // 2).alias("start"), (F.max(tl.pos) + hop // 2).alias("end"),
        F.count("*").alias("frames"),
    )


def coverage_metrics(
    active: DataFrame, events: DataFrame, tl: Timeline, rate: int, hop: int,
    near_sec: float = 0.25, far_sec: float = 0.5, section_sec: float = 0.2,
) -> DataFrame:
    """Share of active frames close to an event, and covered active sections."""
    keys = list(tl.keys)
    dist = nearest_distance(active, events, tl, "distance")
    close = F.coalesce(F.col("distance") <= rate * near_sec, F.lit(False))
    fair = F.coalesce(F.col("distance") <= rate * far_sec, F.lit(False))
    frames = dist.groupBy(*keys).agg(
        F.count("*").alias("active_frames"),
        F.round(F.avg(close.cast("double")) * 100, 3).alias("near_pct"),
        F.round(F.avg(fair.cast("double")) * 100, 3).alias("far_pct"),
        F.round(F.count_if(~close) * hop / rate, 3).alias("uncovered_sec"),
    )
    p95 = exact_quantiles(dist, keys, F.col("distance"), {"_p95": 0.95}).select(
        *keys, F.round(F.col("_p95") / rate, 3).alias("nearest_p95_sec")
    )
    reach = rate * near_sec
    sections = runs(active, tl, hop).filter(F.col("frames") * hop >= rate * section_sec)
    ahead = _next_event(sections, events, tl, F.ceil(F.col("start") - reach))
    parts = ahead.groupBy(*keys).agg(
        F.count("*").alias("sections"),
        F.count_if(F.col("_next") <= F.col("end") + reach).alias("covered_sections"),
    )
    return (
        frames.join(p95, keys, "left").join(parts, keys, "left")
        .na.fill(0, ["sections", "covered_sections"])
        .withColumn(
            "section_pct",
            F.when(F.col("sections") > 0, F.round(F.col("covered_sections") / F.col("sections") * 100, 3)),
        )
    )


def uncovered_runs(active: DataFrame, events: DataFrame, tl: Timeline, hop: int, radius: int) -> DataFrame:
    """Runs of active frames farther than ``radius`` from every event."""
    return runs(within(active, events, tl, radius, "_near").filter("not _near"), tl, hop)


def longest_runs(found: DataFrame, keys: Sequence[str], k: int = 8) -> DataFrame:
    return top_k(found, keys, [F.desc("frames"), F.col("start")], k)


# --------------------------------------------------------------------------
# alignment quality


def stability(
    tokens: DataFrame, keys: Sequence[str], rate: int, sample_count: Column, width: int, index_width: int
) -> DataFrame:
    """Order, duplicate, density and validity faults of spans, and the score.

    Tokens have ``idx`` (text order), ``start`` and ``end``.
    """
    keys = list(keys)
    dense = max(1, round(rate * 0.005))
    by_text = carried(tokens, Timeline(keys, "idx", (), index_width), prev={"_prev": F.col("start")})
    order = by_text.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("start") < F.col("_prev")).alias("reversed"),
        F.count_if(
            (F.col("end") < F.col("start")) | (F.col("start") < 0) | (F.col("end") > sample_count)
        ).alias("invalid"),
    )
    spans = tokens.select(*keys, "start", "end").distinct()
    different = counted(spans, keys, "different")
    starts = spans.select(*keys, "start").distinct()
    by_time = carried(starts, Timeline(keys, "start", (), width), prev={"_prev": F.col("start")})
    crowded = by_time.groupBy(*keys).agg(
        F.count_if(F.col("start") - F.col("_prev") < dense).alias("dense")
    )
    n = F.col("n")
    penalty = (
        0.35 * F.col("reversed") / n + 0.30 * F.col("duplicates") / n
        + 0.15 * F.col("dense") / n + 0.20 * F.col("invalid") / n
    )
    return (
        order.join(different, keys).join(crowded, keys)
        .withColumn("duplicates", n - F.col("different"))
        .select(*keys, "n", "reversed", "duplicates", "dense", "invalid",
                F.round(clip(1 - penalty), 6).alias("stability"))
    )


def rhythm_agg(tokens: DataFrame, segments: DataFrame, tl: Timeline, rate: int) -> DataFrame:
    """Mean closeness to the 1/16 grid in force and mean distance in ms."""
    placed = asof_segment(tokens, segments, tl, "start_pos", ["bpm", "beat_offset"])
    step = F.lit(rate * 60.0) / F.col("bpm") / 4
    distance = line_distance(F.col(tl.pos), step, F.col("beat_offset"))
    return placed.groupBy(*tl.keys).agg(
        F.round(clip(F.avg(rhythm_score(distance, step))), 6).alias("rhythm"),
        F.round(F.avg(distance * 1000.0 / rate), 6).alias("mean_distance_ms"),
    )


def alignment_report(
    tracks: DataFrame, coverage: DataFrame, acoustic: DataFrame, rhythm: DataFrame, stable: DataFrame,
    keys: Sequence[str], digits: int = 6,
) -> DataFrame:
    """.35 coverage + .30 acoustic + .20 rhythm + .15 stability; absent parts are 0."""
    keys = list(keys)
    parts = {"coverage": coverage, "acoustic": acoustic, "rhythm": rhythm, "stability": stable}
    joined = tracks.select(*keys).distinct()
    for name, part in parts.items():
        joined = joined.join(part.select(*keys, name), keys, "left")
    joined = joined.na.fill(0.0, list(parts))
    score = (
        0.35 * F.col("coverage") + 0.30 * F.col("acoustic") + 0.20 * F.col("rhythm")
        + 0.15 * F.col("stability")
    )
    return joined.withColumn("score", F.round(clip(score), digits))


def compare_methods(runs_: DataFrame, reports: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest run per track and method with its report, error passed through."""
    newest = latest(runs_, [*keys, "method"], order)
    return newest.join(reports, "run_id", "left")


def hierarchy_coverage(
    units: DataFrame, phones: DataFrame, keys: Sequence[str], indices: str, phone_index: str,
    threshold: float = 0.20,
) -> DataFrame:
    """Units whose phones are all observed, and those confident enough on average."""
    keys = list(keys)
    unit_columns = [c for c in units.columns if c != indices]
    links = units.select(*unit_columns, F.explode_outer(indices).alias(phone_index))
    mapped = links.join(phones, [*keys, phone_index], "left")
    per_unit = mapped.groupBy(*unit_columns).agg(
        (F.every(F.coalesce("observed", F.lit(True))) & (F.count("observed") > 0)).alias("full"),
        F.avg(F.when(F.col("observed"), F.col("confidence"))).alias("mean_confidence"),
    )
    counts = per_unit.groupBy(*keys).agg(
        F.count("*").alias("units"), F.count_if("full").alias("forced"),
        F.count_if(F.col("full") & (F.col("mean_confidence") >= threshold)).alias("aligned"),
    )
    return counts.withColumns(
        {
            "coverage": F.round(F.col("aligned") / F.col("units"), 6),
            "forced_coverage": F.round(F.col("forced") / F.col("units"), 6),
        }
    )


def acoustic_consistency(
    phones: DataFrame, keys: Sequence[str], confidence: Column, energy: Column, spectral: Column, pitch: Column
) -> DataFrame:
    mixed = 0.45 * confidence + 0.25 * energy + 0.20 * spectral + 0.10 * pitch
    return phones.groupBy(*keys).agg(F.round(clip(F.avg(mixed)), 6).alias("consistency"))


# --------------------------------------------------------------------------
# jobs and chunks


def stage_timings(job_events: DataFrame, tl: Timeline, stage: str, per_second: int = 1) -> DataFrame:
    """Start and duration of every stage; repeated reports of a stage are one."""
    before = carried(job_events, tl, prev={"_prev": F.col(stage)})
    changes = before.filter(F.col("_prev").isNull() | (F.col("_prev") != F.col(stage)))
    ended = carried(changes.drop("_prev"), tl, nxt={"_next": F.col(tl.pos)})
    return ended.select(
        *tl.keys, *tl.tie, F.col(stage).alias("stage"), F.col(tl.pos).alias("started"),
        ((F.col("_next") - F.col(tl.pos)) * F.lit(1000.0) / per_second).alias("duration_ms"),
    )


def monotone_progress(job_events: DataFrame, tl: Timeline, amount: Column) -> DataFrame:
    """Reported progress never falls and stays in [.01, .97]."""
    return carried(job_events, tl, run_max={"progress": clip(amount, 0.01, 0.97)})


# fixed values: chunk replacement needs two anchors and this confidence
MIN_CHUNK_ANCHORS = 2
MIN_CHUNK_CONFIDENCE = 0.28


def chunk_coverage(
    diagnostics: DataFrame, timestamps: DataFrame, anchors: DataFrame, keys: Sequence[str],
    remap=lambda pos: pos,
) -> DataFrame:
    """Replacement status of every chunk: nine ordered rules.

    ``diagnostics``: keys, idx, start, end, status, alignment_status, match_confidence;
    ``anchors``: keys, idx, confidence, active, chart_candidate; ``remap`` maps positions
    to the target rate.
    """
    ids = [*keys, "idx"]
    raw = counted(timestamps, ids, "raw_count")
    usable = anchors.filter(F.col("active") & F.col("chart_candidate")).groupBy(*ids).agg(
        F.count("*").alias("anchor_count"), F.avg("confidence").alias("anchor_confidence")
    )
    joined = (
        diagnostics.join(raw, ids, "left").join(usable, ids, "left")
        .na.fill(0, ["raw_count", "anchor_count"]).na.fill(0.0, ["anchor_confidence"])
    )
    given = F.coalesce(F.col("match_confidence"), F.lit(0.0))
    match = F.when(F.isnan(given) | (F.abs(given) == float("inf")), 0.0).otherwise(given)
    confidence = F.least(F.greatest(match, F.lit(0.0)), F.greatest("anchor_confidence", F.lit(0.0)))
    status = (
        F.when(F.col("status") == "silent", "silent")
        .when(F.col("status") != "ok", "asr_failed")
        .when(F.col("alignment_status").isNull(), "unassigned")
        .when(F.col("alignment_status") != "ok", "alignment_failed")
        .when(match < MIN_CHUNK_CONFIDENCE, "low_confidence")
        .when((F.col("raw_count") > 0) & (F.col("anchor_count") == 0), "alignment_collapse")
        .when(F.col("anchor_count") < MIN_CHUNK_ANCHORS, "insufficient_anchors")
        .when(confidence < MIN_CHUNK_CONFIDENCE, "low_confidence")
        .otherwise("success")
    )
    start = F.greatest(F.col("start"), F.lit(0))
    end = F.greatest(start + 1, F.col("end"))
    return joined.select(
        *ids, remap(start).alias("start"), F.greatest(remap(start) + 1, remap(end)).alias("end"),
        status.alias("status"), F.round(clip(confidence), 6).alias("confidence"), "anchor_count", "raw_count",
    )


def chunk_activity(frames: DataFrame, keys: Sequence[str], rms: str, chunk: str) -> DataFrame:
    """Share of frames above the activity floor per chunk; below 2 % it is silent."""
    keys = list(keys)
    levels = exact_quantiles(frames, keys, F.col(rms), {"_q90": 0.9, "_q20": 0.2})
    loud = F.greatest(F.col("_q90"), F.lit(1e-9))
    noise = F.greatest(F.col("_q20"), F.lit(1e-9))
    floor = F.greatest(F.lit(10.0 ** (-55 / 20)), loud * 0.02, F.least(noise * 4, loud * 0.25))
    floors = levels.select(*keys, floor.alias("_floor"))
    marked = attach(frames, floors, keys)
    ratio = F.avg((F.col(rms) >= F.col("_floor")).cast("double"))
    return marked.groupBy(*keys, chunk).agg(F.round(ratio, 6).alias("active_ratio")).withColumn(
        "silent", F.col("active_ratio") < 0.02
    )


def first_failure(rules: Mapping[str, Column], passed: str | None = None) -> Column:
    """Name of the first rule that holds, in order."""
    chain = None
    for reason, fails in rules.items():
        chain = F.when(fails, reason) if chain is None else chain.when(fails, reason)
    return chain.otherwise(F.lit(passed))


def rejection_stats(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """Rows per first failing reason."""
    reason = first_failure(rules, "accepted")
    return df.select(*keys, reason.alias("reason")).groupBy(*keys, "reason").agg(F.count("*").alias("n"))


def anchor_rejections() -> dict[str, Column]:
    """Ordered reasons for dropping a timed token (fixed thresholds)."""
    return {
        "chunk_match": F.isnan("chunk_match") | (F.col("chunk_match") < 0.28),
        "short": F.col("duration_ms") < 30.0,
        "silent": F.col("active_start").isNull() | (F.col("rms") < F.col("activity_floor")),
        "weak_attack": (F.col("activity") < 0.08) & (F.col("attack") < 0.16),
        "low_confidence": F.col("confidence") < 0.34,
    }


def span_rollup(children: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outer span (raw and refined), mean confidence and strongest evidence."""
    return children.groupBy(*keys).agg(
        F.min("aligned_start").alias("aligned_start"), F.max("aligned_end").alias("aligned_end"),
        F.min("refined_start").alias("refined_start"), F.max("refined_end").alias("refined_end"),
        F.avg("confidence").alias("confidence"),
        *[F.max(c).alias(c) for c in ("energy", "spectral_change", "pitch_change")],
    )


# --------------------------------------------------------------------------
# track-relative scales


def strength_quantiles(candidates: DataFrame, keys: Sequence[str], enough: int = 12) -> DataFrame:
    """Quantiles of band strengths per track used by the relative band rules.

    The balanced level is the 82 % quantile of the low band; with fewer than ``enough`` candidates, too few for
    a rank that high, it is the low floor.
    """
    keys = list(keys)
    low = F.col("sub_low") + 0.65 * F.col("low_mid")
    upper = F.col("mid") + 0.65 * F.col("high") + 0.35 * F.col("air")
    high = 0.65 * F.col("high") + 0.35 * F.col("air")
    lows = curve_quantiles(
        candidates, keys,
        {
            "low_floor": (low, 0.24), "low_high": (low, 0.76), "_balanced": (low, 0.82), "upper_floor": (upper, 0.24),
            "mid_floor": (F.col("mid"), 0.30), "high_floor": (high, 0.30),
        },
    )
    balanced = F.when(F.col("n") >= enough, F.col("_balanced")).otherwise(F.col("low_floor"))
    return lows.withColumn("balanced_low", balanced).drop("_balanced", "n")


def robust_unit(frames: DataFrame, keys: Sequence[str], column: str, low: float = 0.10, high: float = 0.95) -> DataFrame:
    """clip((x - q_low) / (q_high - q_low)); a flat curve becomes 0."""
    levels = exact_quantiles(frames, keys, F.col(column), {"_low": low, "_high": high}).drop("n")
    span = F.col("_high") - F.col("_low")
    unit = F.when(span <= 1e-12, 0.0).otherwise(clip((F.col(column) - F.col("_low")) / span))
    return attach(frames, levels, keys).withColumn(f"{column}_unit", unit).drop("_low", "_high")


def reference_unit(frames: DataFrame, keys: Sequence[str], column: str, q: float = 0.90, top: float = 1.0) -> DataFrame:
    """clip(x / quantile, 0, top)."""
    levels = exact_quantiles(frames, keys, F.col(column), {"_ref": q}).drop("n")
    unit = clip(F.col(column) / F.greatest(F.col("_ref"), F.lit(1e-12)), 0.0, top)
    return attach(frames, levels, keys).withColumn(f"{column}_unit", unit).drop("_ref")


def family_count(votes: Column) -> Column:
    """Independent evidence groups among detector names; correlated bands are one."""
    bands = F.array(F.lit("low_band"), F.lit("mid_band"), F.lit("high_band"))
    groups = [
        F.array_contains(votes, "spectral_flux"),
        F.array_contains(votes, "percussive_flux"),
        F.array_contains(votes, "energy_attack"),
        F.arrays_overlap(votes, bands),
        F.exists(votes, lambda v: v.startswith("stem_")),
    ]
    total = groups[0].cast("int")
    for group in groups[1:]:
        total = total + group.cast("int")
    return total


def loudness_rescore(
    candidates: DataFrame, reference: DataFrame, keys: Sequence[str], floor: float
) -> DataFrame:
    """Re-score against a rate-dependent loudness threshold and drop the weak ones.

    ``reference``: keys, ``amplitude`` (q99.5 of the absolute signal), ``duration_sec``.
    """
    keys = list(keys)
    facts = reference.join(counted(candidates, keys, "_events"), keys).select(
        *keys, F.greatest("amplitude", F.lit(1e-5)).alias("_amp"),
        (F.col("_events") / F.greatest("duration_sec", F.lit(1e-6))).alias("_rate"),
    )
    ratio = clip(0.36 + 0.055 * F.col("_rate"), 0.40, 0.68)
    limit = F.col("_amp") * ratio
    width = F.greatest(limit * 0.16, F.lit(1e-4))
    exponent = clip(-(F.col("loudness") - limit) / width, -20.0, 20.0)
    level = F.lit(1.0) / (1 + F.exp(exponent))
    out = attach(candidates, facts, keys).withColumn("_level", level)
    out = out.withColumns(
        {
            "confidence": clip(F.col("confidence") * (0.54 + 0.46 * F.col("_level"))),
            "salience": clip(0.34 * F.col("salience") + 0.66 * F.col("_level")),
        }
    )
    keep = (F.col("confidence") >= floor) | (F.col("salience") >= min(0.95, floor + 0.12))
    return out.filter(keep).drop("_amp", "_rate", "_level")
