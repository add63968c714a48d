"""Row-local scores and ordered classification rules, and the policies built on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core.chains import SLICES_PER_WINDOW, spaced, spaced_order
from ..core.durable import checkpointed
from ..core.quantiles import attach
from ..core.timeline import Timeline, swept
from ..functions.lattice import Lattice, grid_confidence, min_grid_error, snap_error_ms
from .joins import interval_join
from .metrics import family_count, strength_quantiles
from .projections import clip, lane, source_evidence
from .sequences import cell_winners


def semantic_score(evidence: Column) -> Column:
    """Strongest of the three semantic keys of an evidence map, in [0, 1]."""
    keys = ("lyricAlignment", "phonemeConfidence", "pitchConfidence")
    return clip(F.greatest(*[F.coalesce(evidence[k], F.lit(0.0)) for k in keys]))


def bounded_sigmoid(value: Column, center, slope) -> Column:
    center = center if isinstance(center, Column) else F.lit(float(center))
    slope = slope if isinstance(slope, Column) else F.lit(float(slope))
    return F.lit(1.0) / (1.0 + F.exp(clip(-slope * (value - center), -20.0, 20.0)))


def policy_scores(
    candidates: DataFrame, rate: int, *, subdivisions: int = 4, acceptance: float = 0.42,
    uncertainty: float = 0.28, difficulty: float = 0.5,
) -> DataFrame:
    """Score and status of candidates that carry refined, tempo, evidence and semantic."""
    difficulty = min(1.0, max(0.0, difficulty))
    limit = min(1.0, max(0.0, acceptance + (0.5 - difficulty) * 0.12))
    chart = Lattice(rate, F.col("bpm"), F.col("beat_offset"), subdivisions).nearest(F.col("refined"))
    out = candidates.withColumns({"chart": chart, "lane": lane(F.col("primary_stem"))})
    out = out.withColumn("snap_error_ms", snap_error_ms(F.col("refined"), F.col("chart"), F.lit(rate)))
    out = out.withColumns(
        {
            "grid_confidence": grid_confidence(F.col("snap_error_ms")),
            "source_evidence": source_evidence(F.col("evidence"), F.col("lane")),
        }
    )
    acoustic = clip(0.68 * F.col("confidence") + 0.32 * F.col("salience"))
    score = clip(
        0.35 * F.element_at("source_evidence", F.col("lane")) + 0.25 * acoustic
        + 0.20 * F.col("grid_confidence") + 0.20 * semantic_score(F.col("semantic"))
    )
    status = F.when(score >= limit, "accepted").when(score >= uncertainty, "uncertain").otherwise("rejected")
    return out.withColumns({"score": score, "status": status})


def chart_policy(
    candidates: DataFrame, tl: Timeline, rate: int, *, difficulty: float = 0.5,
    spacing: int | None = None, enforce_density: bool = True, **thresholds,
) -> DataFrame:
    """Scored candidates; accepted ones thinned to one per cell and a minimum spacing.

    ``tl`` orders by the refined position.  Losers stay as rejected alternatives.
    """
    keys, order = list(tl.keys), tl.order
    scored = policy_scores(candidates, rate, difficulty=difficulty, **thresholds)
    if not enforce_density:
        return scored
    if spacing is None:
        spacing = max(1, round(rate * (0.045 - 0.030 * min(1.0, max(0.0, difficulty)))))
    # narrow cut: keeps the long score expression out of the pushed-down filter
    narrow = checkpointed(scored.select(*keys, *order, "chart", "score", "status"))
    accepted = narrow.filter("status = 'accepted'").drop("status")
    best = cell_winners(accepted, keys, "chart", "score", order)
    final = spaced_order(best, tl, spacing, "score").withColumn("_final", F.lit(True))
    out = scored.join(final, [*keys, *order], "left")
    return out.withColumn(
        "status",
        F.when((F.col("status") == "accepted") & F.col("_final").isNull(), "rejected").otherwise(F.col("status")),
    ).drop("_final")


def score_onsets(
    df: DataFrame, peak_height: float, peak_prominence: float, min_attack_ratio: float, bias: float,
    scales: int = 3,
) -> DataFrame:
    """Confidence and salience of a detected attack.

    Needs peak_value, prominence, votes, scale_votes, attack_ratio, local_floor,
    band activations and synchronization; attacks below the energy ratio are dropped.
    """
    families = family_count(F.col("votes"))
    possible = 4 + F.exists("votes", lambda v: v.startswith("stem_")).cast("int")
    votes = F.least(F.lit(1.0), families / possible)
    scale = F.col("scale_votes") / max(1, scales)
    attack = bounded_sigmoid(F.col("attack_ratio"), max(1.0, min_attack_ratio * 1.12), 3.2)
    confidence = clip(
        0.30 * bounded_sigmoid(F.col("peak_value"), peak_height, 10.0)
        + 0.24 * bounded_sigmoid(F.col("prominence"), peak_prominence, 14.0)
        + 0.22 * votes + 0.14 * scale + 0.10 * attack + bias
    )
    contrast = F.greatest(F.lit(0.0), F.col("peak_value") - F.col("local_floor"))
    loudness = F.least(F.lit(1.0), contrast / max(peak_height, 1e-5) * 0.8)
    activation = F.greatest("low_activation", "mid_activation", "high_activation")
    salience = clip(
        0.36 * F.col("confidence") + 0.28 * loudness + 0.24 * activation + 0.12 * F.col("synchronization")
    )
    attacks = df.filter(F.col("attack_ratio") >= min_attack_ratio)
    return attacks.withColumn("confidence", confidence).withColumn("salience", salience)


def band_evidence(df: DataFrame) -> DataFrame:
    """Band shares, activations, synchronisation and entropy at the attack frame.

    Needs the raw flux columns sub_low, low_mid, mid, high, air and their
    normalised versions with suffix ``_norm``.
    """

    def evidence(name: str) -> Column:
        x = F.col(f"{name}_norm")
        return x / (x + 1.75)

    tiny = F.lit(1e-10)
    raw = {
        "low": 0.58 * F.col("sub_low") + 0.42 * F.col("low_mid"),
        "mid": F.col("mid"),
        "high": 0.68 * F.col("high") + 0.32 * F.col("air"),
    }
    active = {
        "low": F.greatest(evidence("sub_low"), evidence("low_mid")),
        "mid": evidence("mid"),
        "high": F.greatest(evidence("high"), evidence("air")),
    }
    out = df.withColumns({f"_r_{b}": c for b, c in raw.items()} | {f"{b}_activation": c for b, c in active.items()})
    raw_total = F.greatest(F.col("_r_low") + F.col("_r_mid") + F.col("_r_high"), tiny)
    act_total = F.greatest(F.col("low_activation") + F.col("mid_activation") + F.col("high_activation"), tiny)
    shares = {b: F.col(f"_r_{b}") / raw_total for b in raw}
    mixed = {b: 0.72 * shares[b] + 0.28 * F.col(f"{b}_activation") / act_total for b in raw}
    total = F.greatest(mixed["low"] + mixed["mid"] + mixed["high"], tiny)
    entropy = None
    for share in shares.values():
        term = share * F.log(F.greatest(share, tiny))
        entropy = term if entropy is None else entropy + term
    activations = [F.col(f"{b}_activation") for b in raw]
    return out.withColumns(
        {f"{b}_share": m / total for b, m in mixed.items()}
        | {
            "synchronization": F.least(*activations),
            "broadband_strength": (activations[0] + activations[1] + activations[2]) / 3,
            "spectral_entropy": -entropy / F.log(F.lit(3.0)),
        }
    ).drop(*[f"_r_{b}" for b in raw])


def band_simple(low: Column, mid: Column, high: Column) -> Column:
    low, mid, high = (F.greatest(c, F.lit(0.0)) for c in (low, mid, high))
    return (
        F.when(low >= F.greatest(mid, high), "low_hit").when(high >= F.greatest(mid, low), "high_hit")
        .otherwise("mid_hit")
    )


def band_relative(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Track-relative band label from raw band flux: nine ordered rules."""
    rows = attach(df, strength_quantiles(df, keys), keys)
    tiny = F.lit(1e-10)
    mid = F.col("mid")
    out = rows.withColumns(
        {
            "_low": F.col("sub_low") + 0.65 * F.col("low_mid"),
            "_up": mid + 0.65 * F.col("high") + 0.35 * F.col("air"),
            "_hi": 0.65 * F.col("high") + 0.35 * F.col("air"),
        }
    )
    low, up, hi = F.col("_low"), F.col("_up"), F.col("_hi")
    total = F.greatest(low + up, tiny)
    up_ratio = up / F.greatest(low, tiny)
    low_mid_ratio = F.col("low_mid") / F.greatest(F.col("sub_low"), tiny)
    focus, share = hi / total, low / total
    above_mid = mid >= F.col("mid_floor")
    broad = (
        above_mid & (hi >= F.col("high_floor")) & (mid >= hi * 0.38)
        & ((share >= 0.55) | ((share >= 0.34) & (low >= F.col("balanced_low"))))
    )
    bright = (
        ((up_ratio >= 0.82) | ((hi >= mid * 2.0) & (focus >= 0.28)))
        & (low < F.col("low_high")) & ((focus >= 0.20) | above_mid)
    )
    label = (
        F.when(broad, "full_band_accent")
        .when(above_mid & ((low_mid_ratio >= 0.38) | (up_ratio >= 0.35)) & (mid >= hi * 1.12), "mid_hit")
        .when((up_ratio <= 0.20) | ((up <= F.col("upper_floor") * 1.08) & (low_mid_ratio < 0.34)), "low_hit")
        .when(bright, "high_hit")
        .when((low_mid_ratio >= 0.36) & (low < F.col("low_high")) & above_mid, "mid_hit")
        .when((low >= F.col("low_floor")) & (up >= F.col("upper_floor")), "full_band_accent")
        .when(focus >= 0.25, "high_hit")
        .when(low_mid_ratio >= 0.40, "mid_hit")
        .otherwise("low_hit")
    )
    facts = ["low_floor", "low_high", "balanced_low", "upper_floor", "mid_floor", "high_floor"]
    return out.withColumn("band", label).drop("_low", "_up", "_hi", *facts)


def select_chart(
    candidates: DataFrame, tl: Timeline, rate: int, config: Mapping[str, float], *,
    rescue_window: int | None = None, mode: str = "balanced",
) -> DataFrame:
    """Chart-worthy candidates with the first of five reasons; ``recall`` keeps all.

    Rows carry confidence, salience, votes, bpm, bpm_confidence and beat_offset.
    """
    if mode == "recall":
        return candidates.withColumn("reason", F.lit("recall"))
    window = rescue_window if rescue_window is not None else max(1, round(0.72 * rate))
    conf, sal = F.col("confidence"), F.col("salience")
    rows = candidates.withColumns({"_fam": family_count(F.col("votes")), "_local": conf + 0.28 * sal})
    rows = swept(rows, tl, window, maxima={"_top": F.col("_local")})
    bonus = 4.5 * clip((F.col("bpm_confidence") - 0.72) / 0.14)
    tolerance = (config["rhythmic_rescue_tolerance_ms"] + bonus) * rate / 1000.0
    wanted = config["chart_anchor_family_votes"]
    fam = F.col("_fam")
    rules = {
        "acoustic_anchor": (fam >= wanted) & (conf >= config["local_rescue_confidence"]),
        "strong_acoustic": (conf >= config["chart_anchor_confidence"]) & (sal >= config["chart_anchor_salience"]),
        "loud_acoustic": (fam >= max(3, wanted - 1)) & (sal >= min(0.95, config["chart_anchor_salience"] + 0.08)),
        "local_standout": (fam >= max(3, wanted - 1)) & (conf >= config["local_rescue_confidence"])
        & (F.col("_local") >= F.col("_top") * 0.96),
        "rhythm_rescue": (fam >= config["rhythmic_rescue_family_votes"])
        & (conf >= config["rhythmic_rescue_confidence"])
        & (min_grid_error(F.col(tl.pos), rate, F.col("bpm"), F.col("beat_offset")) <= tolerance),
    }
    reason = None
    for name, test in rules.items():
        reason = F.when(test, name) if reason is None else reason.when(test, name)
    return rows.withColumn("reason", reason).filter("reason is not null").drop("_fam", "_local", "_top")


def mora_score(df: DataFrame, dense: Column) -> DataFrame:
    """Score and status of a sung unit; ``dense`` marks seven or more per second."""
    h, e, s, p, r = (F.col(c) for c in ("phone_confidence", "energy", "spectral", "pitch", "rhythm"))
    fast = 0.55 * h + 0.15 * e + 0.15 * s + 0.05 * p + 0.10 * r
    normal = 0.38 * h + 0.22 * e + 0.18 * s + 0.12 * p + 0.10 * r
    score = F.when(dense, fast).otherwise(normal)
    floor = F.when(dense, 0.08).otherwise(0.14)
    weak = (F.greatest(e, s, p) < floor) & (h < 0.75)
    status = (
        F.when(weak, "rejected").when(score >= 0.42, "accepted").when(score >= 0.28, "uncertain")
        .otherwise("rejected")
    )
    return df.withColumns({"score": clip(score), "status": status})


def refine_boundary(
    spans: DataFrame, frames: DataFrame, keys: Sequence[str], hop: int, *, raw: str = "raw",
    lower: str = "lower", upper: str = "upper", span_id: str = "span_id",
) -> DataFrame:
    """Move a boundary to the best-scored frame of [lower, upper], ties to the nearest.

    ``frames`` lie at frame_idx * hop; a span is spread over the frame indices of
    its short window and joined on them.  The frame nearest to the raw boundary
    is a candidate at the raw position.  Below the evidence floor the raw boundary stays.
    """
    keys = list(keys)
    dense = F.col("dense")
    pos = F.col("frame_idx") * hop
    low_frame = F.ceil(F.col(lower) / hop).cast("bigint")
    high_frame = F.floor(F.col(upper) / hop).cast("bigint")
    # nearest frame, the earlier one on a tie; clamped to the curve's start
    home = F.greatest(F.ceil(F.col(raw) / hop - 0.5).cast("bigint"), F.lit(0))
    inside = F.when(low_frame <= high_frame, F.sequence(low_frame, high_frame)).otherwise(
        F.array().cast("array<bigint>")
    )
    options = F.concat(
        F.transform(inside, lambda f: F.struct(f.alias("frame_idx"), (f * hop).alias("at"), F.lit(0).alias("is_raw"))),
        F.array(F.struct(home.alias("frame_idx"), F.col(raw).cast("bigint").alias("at"), F.lit(1).alias("is_raw"))),
    )
    spread = spans.withColumn("_o", F.explode(options)).select(*spans.columns, "_o.*")
    joined = spread.join(frames.select(*keys, "frame_idx", "energy", "spectral", "pitch"), [*keys, "frame_idx"])
    c, e, s, p = F.col("confidence"), F.col("energy"), F.col("spectral"), F.col("pitch")
    score = F.when(dense, 0.58 * c + 0.14 * e + 0.18 * s + 0.10 * p).otherwise(
        0.34 * c + 0.24 * e + 0.27 * s + 0.15 * p
    )
    del pos
    rank = F.struct(
        F.round(score, 12).alias("score"), (-F.abs(F.col("at") - F.col(raw))).alias("close"),
        F.col("is_raw"), (-F.col("at")).alias("early"),
    )
    payload = F.struct("at", e.alias("energy"), s.alias("spectral"), p.alias("pitch"))
    best = joined.groupBy(*keys, span_id).agg(
        F.max_by(payload, rank).alias("_best"),
        F.max(F.when(F.col("is_raw") == 1, payload)).alias("_raw"),
        F.max(dense).alias("_dense"), F.max(raw).alias(raw),
    )
    peak = F.greatest("_best.energy", "_best.spectral", "_best.pitch")
    keep = peak >= F.when(F.col("_dense"), 0.20).otherwise(0.32)
    chosen = F.when(keep, F.col("_best")).otherwise(F.col("_raw"))
    return best.withColumn("_c", chosen).select(
        *keys, span_id, raw, F.col("_c.at").alias("refined"), "_c.energy", "_c.spectral", "_c.pitch",
        (keep & (F.col("_c.at") != F.col(raw))).alias("changed"),
    )


def anchor_confidence(df: DataFrame) -> Column:
    """Trust in a timed word from duration, activity, attack, shift and chunk match."""
    duration = F.exp(-F.abs(F.log(F.greatest(F.col("duration_ms"), F.lit(1.0)) / 340.0)) * 0.24)
    shift = F.exp(-F.greatest(F.lit(0.0), F.col("shift_ms") - 100.0) / 520.0)
    mixed = (
        0.15 + 0.25 * duration + 0.38 * F.col("activity") + 0.14 * F.col("attack")
        + 0.08 * F.col("acoustic_confidence")
    )
    return clip(mixed * shift * (0.62 + 0.38 * F.col("chunk_match")), 0.0, 0.94)


def routing_score(points: DataFrame, segments: DataFrame, tl: Timeline) -> DataFrame:
    """How much the focus map speaks for vocals at a point.

    segments: start, end, idx, source, confidence, vocal_evidence, vocal_alternative.
    No valid segment in the track scores .5, a gap between segments 0.
    """
    keys = list(tl.keys)
    valid = segments.filter(F.col("end") > F.col("start"))
    mapped = valid.groupBy(*keys).agg(F.lit(True).alias("_mapped"))
    facts = ["source", "confidence", "vocal_evidence", "vocal_alternative"]
    named = valid.select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("idx").alias("_i"),
                         *[F.col(c).alias(f"_{c}") for c in facts])
    hit = interval_join(points, named, tl, "_s", "_e", "_i", [f"_{c}" for c in facts])
    zero = F.lit(0.0)
    own = F.when(F.col("_source") == "vocals", F.coalesce(F.col("_confidence"), F.lit(1.0))).otherwise(zero)
    inside = clip(F.greatest(F.coalesce("_vocal_evidence", zero), F.coalesce("_vocal_alternative", zero), own))
    score = F.when(F.col("_i").isNotNull(), inside).when(F.col("_mapped"), 0.0).otherwise(0.5)
    out = attach(hit, mapped, keys)
    return out.select(*points.columns, score.alias("routing"))


def hit_salience(confidence: Column, activity: Column, attack: Column, routing: Column) -> Column:
    return clip(0.14 + 0.39 * confidence + 0.23 * activity + 0.14 * attack + 0.10 * routing)


def fallback_salience(confidence: Column, activity: Column, attack: Column) -> Column:
    return clip(0.20 + 0.42 * confidence + 0.23 * activity + 0.15 * attack)


def energy_confidence(activity: Column, attack: Column, rise: Column, grid: Column, prominence: Column) -> Column:
    total = 0.18 + 0.25 * activity + 0.22 * attack + 0.17 * rise + 0.13 * grid + 0.05 * clip(prominence)
    return clip(total, 0.0, 0.72)


# fixed values: confidence floor and minimum spacing (ms) per lane
LANE_FLOOR = {"vocals": 0.24, "drums": 0.22, "bass": 0.30, "other": 0.26, "mix": 0.40}
LANE_SPACING_MS = {"vocals": 72.0, "drums": 34.0, "bass": 58.0, "other": 56.0, "mix": 48.0}


def soft_route(candidates: DataFrame, tl: Timeline, samples_per_ms: float) -> DataFrame:
    """Lane gate: foreground activity, confidence floor, lane spacing, prefixed votes.

    Rows carry lane, activity, confidence, salience, prominence and votes.
    """
    keys = list(tl.keys)
    pairs = [F.lit(x) for pair in LANE_FLOOR.items() for x in pair]
    floor = F.element_at(F.create_map(*pairs), F.col("lane"))
    present = (F.col("lane") == "mix") | (F.col("activity") >= 0.035)
    sure = (F.col("confidence") >= floor) | (F.col("salience") >= F.least(F.lit(0.92), floor + 0.12))
    open_rows = candidates.filter(present & sure).withColumn(
        "_quality", F.col("confidence") + 0.34 * F.col("salience") + 0.08 * F.col("prominence")
    )
    spacing = {lane: max(1, round(samples_per_ms * ms)) for lane, ms in LANE_SPACING_MS.items()}
    apart = F.create_map(*[F.lit(x) for pair in spacing.items() for x in pair])
    # the spacing is a fact of the lane, so all lanes walk in one pass
    open_rows = open_rows.filter(F.col("lane").isin(*spacing)).withColumn("_apart", F.element_at(apart, F.col("lane")).cast("bigint"))
    lane_line = Timeline([*keys, "lane", "_apart"], tl.pos, tl.tie, tl.width)
    kept = spaced(open_rows, lane_line, "_apart", "_quality", max(spacing.values()) * SLICES_PER_WINDOW)
    votes = F.array_append(
        F.transform("votes", lambda v: F.concat(F.col("lane"), F.lit(":"), v)),
        F.concat(F.lit("soft_route_"), F.col("lane")),
    )
    return kept.withColumn("votes", votes).drop("_quality", "_apart")


def fallback_events(
    events: DataFrame, energy_peaks: DataFrame, chunks: DataFrame, tl: Timeline, lattice: Lattice
) -> DataFrame:
    """Events inside chunks that did not succeed; energy peaks where that gave nothing."""
    keys = list(tl.keys)
    failed = chunks.filter("status <> 'success'").select(*keys, "idx", "start", "end")
    first = interval_join(events, failed, tl, "start", "end", "idx", how="inner")
    covered = first.select(*keys, "idx").distinct()
    empty = failed.join(covered, [*keys, "idx"], "left_anti")
    second = interval_join(energy_peaks, empty, tl, "start", "end", "idx", how="inner")
    both = first.withColumn("level", F.lit("onset")).unionByName(second.withColumn("level", F.lit("energy")))
    return both.withColumn("chart", lattice.nearest(F.col(tl.pos)))


VOWELS = ["a", "i", "u", "e", "o"]


def vowel_splits(moras: DataFrame, phones: DataFrame, keys: Sequence[str], min_gap: int) -> DataFrame:
    """Extra attacks inside long vowels: an observed vowel phone with a pitch change.

    moras: mora_idx, kind, refined, phone_indices; phones: phone_idx, phoneme,
    confidence, pitch, refined, observed.
    """
    keys = list(keys)
    long = F.col("kind").isin("long_vowel", "sustain")
    links = moras.filter(long).select(
        *keys, "mora_idx", F.col("refined").alias("base"), F.explode("phone_indices").alias("phone_idx")
    )
    plain = F.regexp_replace(F.trim(F.lower("phoneme")), "[:ː]", "")
    joined = links.join(phones.filter("observed"), [*keys, "phone_idx"])
    enough = Window.partitionBy(*keys, "mora_idx")
    counted = joined.withColumn("_n", F.count("*").over(enough))
    return counted.filter(
        (F.col("_n") >= 2) & plain.isin(VOWELS) & (F.col("confidence") >= 0.20) & (F.col("pitch") >= 0.35)
        & (F.col("refined") - F.col("base") >= min_gap)
    ).select(*keys, "mora_idx", "phone_idx", F.col("refined").alias("split_at"), "confidence", "pitch")
