"""Signal jobs on PCM chunks, frames and pitch tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.groups import map_groups
from ..core.quantiles import attach, curve_quantiles, exact_quantiles
from ..core.timeline import Timeline, near, neighbours
from ..functions.lattice import Lattice
from .joins import interval_join
from .peaks import find_peaks, gradient
from .projections import clip
from .scoring import energy_confidence
from .sequences import smooth

# --------------------------------------------------------------------------
# level


def normalise_level(chunks: DataFrame, samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Remove the median, scale the q99.5 to .92 (gain at most 32), clip to [-1, 1].

    ``samples`` are the values of the same chunks, one per row (``value``).
    """
    keys = list(keys)
    dc = exact_quantiles(samples, keys, F.col("value"), {"dc": 0.5}).drop("n")
    centred = attach(samples, dc, keys).withColumn("_c", F.abs(F.col("value") - F.col("dc")))
    peak = exact_quantiles(centred, keys, F.col("_c"), {"_peak": 0.995}).drop("n")
    gain = F.when(F.col("_peak") < 1e-8, 1.0).otherwise(F.least(F.lit(32.0), 0.92 / F.col("_peak")))
    facts = dc.join(peak, keys).withColumn("gain", gain).drop("_peak")
    scaled = F.transform("samples", lambda x: clip((x - F.col("dc")) * F.col("gain"), -1.0, 1.0))
    return attach(chunks, facts, keys).withColumn("samples", scaled)


# --------------------------------------------------------------------------
# frame features


def _hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def _frames(x: np.ndarray, first: int, count: int, size: int, hop: int) -> np.ndarray:
    """``count`` windows of ``size``, the first centred on ``first``; zeros outside."""
    start = first - size // 2
    end = start + (count - 1) * hop + size
    padded = np.pad(x, (max(0, -start), max(0, end - len(x))))
    at = start + max(0, -start)
    view = np.lib.stride_tricks.sliding_window_view(padded[at : at + (count - 1) * hop + size], size)
    return view[::hop]


def _spectrum(x, first, count, size, hop) -> np.ndarray:
    window = _hann(size)
    return np.fft.rfft(_frames(x, first, count, size, hop) * window, axis=1) / window.sum()


def _flux(magnitude: np.ndarray) -> np.ndarray:
    """Rise of the log-compressed, per-frame normalised spectrum; first row only seeds."""
    logs = np.log1p(80.0 * magnitude)
    unit = logs / np.maximum(np.linalg.norm(logs, axis=1, keepdims=True), 1e-10)
    return np.maximum(np.diff(unit, axis=0), 0.0).sum(axis=1)


def _running_median(values: np.ndarray, size: int, axis: int) -> np.ndarray:
    half = size // 2
    pad = [(half, half) if a == axis else (0, 0) for a in range(2)]
    padded = np.pad(values, pad, mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, size, axis=axis), axis=-1)


def _percussive(x: np.ndarray, low: int, high: int, margin: float = 1.5, kernel: int = 31) -> np.ndarray:
    """Percussive part by median masks on a 1024/256 grid that starts at x[0].

    Only x[low:high] is wanted: frames that do not reach it are seen by the masks of others and left out themselves.
    """
    size, hop = 1024, 256
    count = len(x) // hop + 1
    a, b = max(0, (low - size // 2) // hop), min(count, (high + size // 2) // hop + 1)
    spectrum = _spectrum(x, 0, count, size, hop)
    level = np.abs(spectrum)
    # rows beyond the ends repeat the first and the last one
    rows = np.clip(np.arange(a - kernel // 2, b + kernel // 2), 0, count - 1)
    harmonic = np.median(np.lib.stride_tricks.sliding_window_view(level[rows], kernel, axis=0), axis=-1) ** 2
    percussive = (_running_median(level[a:b], kernel, 1) / margin) ** 2
    masked = spectrum[a:b] * (percussive / (harmonic + percussive + 1e-10))
    window = _hann(size)
    out = np.zeros((count - 1) * hop + size)
    norm = np.zeros_like(out)
    parts = np.fft.irfft(masked * window.sum(), n=size, axis=1) * window
    for i, part in enumerate(parts, a):
        out[i * hop : i * hop + size] += part
        norm[i * hop : i * hop + size] += window**2
    return (out / np.maximum(norm, 1e-10))[size // 2 : size // 2 + len(x)]


# fixed values: analysis grid, FFT sizes and band edges (Hz)
HOP, FFT_SIZES, FINE_FFT = 128, (1024, 2048, 4096), 512
BAND_EDGES = {"sub_low": (20, 180), "low_mid": (180, 800), "mid": (800, 3000), "high": (3000, 8000), "air": (8000, None)}
FEATURES = [
    *[f"mix_flux_scale_{n}" for n in FFT_SIZES], "mix_flux", "percussive_flux", *BAND_EDGES, "rms",
    "energy_derivative", "rms_derivative", "hfc_change", "fine_flux",
]
#: samples a frame may depend on beyond its chunk: 16 mask frames, a window, a hop
HALO = 16 * 256 + 1024 + 4096


def frame_features(chunks: DataFrame, keys: Sequence[str], rate: int, chunk: int) -> DataFrame:
    """Onset curves of PCM chunks, one row per frame of 128 samples.

    Each chunk gets only the last and first ``HALO`` samples of its neighbours, so a
    track of any length is split over tasks and the frames equal those of the whole
    track.  ``chunk`` is a multiple of 256 and at least ``HALO``.
    """
    if chunk % 256 or chunk < HALO:
        raise ValueError(f"chunk must be a multiple of 256 and at least {HALO}")
    keys = list(keys)
    n = F.size("samples")
    own = F.struct(F.col("chunk_idx").alias("c"), F.col("start_sample").alias("s"), F.col("samples").alias("v"))
    tail = F.struct(
        (F.col("chunk_idx") + 1).alias("c"), (F.col("start_sample") + F.greatest(n - HALO, F.lit(0))).alias("s"),
        F.slice("samples", F.greatest(n - HALO, F.lit(0)) + 1, F.lit(HALO)).alias("v"),
    )
    head = F.struct(
        (F.col("chunk_idx") - 1).alias("c"), F.col("start_sample").alias("s"), F.slice("samples", 1, HALO).alias("v")
    )
    parts = chunks.select(*keys, "sample_count", F.explode(F.array(tail, own, head)).alias("p")).select(
        *keys, "sample_count", F.col("p.c").alias("chunk_idx"), F.col("p.s").alias("s"), F.col("p.v").alias("v")
    )

    def solve(g):
        x = np.concatenate([np.asarray(v, dtype=np.float64) for v in g["v"]])
        origin, total = int(g["s"][0]), int(g["sample_count"][0])
        begin = int(g["chunk_idx"][0]) * chunk
        if begin >= total or begin < 0:
            return None  # only a neighbour's halo, no chunk of its own
        stop = min(total, begin + chunk)
        # frames centred in the chunk; the last chunk also owns the closing one
        last = (stop - 1) // HOP if stop < total else -(-total // HOP)
        first = -(-begin // HOP)
        count = last - first + 1
        seed = 1 if first > 0 else 0  # the frame before gives the first difference

        def rise(values):
            # very first frame of a track has nothing to rise from
            return values if seed else np.concatenate(([values[0] * 0.0], values))

        def magnitude(signal, size, hop, at, frames):
            return np.abs(_spectrum(signal, at - origin, frames, size, hop))

        frames, at = count + seed, (first - seed) * HOP
        out = {"frame_idx": np.arange(first, last + 1, dtype=np.int64)}
        base = None
        for size in FFT_SIZES:
            level = magnitude(x, size, HOP, at, frames)
            base = level if base is None else base
            out[f"mix_flux_scale_{size}"] = rise(_flux(level))
        out["mix_flux"] = np.mean([out[f"mix_flux_scale_{size}"] for size in FFT_SIZES], axis=0)
        soft = _percussive(x, at - origin - FFT_SIZES[0], at - origin + frames * HOP + FFT_SIZES[0])
        out["percussive_flux"] = rise(_flux(magnitude(soft, FFT_SIZES[0], HOP, at, frames)))
        logs = np.log1p(80.0 * base)
        growth = np.maximum(np.diff(logs, axis=0), 0.0)
        hertz = np.fft.rfftfreq(FFT_SIZES[0], 1.0 / rate)
        for band, (low, high) in BAND_EDGES.items():
            mask = (hertz >= low) & (hertz < high if high else True)
            out[band] = rise(growth[:, mask].mean(axis=1) if mask.any() else np.zeros(len(growth)))
        size = FFT_SIZES[0] // 4
        power = np.concatenate(([0.0], np.cumsum(np.pad(x * x, (size, size), mode="edge"))))
        where = np.minimum(at + np.arange(frames) * HOP, total - 1) - origin + size - size // 2
        rms = np.sqrt(np.maximum(power[where + size] - power[where], 0.0) / size)
        out["rms"] = rms[seed:]
        out["energy_derivative"] = rise(np.maximum(np.diff(rms**2), 0.0))
        out["rms_derivative"] = rise(np.maximum(np.diff(rms), 0.0))
        high_content = (logs * (hertz / hertz[-1])).mean(axis=1)
        out["hfc_change"] = rise(np.maximum(np.diff(high_content), 0.0))
        # the fine grid has two frames per hop; a coarse frame takes the one on it
        start = first * HOP - HOP // 2 if first else 0
        fine = _flux(magnitude(x, FINE_FFT, HOP // 2, start, 2 * count if first else 2 * count - 1))
        out["fine_flux"] = fine[::2] if first else np.concatenate(([0.0], fine[1::2]))
        return out

    ddl = "frame_idx bigint, " + ", ".join(f"{f} double" for f in FEATURES)
    return map_groups(parts, [*keys, "chunk_idx"], ["s"], solve, ddl).drop("chunk_idx")


def fuse(frames: DataFrame, tl: Timeline, suffix: str = "_norm", sigma: float | None = 0.72) -> DataFrame:
    """Fused onset curve: six evidence families with fixed weights and a primary boost."""

    def e(name: str) -> Column:
        x = F.col(f"{name}{suffix}")
        return x / (x + 1.75)

    spectral = 0.55 * e("mix_flux") + 0.45 * e("fine_flux")
    percussive = e("percussive_flux")
    total = (
        0.27 * spectral + 0.24 * percussive + 0.17 * F.greatest(e("energy_derivative"), e("rms_derivative"))
        + 0.13 * F.greatest(e("sub_low"), 0.82 * e("low_mid")) + 0.08 * e("mid")
        + 0.11 * F.greatest(e("high"), 0.82 * e("air"), 0.78 * e("hfc_change"))
    )
    out = frames.withColumn("fused", total * (0.76 + 0.24 * F.greatest(spectral, percussive)))
    return out if sigma is None else smooth(out, tl, "fused", sigma)


# --------------------------------------------------------------------------
# attack refinement


def novelty_curve(samples: DataFrame, tl: Timeline, smoothing: int, value: str = "value") -> DataFrame:
    """Sample-level novelty: envelope rise, percussive rise and waveform change.

    Rows: keys, ``tl.pos`` (dense), ``value`` and ``percussive``.  Window sums end at
    the borders of a track.  ``smoothing`` is the window in samples (odd).
    """
    keys = list(tl.keys)
    half = smoothing // 2
    square = lambda c: F.col(c) * F.col(c)
    out = near(samples, tl, half, half, {"_ev": F.avg(square(value)), "_ep": F.avg(square("percussive"))})
    out = out.withColumns({"_ev": F.sqrt("_ev"), "_ep": F.sqrt("_ep")})
    out = neighbours(out, tl, 1, prev={"_pv": F.col("_ev"), "_pp": F.col("_ep"), "_px": F.col(value)})
    out = out.withColumns(
        {
            "_rv": F.greatest(F.col("_ev") - F.coalesce("_pv", "_ev"), F.lit(0.0)),
            "_rp": F.greatest(F.col("_ep") - F.coalesce("_pp", "_ep"), F.lit(0.0)),
            "_d": F.abs(F.col(value) - F.coalesce("_px", value)),
        }
    )
    small = max(3, smoothing // 2)
    out = near(out, tl, small // 2, small - small // 2 - 1, {"_w": F.avg("_d")})
    scales = curve_quantiles(out, keys, {f"_q{c}": (F.col(c), 0.995) for c in ("_rv", "_rp", "_w")}).drop("n")
    out = attach(out, scales, keys)

    def unit(column: str) -> Column:
        return F.col(column) / F.greatest(F.col(f"_q{column}"), F.lit(1e-8))

    out = out.withColumn("novelty", 0.46 * unit("_rv") + 0.34 * unit("_rp") + 0.20 * unit("_w"))
    return smooth(out.select(*samples.columns, "novelty"), tl, "novelty", max(0.55, smoothing / 5.0))


def refine_attack(
    peaks: DataFrame, curve: DataFrame, keys: Sequence[str], rate: int, *, pre_ms: float = 24.0, post_ms: float = 18.0,
    backtrack_ms: float = 20.0, max_shift_ms: float = 8.0, ratio: float = 0.18,
) -> DataFrame:
    """Move a coarse peak to the start of its local rise.

    peaks: keys, id, detected; curve: keys, pos, value, novelty (dense).  Every peak is
    joined with the few milliseconds around it and solved on its own.
    """
    keys = list(keys)
    pre, post = round(rate * pre_ms / 1000), round(rate * post_ms / 1000)
    lead, departure = int(rate * 0.008), int(rate * 0.0015)
    back, most = round(rate * backtrack_ms / 1000), round(rate * max_shift_ms / 1000)
    # the noise floor needs a little more than the search window
    spread = peaks.select(
        *keys, "id", "detected",
        F.explode(F.sequence(F.col("detected") - pre - lead - departure, F.col("detected") + post)).alias("pos"),
    )
    local = spread.join(curve.select(*keys, "pos", "value", "novelty"), [*keys, "pos"])

    def solve(g):
        at, detected = g["pos"], int(g["detected"][0])
        inside = np.flatnonzero(at >= detected - pre)
        if inside.size < 3:
            return {"refined": [detected]}
        novelty = g["novelty"][inside]
        peak = int(np.argmax(novelty))
        if novelty[peak] <= 1e-10:
            return {"refined": [detected]}
        low = novelty[max(0, peak - back) : peak] <= novelty[peak] * ratio
        attack = max(0, peak - back)
        if low.any():
            attack += int(np.flatnonzero(low)[-1]) + 1
        loud = np.abs(g["value"])
        base = int(inside[0])
        begin = max(0, attack - departure)
        part = loud[base + begin : base + peak + 1]
        quiet = loud[max(0, base + begin - lead) : base + begin]
        noise = float(np.median(quiet)) if quiet.size else 0.0
        over = np.flatnonzero(part >= max(noise * 5.0, float(part.max()) * 0.015, 1e-6)) if part.size else []
        if len(over):
            attack = begin + int(over[0])
        refined = int(at[base + attack])
        return {"refined": [refined if abs(refined - detected) <= most else detected]}

    found = map_groups(local, [*keys, "id"], ["pos"], solve, "refined bigint")
    return peaks.join(found, [*keys, "id"], "left").withColumn("refined", F.coalesce("refined", "detected"))


# --------------------------------------------------------------------------
# events on frame tables


def melody_events(frames: DataFrame, tl: Timeline, distance: int) -> DataFrame:
    """Note starts and re-attacks of a pitch track.

    frames: keys, frame index, midi (null when unvoiced), voiced, probability, rms.
    """
    keys = list(tl.keys)
    out = gradient(frames, tl, "rms", "_g").withColumn("_rise", F.greatest(F.col("_g"), F.lit(0.0)))
    reference = exact_quantiles(out, keys, F.col("_rise"), {"_ref": 0.94}).drop("n")
    sung = F.coalesce(F.col("voiced") & F.col("midi").isNotNull() & (F.col("probability") >= 0.42), F.lit(False))
    out = attach(out, reference, keys).withColumn("_sung", sung)
    out = neighbours(out, tl, 1, prev={"_before": F.when(F.col("_sung"), F.col("midi"))})
    jump = F.abs(F.col("midi") - F.col("_before"))
    rise = clip(F.col("_rise") / F.greatest(F.col("_ref"), F.lit(1e-9)))
    kind = F.when(F.col("_before").isNull() | (jump >= 0.75), "pitch_onset").when(rise >= 0.72, "energy_reattack")
    out = out.withColumn("kind", F.when(F.col("_sung"), kind))
    bonus = F.when(F.col("kind") == "pitch_onset", 0.18).otherwise(0.0)
    chance = clip(F.col("probability"))
    out = out.withColumn("_score", F.when(F.col("kind").isNotNull(), chance + bonus).otherwise(0.0))
    picked = find_peaks(out, tl, "_score", height=0.42, distance=distance)
    chance = clip(F.col("probability"))
    return picked.select(
        *keys, tl.pos, "kind", clip(0.30 + 0.62 * chance, 0.0, 0.94).alias("confidence"),
        clip(0.25 + 0.55 * chance, 0.0, 0.9).alias("salience"),
    )


def vocal_events(frames: DataFrame, tl: Timeline, distance: int) -> DataFrame:
    """Sung attacks from onset, envelope, spectral and pitch change curves.

    frames: keys, frame index, onset, rms, flux, pitch_change (semitones).
    """
    keys = list(tl.keys)
    out = gradient(frames, tl, "rms", "_g").withColumn("_env", F.greatest(F.col("_g"), F.lit(0.0)))
    rms = F.col("rms")
    marks = curve_quantiles(
        out, keys,
        {"_q90": (rms, 0.9), "_q20": (rms, 0.2), "_qo": (F.col("onset"), 0.98), "_qe": (F.col("_env"), 0.98),
         "_qf": (F.col("flux"), 0.98)},
    ).drop("n")
    out = attach(out, marks, keys)
    loud, noise = F.greatest("_q90", F.lit(1e-9)), F.greatest("_q20", F.lit(1e-9))
    floor = F.greatest(F.lit(10.0 ** (-52 / 20)), loud * 0.025, noise * 5.0)
    out = out.withColumns({"_floor": floor, "_loud": loud}).withColumn(
        "activity", clip((F.col("rms") - F.col("_floor")) / F.greatest(F.col("_loud") - F.col("_floor"), F.lit(1e-9)))
    )

    def unit(column: str, q: str) -> Column:
        return clip(F.col(column) / F.greatest(F.col(q), F.lit(1e-9)), 0.0, 1.5)

    pitch = F.when(F.col("activity") > 0.05, F.col("pitch_change")).otherwise(0.0)
    out = out.withColumns(
        {"onset_score": unit("onset", "_qo"), "envelope_score": unit("_env", "_qe"),
         "transition_score": unit("flux", "_qf"), "pitch_score": clip(pitch / 2.0, 0.0, 1.5)}
    )
    mixed = (
        0.34 * F.col("onset_score") + 0.25 * F.col("envelope_score") + 0.23 * F.col("transition_score")
        + 0.18 * F.col("pitch_score")
    )
    out = out.withColumn("novelty", mixed * clip(F.col("activity") + 0.18))
    picked = find_peaks(out, tl, "novelty", height=0.16, prominence=0.045, distance=distance)
    confidence = clip(
        0.16 + 0.24 * F.col("onset_score") + 0.18 * F.col("envelope_score") + 0.18 * F.col("pitch_score")
        + 0.16 * F.col("transition_score") + 0.08 * F.col("activity") + 0.05 * F.col("prominence"), 0.0, 0.94,
    )
    scores = ["onset_score", "envelope_score", "pitch_score", "transition_score", "activity"]
    return picked.filter(F.col("rms") >= F.col("_floor")).select(
        *keys, tl.pos, confidence.alias("confidence"), *[clip(F.col(c)).alias(c) for c in scores]
    )


def energy_anchors(
    frames: DataFrame, chunks: DataFrame, tl: Timeline, lattice: Lattice, hop: int, distance: int
) -> DataFrame:
    """Energy peaks near a lattice line inside the given chunks.

    frames: keys, frame index, rms, attack.  The lattice only ranks measured rises; it
    never fills a cell without one.
    """
    keys = list(tl.keys)
    out = gradient(frames, tl, "rms", "_g").withColumn("_rise", F.greatest(F.col("_g"), F.lit(0.0)))
    rms = F.col("rms")
    marks = curve_quantiles(
        out, keys,
        {"_q90": (rms, 0.9), "_q20": (rms, 0.2), "_qa": (F.col("attack"), 0.99), "_qr": (F.col("_rise"), 0.99)},
    ).drop("n")
    tiny = F.lit(1e-9)
    out = attach(out, marks, keys)
    loud, noise = F.greatest("_q90", tiny), F.greatest("_q20", tiny)
    floor = F.greatest(F.lit(10.0 ** (-52 / 20)), loud * 0.025, noise * 6.0)
    strike, climb = F.col("attack") / F.greatest("_qa", tiny), F.col("_rise") / F.greatest("_qr", tiny)
    out = out.withColumns(
        {
            "novelty": 0.62 * clip(strike, 0.0, 1.5) + 0.38 * clip(climb, 0.0, 1.5), "_floor": floor,
            "activity": clip((F.col("rms") - floor) / F.greatest(loud - floor, tiny)),
            "attack_score": clip(strike), "rise_score": clip(climb),
        }
    )
    picked = find_peaks(out, tl, "novelty", height=0.10, prominence=0.025, distance=distance)
    picked = picked.filter(F.col("rms") >= F.col("_floor")).withColumn("acoustic", F.col(tl.pos) * hop)
    line = Timeline(keys, "acoustic", (), tl.width * hop)
    placed = interval_join(picked, chunks, line, "start", "end", "idx", how="inner")
    placed = placed.withColumn("chart", lattice.nearest(F.col("acoustic")))
    steps = F.abs(F.col("acoustic") - F.col("chart")) / F.greatest(lattice.step(), F.lit(1.0))
    placed = placed.withColumn("grid_confidence", F.exp(-0.5 * F.pow(steps / 0.35, F.lit(2.0))))
    good = (
        (F.col("grid_confidence") >= 0.18) & (F.col("activity") >= 0.08)
        & (F.greatest("attack_score", "rise_score") >= 0.10)
    )
    confidence = energy_confidence(
        F.col("activity"), F.col("attack_score"), F.col("rise_score"), F.col("grid_confidence"), F.col("prominence")
    )
    return placed.filter(good).select(
        *keys, "acoustic", "chart", "idx", confidence.alias("confidence"), "activity", "attack_score", "rise_score",
        "grid_confidence",
    )
