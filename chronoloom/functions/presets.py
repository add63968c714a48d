"""Detection presets and the sensitivity rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: thresholds of the four presets
DEFAULTS = {
    "minimum_interval_ms": 16.0,
    "merge_window_ms": 9.0,
    "peak_height": 0.44,
    "peak_prominence": 0.150,
    "individual_vote_height": 1.45,
    "family_vote_prominence": 0.34,
    "minimum_family_votes": 2.0,
    "strong_peak_override_ratio": 1.55,
    "individual_support_height_ratio": 1.0,
    "individual_support_prominence_ratio": 1.0,
    "tail_suppression_ms": 52.0,
    "tail_strength_ratio": 0.62,
    "minimum_attack_energy_ratio": 1.08,
    "minimum_candidate_confidence": 0.34,
    "chart_anchor_family_votes": 4.0,
    "chart_anchor_confidence": 0.58,
    "chart_anchor_salience": 0.62,
    "rhythmic_rescue_family_votes": 3.0,
    "rhythmic_rescue_confidence": 0.34,
    "rhythmic_rescue_tolerance_ms": 3.0,
    "local_rescue_confidence": 0.48,
    "confidence_bias": 0.0,
}
PRESETS = {
    "recall": {
        "minimum_interval_ms": 12.0, "merge_window_ms": 8.0, "peak_height": 0.34,
        "peak_prominence": 0.085, "individual_vote_height": 1.18, "family_vote_prominence": 0.24,
        "minimum_family_votes": 1.0, "strong_peak_override_ratio": 1.35,
        "individual_support_height_ratio": 0.72, "individual_support_prominence_ratio": 0.65,
        "tail_strength_ratio": 0.72, "minimum_attack_energy_ratio": 0.92,
        "minimum_candidate_confidence": 0.20, "chart_anchor_family_votes": 3.0,
        "chart_anchor_confidence": 0.42, "chart_anchor_salience": 0.46,
        "rhythmic_rescue_family_votes": 2.0, "rhythmic_rescue_confidence": 0.24,
        "rhythmic_rescue_tolerance_ms": 7.0, "local_rescue_confidence": 0.32,
        "confidence_bias": -0.05,
    },
    "balanced": {
        "peak_height": 0.49, "peak_prominence": 0.165, "individual_vote_height": 1.35,
        "individual_support_height_ratio": 0.72, "individual_support_prominence_ratio": 0.65,
        "tail_strength_ratio": 0.82, "minimum_attack_energy_ratio": 0.90,
    },
    "clean": {
        "minimum_interval_ms": 24.0, "merge_window_ms": 11.0, "peak_height": 0.60,
        "peak_prominence": 0.20, "individual_vote_height": 1.95, "family_vote_prominence": 0.42,
        "minimum_family_votes": 3.0, "strong_peak_override_ratio": 1.75,
        "tail_suppression_ms": 68.0, "tail_strength_ratio": 0.88,
        "minimum_attack_energy_ratio": 1.20, "minimum_candidate_confidence": 0.48,
        "chart_anchor_family_votes": 4.0, "chart_anchor_confidence": 0.62,
        "chart_anchor_salience": 0.66, "rhythmic_rescue_family_votes": 4.0,
        "rhythmic_rescue_confidence": 0.46, "rhythmic_rescue_tolerance_ms": 3.0,
        "local_rescue_confidence": 0.52, "confidence_bias": 0.08,
    },
    "accurate": {
        "minimum_interval_ms": 14.0, "merge_window_ms": 8.0, "peak_height": 0.43,
        "peak_prominence": 0.13, "individual_vote_height": 1.42, "family_vote_prominence": 0.28,
        "minimum_family_votes": 2.0, "strong_peak_override_ratio": 1.42,
        "individual_support_height_ratio": 0.72, "individual_support_prominence_ratio": 0.65,
        "tail_strength_ratio": 0.76, "minimum_attack_energy_ratio": 1.02,
        "minimum_candidate_confidence": 0.28, "chart_anchor_family_votes": 4.0,
        "chart_anchor_confidence": 0.48, "chart_anchor_salience": 0.52,
        "rhythmic_rescue_family_votes": 2.0, "rhythmic_rescue_confidence": 0.30,
        "rhythmic_rescue_tolerance_ms": 5.5, "local_rescue_confidence": 0.38,
    },
}
#: threshold -> (slope against sensitivity, floor)
SENSITIVE = {
    "peak_height": (0.45, 0.08),
    "peak_prominence": (0.35, 0.015),
    "individual_vote_height": (0.50, 0.75),
}


def config_table(spark: SparkSession) -> DataFrame:
    """One row per preset; always four rows."""
    rows = [(mode, *{**DEFAULTS, **over}.values()) for mode, over in PRESETS.items()]
    ddl = "mode string, " + ", ".join(f"{name} double" for name in DEFAULTS)
    return spark.createDataFrame(rows, ddl)


def sensitive(threshold: str, sensitivity: Column) -> Column:
    slope, floor = SENSITIVE[threshold]
    moved = F.col(threshold) * (F.lit(1.0) - F.lit(slope) * (sensitivity - F.lit(0.5)))
    return F.greatest(F.lit(floor), moved)


def with_config(df: DataFrame, mode: str = "mode", sensitivity: str = "sensitivity") -> DataFrame:
    """Attach the preset of ``mode``, thresholds shifted by ``sensitivity`` (0..1).

    The preset table has four fixed rows, so it is broadcast.
    """
    presets = config_table(df.sparkSession).withColumnRenamed("mode", mode)
    joined = df.join(F.broadcast(presets), mode)
    return joined.withColumns({name: sensitive(name, F.col(sensitivity)) for name in SENSITIVE})
