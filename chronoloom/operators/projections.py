"""Row-local projections, filters and checks on hits, candidates and projects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lattice import Lattice

STEMS = ["mix", "vocals", "drums", "bass", "other"]
BANDS = ["low_hit", "mid_hit", "high_hit", "full_band_accent"]
SOURCES = ["mix", "percussive", "stems", "fused", "manual"]
PROJECT_STATES = ["unprocessed", "processing", "completed", "edited", "failed"]


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def search_projects(
    df: DataFrame, search: str | None = None, status: str | None = None
) -> DataFrame:
    """Case-insensitive substring on title or artist, newest first, with the total.

    ``total`` is a scalar subquery, not a window over everything.
    """
    if status is not None and status not in PROJECT_STATES:
        raise ValueError(f"unknown project status: {status}")
    found = df
    if search:
        pattern = f"%{search.strip()}%"
        found = found.filter(F.col("title").ilike(pattern) | F.col("artist").ilike(pattern))
    if status:
        found = found.filter(F.col("status") == status)
    total = found.select(F.count("*")).scalar()
    return found.withColumn("total", total).orderBy(F.desc("updated_at"))


@dataclass(frozen=True)
class MarkerFilter:
    """Conjunctive display filter; ``band='manual'`` selects by source instead."""

    band: str = "all"
    stem: str = "all"
    min_confidence: float = 0.0
    only_unedited: bool = False
    only_low_confidence: bool = False
    only_off_grid: bool = False

    def predicate(self) -> Column:
        tests = [F.col("confidence") >= F.lit(self.min_confidence)]
        if self.band == "manual":
            tests.append(F.col("source") == "manual")
        elif self.band != "all":
            tests.append(F.col("band") == self.band)
        if self.stem != "all":
            tests.append(F.coalesce(F.col("primary_stem"), F.lit("mix")) == self.stem)
        if self.only_unedited:
            tests.append(~F.col("edited"))
        if self.only_low_confidence:
            tests.append(F.col("confidence") < 0.5)
        if self.only_off_grid:
            tests.append(F.abs("snap_error_ms") > 25)
        result = tests[0]
        for test in tests[1:]:
            result = result & test
        return result


def filter_hits(df: DataFrame, spec: MarkerFilter) -> DataFrame:
    return df.filter(spec.predicate())


def filter_lane(df: DataFrame, lane: str) -> DataFrame:
    return df if lane == "all" else df.filter(F.col("lane") == lane)


def known(value: Column, allowed: Sequence[str], default: str) -> Column:
    return F.when(value.isin(list(allowed)), value).otherwise(F.lit(default))


def normalize_hits(df: DataFrame, lattice: Lattice, sample_count: Column, rate: int) -> DataFrame:
    """Clamp positions, default unknown labels, limit evidence, derive what is missing."""
    top = F.greatest(sample_count - 1, F.lit(0))

    def inside(value: Column) -> Column:
        return F.least(F.greatest(value, F.lit(0)), top)

    acoustic = inside(F.coalesce("acoustic", "refined"))
    chart_default = inside(F.coalesce(F.col("snapped"), lattice.nearest(acoustic)))
    chart = inside(F.coalesce(F.col("chart"), chart_default))
    evidence = F.transform_values(
        F.map_filter(F.coalesce(F.col("evidence"), F.create_map().cast("map<string,double>")),
                     lambda k, v: k.isin(STEMS)),
        lambda k, v: clip(v),
    )
    replaced = {
        "acoustic": acoustic,
        "detected": inside(F.coalesce(F.col("detected"), acoustic)),
        "refined": inside(F.col("refined")),
        "snapped": chart_default,
        "chart": chart,
        "band": known(F.col("band"), BANDS, "mid_hit"),
        "source": known(F.col("source"), SOURCES, "fused"),
        "primary_stem": known(F.col("primary_stem"), STEMS, "mix"),
        "confidence": clip(F.coalesce(F.col("confidence"), F.lit(0.0))),
        "salience": clip(F.coalesce(F.col("salience"), F.lit(0.0))),
        "evidence": evidence,
    }
    given = F.col("snap_error_ms") if "snap_error_ms" in df.columns else F.lit(None).cast("double")
    replaced["snap_error_ms"] = F.coalesce(given, (acoustic - chart) * F.lit(1000.0) / F.lit(rate))
    return df.withColumns(replaced)


def dual_time(df: DataFrame, rate: int) -> DataFrame:
    """Acoustic and chart position in both units, their distance and the manual flag."""
    acoustic = F.coalesce("acoustic", "refined")
    chart = F.coalesce("chart", "snapped")
    return df.withColumns(
        {
            "acoustic": acoustic,
            "chart": chart,
            "acoustic_sec": acoustic / rate,
            "chart_sec": chart / rate,
            "acoustic_minus_chart_ms": (acoustic - chart) * F.lit(1000.0) / rate,
            "manual": F.coalesce(F.col("source"), F.lit("fused")) == "manual",
        }
    )


def candidate_view(df: DataFrame, rate: int) -> DataFrame:
    """Missing aligned/refined positions of a candidate follow the acoustic one."""
    return df.withColumns(
        {
            "aligned": F.coalesce("aligned", "acoustic"),
            "refined": F.coalesce("refined", "acoustic"),
            "time_sec": F.col("acoustic") / rate,
        }
    )


def split_by_range(
    df: DataFrame, fields: Sequence[str], sample_count: Column
) -> tuple[DataFrame, DataFrame]:
    """Rows with all positions in [0, sample_count), and one row per offending field."""

    def outside(value: Column) -> Column:
        return F.coalesce((value < 0) | (value >= sample_count), F.lit(False))

    any_bad = F.lit(False)
    for name in fields:
        any_bad = any_bad | outside(F.col(name))
    entries = F.array(
        *[
            F.struct(F.lit(n).alias("field"), F.col(n).cast("bigint").alias("value"))
            for n in fields
        ]
    )
    bad = df.filter(any_bad).select(
        *df.columns, F.inline(F.filter(entries, lambda e: outside(e["value"])))
    )
    return df.filter(~any_bad), bad


def violations(df: DataFrame, rules: Mapping[str, Column], columns: Sequence[str]) -> DataFrame:
    """One row per broken rule and row; a rule column is true when the row is valid."""
    names = F.array(
        *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(rule)) for rule, ok in rules.items()]
    )
    return df.select(*columns, F.explode(F.array_compact(names)).alias("rule"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def ordered_unique(indices: Column) -> Column:
    """An index array is non-negative, sorted and without repeats."""
    return (F.array_sort(F.array_distinct(indices)) == indices) & F.forall(indices, lambda i: i >= 0)


def index_gaps(df: DataFrame, keys: Sequence[str], index: str) -> DataFrame:
    """Groups whose indices are not exactly 0..n-1."""
    stats = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(index).alias("low"), F.max(index).alias("high"),
        F.count_distinct(index).alias("different"),
    )
    return stats.filter("low <> 0 or high <> n - 1 or different <> n")


def lane(stem: Column) -> Column:
    return (
        F.when(stem == "vocals", "vocals").when(stem == "other", "melody")
        .when(stem == "drums", "drums").otherwise("mix")
    )


def source_evidence(evidence: Column, of_lane: Column) -> Column:
    """Exactly four keys in [0, 1]; ``mix`` defaults to 1 only in the mix lane."""
    zero = F.lit(0.0)
    mix_default = F.when(of_lane == "mix", 1.0).otherwise(0.0)
    return F.create_map(
        F.lit("vocals"), clip(F.coalesce(evidence["vocals"], zero)),
        F.lit("melody"), clip(F.coalesce(evidence["other"], evidence["melody"], zero)),
        F.lit("drums"), clip(F.coalesce(evidence["drums"], zero)),
        F.lit("mix"), clip(F.coalesce(evidence["mix"], mix_default)),
    )
