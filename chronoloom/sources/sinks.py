"""Sinks: marker CSV, project documents, marker packages with manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.timeline import floor_div
from ..operators.projections import STEMS, dual_time, known

# fixed values: columns and order of the marker CSV
CSV_COLUMNS = [
    "id", "sample", "acoustic_sample", "chart_sample", "time_sec", "band", "confidence", "salience", "source",
    "primary_stem", "snapped_sample", "snap_error_ms", "manually_edited", "locked",
]
# fixed values: stem partitions of a marker package
MARKER_STEMS = ["vocals", "drums", "bass", "other", "mix"]


def csv_rows(hits: DataFrame, rate: int) -> DataFrame:
    acoustic, chart = F.coalesce("acoustic", "refined"), F.coalesce("chart", "snapped")
    return hits.select(
        "id", acoustic.alias("sample"), acoustic.alias("acoustic_sample"), chart.alias("chart_sample"),
        (acoustic / rate).alias("time_sec"), "band", "confidence", "salience", "source", "primary_stem",
        F.col("snapped").alias("snapped_sample"), "snap_error_ms", F.col("edited").alias("manually_edited"), "locked",
    ).select(*CSV_COLUMNS)


def write_marker_csv(hits: DataFrame, path: str, rate: int) -> None:
    """Part files with a header each; no byte-order mark."""
    csv_rows(hits, rate).write.mode("overwrite").option("header", True).csv(path)


def markers(hits: DataFrame, rate: int) -> DataFrame:
    """Marker rows with both time bases; an unknown stem goes to ``mix``."""
    return dual_time(hits, rate).withColumn("primary_stem", known(F.col("primary_stem"), STEMS, "mix"))


def write_marker_package(hits: DataFrame, candidates: DataFrame, path: str, rate: int) -> None:
    """Markers partitioned by stem and candidates, both in export order.

    Rows are dealt out in ranges of the whole order, so a dominant stem is neither one
    task nor one file; adaptive execution sizes the ranges by the data.
    """
    rows = markers(hits, rate)
    order = ["primary_stem", "track_id", "chart", "acoustic", "id"]
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts.write.mode("overwrite").partitionBy("primary_stem").json(f"{path}/markers")
    order = ["track_id", "acoustic", "id"]
    candidates.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(
        f"{path}/analysis"
    )


def package_manifest(tracks: DataFrame, hits: DataFrame, candidates: DataFrame, rate: int) -> DataFrame:
    """One row per track and stem with counts (zero included), totals and time base facts.

    tracks: track_id, sample_count, channels.
    """
    stem = known(F.col("primary_stem"), STEMS, "mix")
    counts = hits.groupBy("track_id", stem.alias("primary_stem")).agg(F.count("*").alias("count"))
    total = counts.groupBy("track_id").agg(F.sum("count").alias("marker_count"))
    extra = candidates.groupBy("track_id").agg(F.count("*").alias("candidate_count"))
    stems = tracks.withColumn("primary_stem", F.explode(F.array(*[F.lit(s) for s in MARKER_STEMS])))
    return (
        stems.join(counts, ["track_id", "primary_stem"], "left").join(total, "track_id", "left")
        .join(extra, "track_id", "left").na.fill(0, ["count", "marker_count", "candidate_count"])
        .withColumns(
            {
                "path": F.concat(F.lit("markers/"), "primary_stem", F.lit(".json")), "timebase": F.lit("samples"),
                "sample_rate": F.lit(rate), "duration_sec": F.col("sample_count") / rate,
            }
        )
    )


def project_documents(
    tracks: DataFrame, tempo: DataFrame, hits: DataFrame, candidates: DataFrame, part_width: int,
    hit_columns: Sequence[str], candidate_columns: Sequence[str],
) -> DataFrame:
    """Nested project documents, one per track and time part.

    A document nests arrays, so its size must be bounded: a track is written in
    parts of ``part_width`` positions (one part when the track is shorter), each
    with the hits, candidates and tempo segments that start in it, in export
    order.  ``tracks`` holds one row of project and audio facts per track,
    repeated in every part; a track without rows gets one part with empty arrays.
    """

    def nested(df: DataFrame, order: Sequence[str], columns: Sequence[str], pos: Column, name: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(*order, F.struct(*columns).alias("_v"))))
        return df.groupBy("track_id", floor_div(pos, part_width).alias("part")).agg(
            F.transform(rows, lambda r: r["_v"]).alias(name)
        )

    h = nested(hits, ["chart", "acoustic", "id"], hit_columns, F.col("acoustic"), "hitPoints")
    c = nested(candidates, ["acoustic", "id"], candidate_columns, F.col("acoustic"), "candidateEvents")
    body = h.join(c, ["track_id", "part"], "full_outer")
    t = nested(
        tempo, ["start_pos"], ["start_pos", "bpm", "beat_offset"], F.col("start_pos"), "tempoMap"
    )
    parts = tracks.join(body.join(t, ["track_id", "part"], "full_outer"), "track_id", "left")
    empty = {n: F.coalesce(n, F.array().cast(parts.schema[n].dataType)) for n in ("hitPoints", "candidateEvents", "tempoMap")}
    return parts.withColumns({"part": F.coalesce("part", F.lit(0)).cast("bigint"), **empty})


def write_project_documents(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").json(path)
