"""Set operations, upserts and merges that protect human edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core.chains import keep_distant
from ..core.quantiles import attach
from ..core.timeline import Timeline
from .joins import interval_join, suppress_near


def merge_nearby(left: DataFrame, right: DataFrame, tl: Timeline, window: int) -> DataFrame:
    """Union of positions, keeping one only when > window after the last kept one."""
    both = left.select(*tl.keys, tl.pos).unionByName(right.select(*tl.keys, tl.pos))
    return keep_distant(both, tl, window)


def cell_sets(left: DataFrame, right: DataFrame, keys: Sequence[str], cell: str) -> DataFrame:
    """Occupied cells of both sides: common, only left, only right.

    One aggregation instead of intersect + except + union.
    """
    both = left.select(*keys, cell, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*keys, cell, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    seen = both.groupBy(*keys, cell).agg(F.max("_l").alias("in_left"), F.max("_r").alias("in_right"))
    kind = (
        F.when((F.col("in_left") == 1) & (F.col("in_right") == 1), "common")
        .when(F.col("in_left") == 1, "left").otherwise("right")
    )
    return seen.select(*keys, cell, kind.alias("side"))


def bulk_replace(current: DataFrame, incoming: DataFrame, track: str = "track_id") -> DataFrame:
    """Full-state replacement: one action per id.

    insert, update, delete; conflict when the id belongs to another track;
    ``untouched`` for rows of tracks that the request does not mention.
    """
    tracks = incoming.select(F.col(track).alias("_t")).distinct()
    named = tracks.select(F.col("_t").alias(track), F.lit(True).alias("_named"))
    old = attach(current, named, [track]).select(
        "id", F.col(track).alias("old_track"), F.col("_named").isNotNull().alias("_addressed")
    )
    new = incoming.select("id", F.col(track).alias("new_track"))
    action = (
        F.when(F.col("old_track").isNull(), "insert")
        .when(F.col("new_track").isNull() & ~F.col("_addressed"), "untouched")
        .when(F.col("new_track").isNull(), "delete")
        .when(F.col("old_track") != F.col("new_track"), "conflict")
        .otherwise("update")
    )
    return old.join(new, "id", "full_outer").select("id", "old_track", "new_track", action.alias("action"))


def is_protected() -> Column:
    return F.col("edited") | F.col("locked") | (F.col("source") == "manual")


def reanalysis_merge(old: DataFrame, new: DataFrame, tl: Timeline, radius: int) -> DataFrame:
    """Keep protected rows, drop the other old ones, add new ones not near a kept one."""
    kept = old.filter(is_protected())
    added = suppress_near(new, kept, tl, radius)
    return kept.withColumn("origin", F.lit("kept")).unionByName(
        added.withColumn("origin", F.lit("new")), allowMissingColumns=True
    )


def merge_status(merged: DataFrame, tracks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Track status after a merge: edited when a human-touched row survived."""
    touched = merged.groupBy(*keys).agg(F.max(F.col("origin") == "kept").alias("_kept"))
    return tracks.join(touched, list(keys), "left").select(
        *tracks.columns,
        F.when(F.coalesce(F.col("_kept"), F.lit(False)), "edited").otherwise("completed").alias("status"),
    )


def upsert_generator(current: DataFrame, incoming: DataFrame, generator: str, tracks: DataFrame,
                     keys: Sequence[str] = ("track_id",)) -> DataFrame:
    """Replace one generator's rows of the given tracks by id, leave the rest alone."""
    named = tracks.select(*keys).distinct().withColumn("_addressed", F.lit(True))
    old = attach(current.join(incoming.select("id"), "id", "left_anti"), named, keys)
    others = old.filter((F.col("generator") != generator) | F.col("_addressed").isNull())
    return others.drop("_addressed").unionByName(incoming.withColumn("generator", F.lit(generator)))


def sync_candidates(
    current: DataFrame, desired: DataFrame, chunks: DataFrame, tl: Timeline, lane: str = "vocals"
) -> DataFrame:
    """Inside successful chunks absent rows of the lane go; the rest is upserted."""
    success = chunks.filter("status = 'success'")
    absent = current.join(desired.select("id"), "id", "left_anti")
    of_lane = absent.filter(F.col("lane") == lane)
    gone = interval_join(of_lane, success, tl, "start", "end", "idx", how="semi").select("id")
    kept = absent.join(gone, "id", "left_anti")
    return kept.unionByName(desired)


def union_votes(df: DataFrame, keys: Sequence[str], votes: str) -> DataFrame:
    """Sorted union of the vote arrays of a group; the vote vocabulary is small."""
    return (
        df.select(*keys, F.explode(votes).alias("_v")).distinct()
        .groupBy(*keys).agg(F.array_sort(F.collect_list("_v")).alias(votes))
    )


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key (row_number = 1 prunes before the shuffle)."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key in the given order, with their rank."""
    best = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(best).cast("bigint")).filter(F.col(rank) <= k)
