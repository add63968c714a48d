"""Min/max level-of-detail pyramids, one row per bin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core.quantiles import attach
from ..core.timeline import floor_div


def build_lods(
    samples: DataFrame, keys: Sequence[str], pos: str, value: str, base_window: int = 256,
    max_levels: int = 8, enough: int = 32, block: str | None = None,
) -> DataFrame:
    """Windows grow fourfold per level until a level has at most ``enough`` bins or
    there are ``max_levels`` levels.  Every level covers all samples.

    The samples are reduced to base bins first (partial aggregation).  These are dealt out
    once, by key and block of at least as many base bins as a bin of the coarsest level has,
    so every level is made where its base bins lie.  ``block`` names a column to keep with
    that key and block, by which ``select_lod`` finds the rows where they are.
    """
    keys, own = list(keys), block or "_block"
    place = floor_div(F.col(pos), base_window)
    base = samples.groupBy(*keys, place.alias("_bin")).agg(F.min(value).alias("min"), F.max(value).alias("max"))
    size = F.lit(4 ** max(max_levels - 1, 6)).cast("bigint")
    # a struct, since a null key or position equals itself in there
    home = F.struct(*keys, F.call_function("div", F.col("_bin"), size).alias("_block")).alias(own)
    # the number of bins of a key, once for each of its blocks
    ends = samples.select(*keys, place.alias("_bin")).groupBy(home).agg(F.max("_bin").alias("_last"))
    ends = ends.withColumn("_key", _keys_of(own, keys))
    last = ends.groupBy("_key").agg((F.max("_last") + 1).alias("_bins"))
    facts = ends.select("_key", own).join(last, "_key").drop("_key")
    levels = F.array(
        *[F.struct(F.lit(k).alias("level"), F.lit(4**k).alias("fold")) for k in range(max_levels)]
    )

    def reached(level):
        # bins of the level below, rounded up
        below = F.ceil(F.col("_bins") / (level["fold"] / 4))
        return (level["level"] == 0) | (below > enough)

    spread = _met(base.select(home, "_bin", "min", "max"), facts, own).select(
        own, "_bin", "min", "max", F.explode(F.filter(levels, reached)).alias("_l")
    )
    fold = F.col("_l.fold").cast("bigint")
    lods = (
        spread.withColumn("bin", F.call_function("div", F.col("_bin"), fold))
        .groupBy(own, F.col("_l.level").alias("level"), (fold * base_window).alias("window"), "bin")
        .agg(F.min("min").alias("min"), F.max("max").alias("max"))
        .withColumns({"min": F.round("min", 7), "max": F.round("max", 7)})
    )
    return lods.select(*[F.col(own)[k].alias(k) for k in keys], "level", "window", "bin", "min", "max", *([own] if block else []))


def _keys_of(block: str, keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(block)[k].alias(k) for k in keys])


def _met(rows: DataFrame, facts: DataFrame, block: str) -> DataFrame:
    """Join with one row per block, which is hashed: the rows stay in the partitions of their blocks, unsorted."""
    return rows.join(facts.hint("shuffle_hash"), block)


def select_lod(
    lods: DataFrame, keys: Sequence[str], max_points: int, level: int | None = None, block: str | None = None
) -> DataFrame:
    """The asked level, or the finest with at most ``max_points`` bins, else the coarsest.

    A key that lacks the asked level is an error when the result is read.  With the column
    ``block`` of ``build_lods`` only the sizes of levels are shuffled to choose one, not the bins.
    """
    keys = list(keys)
    if level is not None:
        has = lods.groupBy(*keys).agg(F.max((F.col("level") == level).cast("int")).alias("_has"))
        lacks = F.raise_error(F.lit(f"no level {level}"))
        return attach(lods, has, keys).filter(
            F.when(F.col("_has") == 1, F.col("level") == level).otherwise(lacks.cast("boolean"))
        ).drop("_has")
    if block:
        # asks for the columns that the bins are read with below, so both share one shuffle; the filter drops nothing
        parts = lods.groupBy(block, "level").agg(F.count("*").alias("_n"), F.min("min").alias("_low"), F.max("max").alias("_high"))
        parts = parts.filter(F.coalesce(F.col("_low") <= F.col("_high"), F.lit(True))).select(block, "level", "_n", _keys_of(block, keys).alias("_key"))
        whole = parts.repartition("_key").withColumn("_n", F.sum("_n").over(Window.partitionBy("_key", "level")))
        key = Window.partitionBy("_key")
        fitting = F.min(F.when(F.col("_n") <= max_points, F.col("level"))).over(key)
        chosen = whole.select(block, F.coalesce(fitting, F.max("level").over(key)).alias("_level"))
        chosen = chosen.groupBy(block).agg(F.first("_level").alias("_level"))
        # as a difference, since Spark would deal out all bins anew by an equal level
        return _met(lods, chosen, block).filter(F.col("level") - F.col("_level") == 0).select(*lods.drop(block).columns)
    sizes = lods.groupBy(*keys, "level").agg(F.count("*").alias("_n"))
    fitting = F.min(F.when(F.col("_n") <= max_points, F.col("level")))
    chosen = sizes.groupBy(*keys).agg(F.coalesce(fitting, F.max("level")).alias("_level"))
    return attach(lods, chosen, keys).filter(F.col("level") == F.col("_level")).drop("_level")
