"""Exact per-key quantiles without collecting a key anywhere.

``percentile`` keeps all distinct values of a group in one task.  Here a bounded
approximate pass brackets each wanted quantile of each key; values between brackets are
only counted, those inside are grouped by value and ranked.  The brackets come from the
data, so a curve may have any scale and any skew.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
"""One over the rank error of the approximate pass; a bracket holds some 8 / ACCURACY of a key's rows."""


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: Column, probs: Mapping[str, float], *, nearest_rank: bool = False
) -> DataFrame:
    """One row per key: count ``n`` and one column per entry of ``probs``.

    Linear interpolation between neighbours, or the nearest rank (the smallest
    value whose cumulative share reaches p).
    """
    return curve_quantiles(df, keys, {name: (value, p) for name, p in probs.items()}, nearest_rank=nearest_rank)


def curve_quantiles(
    df: DataFrame, keys: Sequence[str], curves: Mapping[str, tuple[Column, float]], *, nearest_rank: bool = False
) -> DataFrame:
    """Exact quantiles of several curves in one pass: output name -> (curve, p), and the count ``n`` of the longest.

    Keys of up to 4 ACCURACY rows are ranked whole; in longer ones a bracket reaches 4 / ACCURACY to both
    sides of its quantile, and the approximate pass is wrong by a quarter of that at most.  If the wanted rank should
    lie outside all the same, the query fails instead of giving another value.
    """
    keys = list(keys)
    columns: dict[str, Column] = {}
    wanted: dict[str, list[tuple[str, float]]] = {}
    for name, (curve, p) in curves.items():
        columns.setdefault(str(curve), curve)
        wanted.setdefault(str(curve), []).append((name, float(p)))
    values = df.select(*keys, *(curve.cast("double").alias(f"_x{i}") for i, curve in enumerate(columns.values())))

    def sketch(i: int, picks: list[tuple[str, float]]) -> Column:
        margin = 4 / ACCURACY
        around = [share for _, p in picks for share in (max(0.0, p - margin), min(1.0, p + margin))]
        # short keys have no brackets: all their values are ranked
        bounds = F.percentile_approx(f"_x{i}", around, ACCURACY)
        return F.when(F.count(f"_x{i}") > 4 * ACCURACY, bounds).alias(f"_b{i}")

    brackets = values.groupBy(*keys).agg(*(sketch(i, picks) for i, picks in enumerate(wanted.values())))

    def cell(i: int, picks: list[tuple[str, float]]) -> Column:
        x, bounds = F.col(f"_x{i}"), F.col(f"_b{i}")
        lows, highs = ([F.get(bounds, F.lit(2 * j + k)) for j in range(len(picks))] for k in (0, 1))
        # how many brackets begin or end below a value; within such a stretch all values are inside or none is
        part = reduce(lambda a, b: a + b, [(x >= lo).cast("int") + (x > hi).cast("int") for lo, hi in zip(lows, highs)])
        inside = reduce(lambda a, b: a | b, [x.between(lo, hi) for lo, hi in zip(lows, highs)])
        return F.struct(
            F.lit(i).alias("_c"),
            x.isNotNull().alias("_is"),
            F.coalesce(part, F.lit(0)).alias("_part"),
            F.when(F.coalesce(inside, F.lit(True)), x).alias("_x"),
        )

    spread = attach(values, brackets, keys).select(
        *keys, F.inline(F.array(*(cell(i, picks) for i, picks in enumerate(wanted.values()))))
    )
    cells = spread.filter("_is").groupBy(*keys, "_c", "_part", "_x").agg(F.count("*").alias("_n"))
    curve = Window.partitionBy(*keys, "_c")
    ranked = cells.withColumn("n", F.sum("_n").over(curve)).withColumn(
        "_upto", F.sum("_n").over(curve.orderBy("_part", "_x").rowsBetween(Window.unboundedPreceding, 0))
    )
    n, x, upto = F.col("n"), F.col("_x"), F.col("_upto")

    def at(i: int, rank: Column) -> Column:
        here = (F.col("_c") == i) & (rank < upto) & (rank >= upto - F.col("_n"))
        outside = F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
        return F.max(F.when(here, F.coalesce(x, outside)))

    aggs = []
    for i, picks in enumerate(wanted.values()):
        length = F.max(F.when(F.col("_c") == i, n))
        for name, p in picks:
            if nearest_rank:
                low = F.greatest(F.ceil(n * F.lit(p)).cast("bigint") - 1, F.lit(0))
                aggs.append(at(i, low).alias(name))
                continue
            spot = (n - 1) * F.lit(p)
            low, high = at(i, F.floor(spot).cast("bigint")), at(i, F.ceil(spot).cast("bigint"))
            whole = (length - 1) * F.lit(p)
            aggs.append((low + (high - low) * (whole - F.floor(whole))).alias(name))
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)


def attach(df: DataFrame, facts: DataFrame, keys: Sequence[str], salts: int = 16) -> DataFrame:
    """Left join of one-row-per-key facts that survives a hot key; a null key is a key.

    The rows of a key are spread over ``salts`` partitions and the facts are
    repeated that many times; the row count of the facts, not of the data, grows.
    """
    keys = list(keys)
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in _hashable(df)]), F.lit(salts)).cast("int")
    left = df.withColumn("_salt", spread)
    names = {c: f"_f_{c}" for c in [*keys, "_salt"]}
    right = facts.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)]))).withColumnsRenamed(names)
    same = [F.col(c).eqNullSafe(F.col(f)) for c, f in names.items()]
    return left.join(right, same, "left").drop("_salt", *names.values())


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
