"""Running totals over a global order, from the totals of contiguous cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

CELL = "_cell"


def in_cells(df: DataFrame, *order: str) -> DataFrame:
    """df dealt into contiguous ranges of `order`; the cell number is fixed by writing it.

    Rows go by sampled bounds of the whole order, so a frequent first key is spread over many
    cells as long as the later keys differ.
    """
    return written(df.repartitionByRange(*order).withColumn(CELL, F.spark_partition_id()))


def before(cells: DataFrame, order: list[str], sums: dict[str, str], within: tuple[str, ...] = ()) -> DataFrame:
    """Adds for each `name: value` the exclusive running total of value along `order`.

    Cell totals are summed map-side; their own prefix sums run over one row per cell (and
    group of `within`); rows are then only ordered inside their cell.
    """
    keys = [*within, CELL]
    totals = cells.groupBy(*keys).agg(*(F.sum(v).alias(f"_sum_{n}") for n, v in sums.items()))
    earlier = Window.partitionBy(*within).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        *(F.col(k).alias(f"_key_{k}") for k in keys),
        *(F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_base_{n}") for n in sums),
    )
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = cells.join(bases, same, "inner")
    for n, v in sums.items():
        running = F.coalesce(F.sum(v).over(inside), F.lit(0))
        joined = joined.withColumn(n, F.col(f"_base_{n}") + running)
    return joined.drop(CELL, *(f"_key_{k}" for k in keys), *(f"_base_{n}" for n in sums))
