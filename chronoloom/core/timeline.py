"""Skew-safe windows over keyed, ordered rows.

A plain ``Window.partitionBy(track).orderBy(pos)`` puts a whole track into one
task.  One track may hold a third of all rows, so nothing here partitions the
rows by the track alone.  The timeline of every key is cut into slices of fixed
width and the rows are partitioned by (key, slice):

* ``carried`` gives lag/lead/as-of/running values.  The part inside a slice is a
  window over (key, slice); what enters a slice from outside comes from one
  summary row per slice, pre-aggregated on the map side.
* ``near`` gives RANGE frames.  Rows close to a slice border are copied into the
  neighbour slice, so the frame is complete without a second pass.

Only the slice summaries are ever windowed per key; their number is bounded by
timeline length / slice width, not by the number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"
WHOLE_KEY = "_key"


def floor_div(value: Column, width: int) -> Column:
    """Integer floor division, exact for negative BIGINT positions."""
    value = value.cast("bigint")
    w = F.lit(int(width)).cast("bigint")
    return F.call_function("div", value - F.pmod(value, w), w)


@dataclass(frozen=True)
class Timeline:
    """How rows are keyed and ordered, and how wide a slice is (in position units)."""

    keys: Sequence[str]
    pos: str
    tie: Sequence[str] = field(default_factory=tuple)
    width: int = 86_400

    @property
    def order(self) -> list[str]:
        return [self.pos, *self.tie]

    def slice_of(self, offset: int = 0) -> Column:
        return floor_div(F.col(self.pos).cast("bigint") + F.lit(offset), self.width)

    def home(self) -> list[str]:
        return [*self.keys, SLICE]


def carried(
    df: DataFrame,
    tl: Timeline,
    *,
    last: Mapping[str, Column] | None = None,
    upcoming: Mapping[str, Column] | None = None,
    prev: Mapping[str, Column] | None = None,
    nxt: Mapping[str, Column] | None = None,
    run_sum: Mapping[str, Column] | None = None,
    run_max: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add ordered per-key columns without putting a key into one task.

    last      last non-null value at or before the row (as-of)
    upcoming  first non-null value at or after the row
    prev/nxt  value of the neighbouring row (null at the ends)
    run_sum   running total, the row included
    run_max   running maximum, the row included
    """
    last, upcoming = dict(last or {}), dict(upcoming or {})
    prev, nxt = dict(prev or {}), dict(nxt or {})
    run_sum, run_max = dict(run_sum or {}), dict(run_max or {})

    # as one column the keys are equal where both are null, in windows and in the join alike
    sliced = df.withColumns({WHOLE_KEY: F.struct(*tl.keys), SLICE: tl.slice_of()})
    home = [WHOLE_KEY, SLICE]
    order = F.struct(*tl.order)

    summary = []
    for name, value in last.items():
        summary.append(F.max_by(value, F.when(value.isNotNull(), order)).alias(f"_in_{name}"))
    for name, value in upcoming.items():
        summary.append(F.min_by(value, F.when(value.isNotNull(), order)).alias(f"_in_{name}"))
    for name, value in prev.items():
        summary.append(F.max_by(F.struct(value.alias("v")), order).alias(f"_in_{name}"))
    for name, value in nxt.items():
        summary.append(F.min_by(F.struct(value.alias("v")), order).alias(f"_in_{name}"))
    for name, value in run_sum.items():
        summary.append(F.sum(value).alias(f"_in_{name}"))
    for name, value in run_max.items():
        summary.append(F.max(value).alias(f"_in_{name}"))

    back = Window.partitionBy(WHOLE_KEY).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    forth = (
        Window.partitionBy(WHOLE_KEY).orderBy(F.desc(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = []
    for name in [*last, *prev]:
        carry.append(F.last(f"_in_{name}", ignorenulls=True).over(back).alias(f"_carry_{name}"))
    for name in [*upcoming, *nxt]:
        carry.append(F.last(f"_in_{name}", ignorenulls=True).over(forth).alias(f"_carry_{name}"))
    for name in run_sum:
        carry.append(F.sum(f"_in_{name}").over(back).alias(f"_carry_{name}"))
    for name in run_max:
        carry.append(F.max(f"_in_{name}").over(back).alias(f"_carry_{name}"))

    per_slice = sliced.groupBy(*home).agg(*summary).select(*home, *carry)

    inside = Window.partitionBy(*home).orderBy(*tl.order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    # "at or after": walk the slice backwards, so that the frame stays incremental
    backwards = Window.partitionBy(*home).orderBy(*[F.desc(c) for c in tl.order])
    fromhere = backwards.rowsBetween(Window.unboundedPreceding, 0)

    local = {}
    for name, value in last.items():
        local[f"_loc_{name}"] = F.last(value, ignorenulls=True).over(upto)
    for name, value in prev.items():
        local[f"_loc_{name}"] = F.lag(F.struct(value.alias("v"))).over(inside)
    for name, value in nxt.items():
        local[f"_loc_{name}"] = F.lead(F.struct(value.alias("v"))).over(inside)
    for name, value in run_sum.items():
        local[f"_loc_{name}"] = F.sum(value).over(upto)
    for name, value in run_max.items():
        local[f"_loc_{name}"] = F.max(value).over(upto)
    for name, value in upcoming.items():
        local[f"_loc_{name}"] = F.last(value, ignorenulls=True).over(fromhere)

    out = sliced.withColumns(local).join(per_slice, home, "left")
    result = {}
    for name in [*last, *upcoming]:
        result[name] = F.coalesce(f"_loc_{name}", f"_carry_{name}")
    for name in [*prev, *nxt]:
        result[name] = F.coalesce(f"_loc_{name}", f"_carry_{name}")["v"]
    for name in run_sum:
        result[name] = F.coalesce(F.col(f"_loc_{name}"), F.lit(0)) + F.coalesce(
            F.col(f"_carry_{name}"), F.lit(0)
        )
    for name in run_max:
        result[name] = F.greatest(f"_loc_{name}", f"_carry_{name}")
    keep = [c for c in df.columns if c not in result]
    return out.select(*keep, *[c.alias(n) for n, c in result.items()])


def haloed(df: DataFrame, tl: Timeline, before: int, after: int) -> DataFrame:
    """Copy rows near a slice border into the slices whose frame reaches them.

    Adds ``_slice`` and ``_home`` (true for the one copy that lives in its own
    slice).  Copies per row: at most 1 + (before + after) / width, rounded up.
    """
    return df.withColumn(
        SLICE, F.explode(F.sequence(tl.slice_of(-after), tl.slice_of(before)))
    ).withColumn("_home", F.col(SLICE) == tl.slice_of())


def near(
    df: DataFrame, tl: Timeline, before: int, after: int, aggs: Mapping[str, Column]
) -> DataFrame:
    """Aggregates over RANGE [pos - before, pos + after] per key."""
    frame = Window.partitionBy(*tl.home()).orderBy(tl.pos).rangeBetween(-before, after)
    out = haloed(df, tl, before, after)
    out = out.withColumns({name: agg.over(frame) for name, agg in aggs.items()})
    return out.filter("_home").drop(SLICE, "_home")


def swept(
    df: DataFrame,
    tl: Timeline,
    radius: int,
    *,
    maxima: Mapping[str, Column] | None = None,
    count: str | None = None,
) -> DataFrame:
    """Maximum and row count over [pos - radius, pos + radius], whatever the density.

    A RANGE frame is evaluated anew for every row, which is quadratic where rows
    are dense.  Here the timeline is cut into blocks as long as the window, so a
    window touches two blocks: the end of one and the beginning of the next.  Both
    parts are running aggregates inside a block, read at the window borders.
    Order columns must identify a row of a key.
    """
    maxima = dict(maxima or {})
    length = 2 * radius + 1
    pos = F.col(tl.pos).cast("bigint")
    identity = [*tl.keys, *tl.order]
    values = {f"_m_{name}": value for name, value in maxima.items()}
    base = df.select(*identity, *[v.alias(n) for n, v in values.items()])
    low, high = pos - F.lit(radius), pos + F.lit(radius)

    def mark(kind: int, at: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), at.alias("at"), floor_div(at, length).alias("block"))

    # kind 0 carries values; 1 asks up to the window's end; 2 asks from its start on
    asks = F.array(mark(0, pos), mark(1, high), mark(2, low))
    rows = base.select("*", F.inline(asks))
    group = Window.partitionBy(*tl.keys, "block")
    up = group.orderBy("at", F.when(F.col("kind") == 0, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    down = group.orderBy(F.desc("at"), F.when(F.col("kind") == 0, 0).otherwise(1)).rowsBetween(
        Window.unboundedPreceding, 0
    )
    columns = {}
    for name in values:
        data = F.when(F.col("kind") == 0, F.col(name))
        columns[f"{name}_r"] = F.when(F.col("kind") == 1, F.max(data).over(up)).otherwise(F.max(data).over(down))
    if count is not None:
        data = F.count(F.when(F.col("kind") == 0, F.lit(1)))
        # a window that is exactly one block is counted from one side only
        whole = floor_div(low, length) == floor_div(high, length)
        columns["_count_r"] = F.when(F.col("kind") == 1, data.over(up)).otherwise(
            F.when(whole, F.lit(0)).otherwise(data.over(down))
        )
    found = rows.withColumns(columns).filter("kind > 0")
    sums = [F.max(f"{n}_r").alias(name) for n, name in zip(values, maxima, strict=True)]
    if count is not None:
        sums.append(F.sum("_count_r").alias(count))
    result = found.groupBy(*identity).agg(*sums)
    return df.join(result, identity)


def neighbours(
    df: DataFrame,
    tl: Timeline,
    reach: int,
    *,
    prev: Mapping[str, Column] | None = None,
    nxt: Mapping[str, Column] | None = None,
) -> DataFrame:
    """lag/lead for neighbours at most ``reach`` positions away, null beyond.

    One shuffle and one read of the input: unlike ``carried`` it needs no slice
    summary, so it is the one to use when only near neighbours matter.
    """
    inside = Window.partitionBy(*tl.home()).orderBy(*tl.order)
    pos = F.col(tl.pos)
    out = haloed(df, tl, reach, reach)
    columns = {}
    for name, value in dict(prev or {}).items():
        close = pos - F.lag(pos).over(inside) <= reach
        columns[name] = F.when(close, F.lag(value).over(inside))
    for name, value in dict(nxt or {}).items():
        close = F.lead(pos).over(inside) - pos <= reach
        columns[name] = F.when(close, F.lead(value).over(inside))
    return out.withColumns(columns).filter("_home").drop(SLICE, "_home")


def islands(df: DataFrame, tl: Timeline, gap: int, name: str = "island") -> DataFrame:
    """Label rows with the position of the first row of their island.

    A row starts a new island when it is at least ``gap`` after its predecessor.
    """
    marked = neighbours(df, tl, gap - 1, prev={"_before": F.col(tl.pos)})
    head = F.when(F.col("_before").isNull(), F.col(tl.pos))
    return carried(marked.withColumn("_head", head), tl, last={name: F.col("_head")}).drop(
        "_head", "_before"
    )


def increasing(df: DataFrame, tl: Timeline, value: str, name: str) -> DataFrame:
    """Smallest strictly increasing sequence that is >= ``value`` row by row.

    Closed form running max(value - n) + n with n the row number.  Both running
    values are taken inside a slice and shifted by what the earlier slices hold.
    """
    inside = Window.partitionBy(*tl.home()).orderBy(*tl.order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn(SLICE, tl.slice_of()).withColumn("_n", F.row_number().over(inside).cast("bigint"))
    local = local.withColumn("_low", F.col(value) - F.col("_n"))
    back = Window.partitionBy(*tl.keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    per_slice = (
        local.groupBy(*tl.home()).agg(F.count("*").alias("_c"), F.max("_low").alias("_m"))
        .withColumn("_c0", F.coalesce(F.sum("_c").over(back), F.lit(0)))
        .withColumn("_m0", F.max(F.col("_m") - F.col("_c0")).over(back))
        .select(*tl.home(), "_c0", "_m0")
    )
    best = F.greatest(F.max("_low").over(upto) - F.col("_c0"), F.col("_m0"))
    out = local.join(per_slice, tl.home(), "left")
    return out.withColumn("_best", best).select(
        *df.columns, (F.col("_best") + F.col("_n") + F.col("_c0")).alias(name)
    )
