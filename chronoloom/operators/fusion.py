"""Choosing one observed span per unit among several methods."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core.durable import checkpointed
from ..core.folds import entry_states
from ..core.groups import map_groups, stacked
from ..core.quantiles import attach
from ..core.timeline import SLICE, floor_div

UNITS_PER_SLICE = 256


def span_scores(spans: DataFrame, keys: Sequence[str], unit: str, consensus_scale: float) -> DataFrame:
    """.35 confidence + .30 consensus + .20 acoustic + .15 beat, and method agreement.

    Tracks with fewer than two methods give no rows.
    """
    keys = list(keys)
    methods = spans.select(*keys, "method").distinct().groupBy(*keys).agg(F.count("*").alias("_methods"))
    middle = spans.groupBy(*keys, unit).agg(
        F.percentile("start", F.lit(0.5)).alias("_ms"), F.percentile("end", F.lit(0.5)).alias("_me"),
        F.count_distinct("method").alias("_support"),
    )
    joined = attach(spans.join(middle, [*keys, unit]), methods.filter("_methods >= 2"), keys)
    distance = (F.abs(F.col("start") - F.col("_ms")) + F.abs(F.col("end") - F.col("_me"))) / 2.0
    consensus = F.exp(-distance / max(1.0, consensus_scale))
    score = (
        0.35 * F.col("confidence") + 0.30 * consensus + 0.20 * F.col("acoustic") + 0.15 * F.col("beat")
    )
    agreement = F.col("_support") / F.col("_methods")
    return joined.filter("_methods is not null").withColumns(
        {"score": score, "support": F.col("_support"), "agreement": agreement}
    ).drop("_ms", "_me", "_support", "_methods")


def fuse_methods(
    spans: DataFrame, keys: Sequence[str], unit: str, consensus_scale: float, span_id: str = "span_id"
) -> DataFrame:
    """Per unit the best-scored span that does not start before the chosen one before it.

    spans: keys, unit, method, start, end, confidence, acoustic, beat, span_id.  The
    chosen start is the only state, so each slice of units is condensed to a step
    function "start that enters -> start that leaves" and walked again once its
    entry is known.  Spans are unchanged; none is moved or averaged.
    """
    keys = list(keys)
    scored = span_scores(spans, keys, unit, consensus_scale)
    order = Window.partitionBy(*keys, unit).orderBy("_neg", "_id").rowsBetween(Window.unboundedPreceding, -1)
    # a span that starts no later than a better one can never be the choice
    useful = F.coalesce(F.col("start") > F.max("start").over(order), F.lit(True))
    ranked = checkpointed(
        scored.select(*keys, unit, "start", (-F.col("score")).alias("_neg"), F.col(span_id).alias("_id"))
        .withColumn("_useful", useful).filter("_useful").drop("_useful")
        .withColumn(SLICE, floor_div(F.col(unit), UNITS_PER_SLICE))
    )
    home = [*keys, SLICE]
    low = -(2**62)

    def runs(g):
        units = g[unit]
        cuts = np.flatnonzero(np.append(True, units[1:] != units[:-1]))
        return cuts, np.append(cuts[1:], len(units))

    def transfer(g):
        # states that can enter differ only in which starts they still allow
        enter = np.unique(np.append(g["start"], low))
        state = enter.copy()
        for a, b in zip(*runs(g), strict=True):
            new = state.copy()
            open_ = np.ones(len(state), dtype=bool)
            for start in g["start"][a:b]:
                take = open_ & (state <= start)
                new[take] = start
                open_ &= ~take
            state = new
        keep = np.flatnonzero(np.append(True, state[1:] != state[:-1]))
        # an entering start up to _until[i] leaves as _exit[i]
        until = np.append(enter[keep[1:] - 1], enter[-1])
        return {"_until": [until.tolist()], "_exit": [state[keep].tolist()]}

    def compose(g):
        until, to = np.asarray(g["_until"][0]), np.asarray(g["_exit"][0])
        for until_b, to_b in zip(g["_until"][1:], g["_exit"][1:], strict=True):
            until_b, to_b = np.asarray(until_b), np.asarray(to_b)
            at = np.searchsorted(until_b, to, side="left")
            to = np.where(at < len(until_b), to_b[np.minimum(at, len(until_b) - 1)], to)
            # starts that pass everything so far
            late = until_b > until[-1]
            until, to = np.concatenate((until, until_b[late])), np.concatenate((to, to_b[late]))
            end = np.flatnonzero(np.append(to[1:] != to[:-1], True))
            until, to = until[end], to[end]
        return {"_until": [until.tolist()], "_exit": [to.tolist()]}

    def follow(g, enter):
        state, enters = low if enter is None else int(enter["_enter"]), []
        for until, leave in zip(g["_until"], g["_exit"], strict=True):
            enters.append(state)
            at = int(np.searchsorted(until, state, side="left"))
            if at < len(until):
                state = int(leave[at])
        return {SLICE: g[SLICE], "_enter": enters}

    def walk(g):
        state = int(g["_enter"][0])
        body = {c: v[1:] for c, v in g.items()}
        chosen = []
        for a, b in zip(*runs(body), strict=True):
            for i in range(a, b):
                if body["start"][i] >= state:
                    state = int(body["start"][i])
                    chosen.append(int(body["_id"][i]))
                    break
        return {span_id: chosen} if chosen else None

    columns = "_until array<bigint>, _exit array<bigint>"
    tables = map_groups(ranked, home, [unit, "_neg", "_id"], transfer, columns)
    entries = entry_states(tables, keys, compose, columns, follow, "_enter bigint")
    rows = stacked(ranked.withColumn("_kind", F.lit(1)), entries.withColumn("_kind", F.lit(0)))
    picked = map_groups(rows, home, ["_kind", unit, "_neg", "_id"], walk, f"{span_id} bigint")
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") * (0.65 + 0.35 * F.col("agreement"))))
    return scored.join(picked.select(*keys, span_id), [*keys, span_id], "left_semi").withColumn(
        "confidence", confidence
    )
