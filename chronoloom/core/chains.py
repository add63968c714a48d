"""Ordered greedy selection, exact for arbitrarily long and dense keys.

Two greedy rules occur everywhere: "start a new cluster when farther than w from
the cluster anchor" and "closer than m to the last kept row: the stronger one
stays".  Both walk a key from left to right with the last anchored/kept row as
their only state, so every row has exactly one successor.  That allows a two-pass
scan per (key, slice):

1. ``_transfer`` runs once per slice and condenses it to a table "state that
   enters -> state that leaves"; chains with different starts merge quickly, so
   the table is run-length compressed and small;
2. the tables are composed in blocks, so the entry of every slice is found without a
   task that sees a whole key (``folds``);
3. every slice is walked again from its known entry state.

Before the first pass rows are pre-aggregated to one row per (key, position) —
lossless for both rules — so a slice holds at most ``width`` rows whatever the
data volume.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import checkpointed
from .folds import entry_states
from .groups import map_groups, stacked
from .timeline import SLICE, Timeline

SLICES_PER_WINDOW = 16
TABLE = ("_from", "_until", "_peak", "_exit_pos", "_exit_score")


def _successors(pos: np.ndarray, score: np.ndarray | None, window: int) -> np.ndarray:
    """Index of the next row that changes the state, per row (n = none here)."""
    n = len(pos)
    by_distance = np.searchsorted(pos, pos + window, side="left")
    if score is None:
        return by_distance
    # first later row with a strictly higher score (monotone stack)
    higher = np.full(n, n, dtype=np.int64)
    stack: list[int] = []
    for i in range(n - 1, -1, -1):
        while stack and score[stack[-1]] <= score[i]:
            stack.pop()
        if stack:
            higher[i] = stack[-1]
        stack.append(i)
    return np.minimum(by_distance, higher)


def _exits(succ: np.ndarray) -> np.ndarray:
    """Last state reached inside the slice when the chain enters at each row."""
    n = len(succ)
    out = np.arange(n, dtype=np.int64)
    for i in range(n - 1, -1, -1):
        if succ[i] < n:
            out[i] = out[succ[i]]
    return out


def _runs(values: np.ndarray) -> np.ndarray:
    """First index of every run of equal values."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))


def _entry(pos, score, window, state_pos, state_score) -> int:
    """Row that takes over from an entering state (n = nobody in this slice)."""
    first = int(np.searchsorted(pos, state_pos + window, side="left"))
    if score is not None:
        peaks = np.maximum.accumulate(score)
        first = min(first, int(np.searchsorted(peaks, state_score, side="right")))
    return first


def _chain(pre: DataFrame, tl: Timeline, spacing: int | str, scored: bool) -> DataFrame:
    """Walk the chains of every key over one row per (key, position).

    ``spacing`` is a number or names a key column that holds it.

    Adds ``taken`` (the row became the state), ``kept`` (and was not replaced by
    a stronger one) and ``state_pos`` (state after the row).
    """
    keys, pos_name = list(tl.keys), tl.pos

    def window_of(g) -> int:
        return int(g[spacing][0]) if isinstance(spacing, str) else spacing

    def arrays(g):
        pos = g[pos_name].astype(np.int64)
        return pos, (g["_score"].astype(np.float64) if scored else None)

    def transfer(g):
        window = window_of(g)
        pos, score = arrays(g)
        leave = _exits(_successors(pos, score, window))
        # rows that can take over: all up to one window after the first row
        zone = min(int(np.searchsorted(pos, pos[0] + window, side="left")) + 1, len(pos))
        peaks = np.maximum.accumulate(score[:zone]) if scored else np.zeros(zone)
        start = np.union1d(_runs(leave[:zone]), _runs(peaks))
        end = np.append(start[1:] - 1, zone - 1)
        return {
            "_from": [pos[start].tolist()],
            "_until": [pos[end].tolist()],
            "_peak": [peaks[start].tolist()],
            "_exit_pos": [pos[leave[start]].tolist()],
            "_exit_score": [(score[leave[start]] if scored else np.zeros(len(start))).tolist()],
        }

    def compose(g):
        window = window_of(g)
        first, last, peak, to, strength = (np.asarray(g[c][0]) for c in TABLE)
        horizon = first[0] + window
        for i in range(1, len(g[SLICE])):
            from_b, until_b, peak_b, to_b, strength_b = (np.asarray(g[c][i]) for c in TABLE)
            at = np.searchsorted(until_b, to + window, side="left")
            if scored:
                at = np.minimum(at, np.searchsorted(peak_b, strength, side="right"))
            moved = at < len(until_b)
            to_old, at = to, np.minimum(at, len(until_b) - 1)
            to, strength = np.where(moved, to_b[at], to_old), np.where(moved, strength_b[at], strength)
            if last[-1] < horizon:
                # a state may still pass all rows so far: up to the first row it cannot pass
                n = int(np.searchsorted(until_b, horizon, side="left")) + 1
                peak_b = np.maximum(peak_b, peak[-1])
                first, last, peak, to, strength = (
                    np.concatenate((old, new[:n]))
                    for old, new in ((first, from_b), (last, until_b), (peak, peak_b), (to, to_b), (strength, strength_b))
                )
            start = np.flatnonzero(np.append(True, (to[1:] != to[:-1]) | (peak[1:] != peak[:-1])))
            end = np.append(start[1:] - 1, len(to) - 1)
            first, last, peak, to, strength = first[start], last[end], peak[start], to[start], strength[start]
        return dict(zip(TABLE, ([x.tolist()] for x in (first, last, peak, to, strength)), strict=True))

    def follow(g, enter):
        window = window_of(g)
        state, strength = None, 0.0
        if enter is not None and enter["_entered"]:
            state, strength = int(enter["_enter_pos"]), float(enter["_enter_score"])
        entered, enter_pos, enter_score, undoes, undone = [], [], [], [], []
        for i in range(len(g[SLICE])):
            until, peak = g["_until"][i], g["_peak"][i]
            entered.append(state is not None)
            enter_pos.append(state or 0)
            enter_score.append(strength)
            at, replaced = 0, False
            if state is not None:
                at = int(np.searchsorted(until, state + window, side="left"))
                if scored:
                    stronger = int(np.searchsorted(peak, strength, side="right"))
                    # a stronger row closer than the window replaces the state
                    replaced = stronger < len(until) and stronger <= at and g["_from"][i][stronger] < state + window
                    at = min(at, stronger)
            undoes.append(bool(replaced))
            undone.append(state // tl.width if replaced else 0)
            if at < len(until):
                state, strength = int(g["_exit_pos"][i][at]), float(g["_exit_score"][i][at])
        return {
            SLICE: g[SLICE], "_entered": entered, "_enter_pos": enter_pos, "_enter_score": enter_score,
            "_undoes": undoes, "_undone": undone,
        }

    def walk(g):
        window = window_of(g)
        # the entry of the slice comes first, then a row if its last state is replaced later
        enter = int(g["_enter_pos"][0]) if g["_entered"][0] else None
        strength, lead = float(g["_enter_score"][0]), int(np.count_nonzero(g["_kind"] < 2))
        undone = lead > 1
        pos, score = arrays({c: v[lead:] for c, v in g.items()})
        n = len(pos)
        succ = _successors(pos, score, window)
        at = 0 if enter is None else _entry(pos, score, window, enter, strength)
        taken = np.zeros(n, dtype=bool)
        kept = np.zeros(n, dtype=bool)
        final = -1
        while at < n:
            taken[at] = True
            following = int(succ[at])
            kept[at] = following >= n or pos[following] - pos[at] >= window
            final, at = at, following
        if final >= 0 and undone:
            kept[final] = False
        held = np.maximum.accumulate(np.where(taken, np.arange(n), -1))
        state = np.where(held >= 0, pos[np.maximum(held, 0)], 0 if enter is None else enter)
        return {pos_name: pos, "taken": taken, "kept": kept, "state_pos": state}

    sliced = pre.withColumn(SLICE, tl.slice_of())
    columns = (
        "_from array<bigint>, _until array<bigint>, _peak array<double>, _exit_pos array<bigint>, _exit_score array<double>"
    )
    tables = map_groups(sliced, tl.home(), [pos_name], transfer, columns)
    entries = entry_states(
        tables, keys, compose, columns, follow,
        "_entered boolean, _enter_pos bigint, _enter_score double, _undoes boolean, _undone bigint",
    )
    known = entries.select(*keys, SLICE, "_entered", "_enter_pos", "_enter_score", F.lit(0).alias("_kind"))
    if scored:
        late = entries.filter("_undoes").select(*keys, F.col("_undone").alias(SLICE), F.lit(1).alias("_kind"))
        known = stacked(known, late)
    rows = stacked(sliced.withColumn("_kind", F.lit(2)), known)
    return map_groups(
        rows, tl.home(), ["_kind", pos_name], walk,
        f"`{pos_name}` bigint, taken boolean, kept boolean, state_pos bigint",
    )


def fold_timeline(tl: Timeline, window: int, width: int | None = None) -> Timeline:
    """Timeline for folds: wide slices compared with the window, bounded in rows."""
    return Timeline(tl.keys, tl.pos, tl.tie, width or max(1, int(window)) * SLICES_PER_WINDOW)


def anchors(df: DataFrame, tl: Timeline, window: int, width: int | None = None) -> DataFrame:
    """Anchor position of every distinct position: (keys, pos, anchor).

    A position more than ``window`` after the current anchor becomes the next
    anchor; everything in between belongs to the current one (no chaining).
    """
    # read by two passes: without the cut everything upstream would run twice
    distinct = checkpointed(df.select(*tl.keys, F.col(tl.pos).cast("bigint").alias(tl.pos)).distinct())
    ftl = fold_timeline(tl, window + 1, width)
    chain = _chain(distinct, ftl, int(window) + 1, scored=False)
    return chain.select(*tl.keys, tl.pos, F.col("state_pos").alias("anchor"))


def keep_distant(df: DataFrame, tl: Timeline, window: int, width: int | None = None) -> DataFrame:
    """Distinct positions that are more than ``window`` after the last kept one."""
    marked = anchors(df, tl, window, width)
    return marked.filter(F.col("anchor") == F.col(tl.pos)).select(*tl.keys, tl.pos)


def spaced_order(
    df: DataFrame, tl: Timeline, spacing: int | str, score: str, width: int | None = None
) -> DataFrame:
    """Keys and order columns of the rows that survive minimum spacing.

    ``spacing`` is a number or the name of a key column with one number per key; then
    ``width`` must be given.

    Walks in (pos, tie) order: a row at least ``spacing`` after the last kept row
    is kept; a closer one replaces it only when its score is strictly higher.
    """
    keys = list(tl.keys)
    strength = F.col(score).cast("double")
    # of several rows at one position only the first with the top score can stay
    best = checkpointed(
        df.groupBy(*keys, F.col(tl.pos).cast("bigint").alias(tl.pos)).agg(
            F.min(F.struct((-strength).alias("s"), *tl.tie)).alias("_b")
        )
    )
    pre = best.select(*keys, tl.pos, (-F.col("_b.s")).alias("_score"))
    reach = spacing if isinstance(spacing, str) else int(spacing)
    line = Timeline(tl.keys, tl.pos, tl.tie, width) if width else fold_timeline(tl, reach)
    chain = _chain(pre, line, reach, scored=True)
    kept = chain.filter("kept").select(*[F.col(c).alias(f"_k_{c}") for c in (*keys, tl.pos)])
    same = [best[c].eqNullSafe(kept[f"_k_{c}"]) for c in (*keys, tl.pos)]
    return best.join(kept, same, "left_semi").select(*keys, tl.pos, *[f"_b.{t}" for t in tl.tie])


def spaced(
    df: DataFrame, tl: Timeline, spacing: int | str, score: str, width: int | None = None
) -> DataFrame:
    """Rows that survive minimum spacing, see ``spaced_order``."""
    kept = spaced_order(df, tl, spacing, score, width)
    columns = [*tl.keys, *tl.order]
    kept = kept.select(*[F.col(c).alias(f"_k_{c}") for c in columns])
    return df.join(kept, [df[c].eqNullSafe(kept[f"_k_{c}"]) for c in columns], "left_semi")
