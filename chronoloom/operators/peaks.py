"""Peak picking on frame curves: local maxima, height, distance, prominence."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.durable import checkpointed
from ..core.folds import entry_states
from ..core.groups import map_groups, stacked
from ..core.timeline import SLICE, Timeline, carried, floor_div, neighbours


def local_maxima(frames: DataFrame, tl: Timeline, column: str) -> DataFrame:
    """Frames higher than both neighbours; a plateau counts once, in its middle."""
    x, pos = F.col(column), F.col(tl.pos)
    near = neighbours(frames, tl, 1, prev={"_a": x}, nxt={"_b": x})
    starts = F.when(F.col("_a").isNull() | (F.col("_a") != x), F.struct(pos.alias("p"), (F.col("_a") < x).alias("up")))
    ends = F.when(F.col("_b").isNull() | (F.col("_b") != x), F.struct(pos.alias("p"), (F.col("_b") < x).alias("down")))
    runs = carried(near.withColumns({"_s": starts, "_e": ends}), tl, last={"_l": F.col("_s")}, upcoming={"_r": F.col("_e")})
    middle = F.call_function("div", F.col("_l.p") + F.col("_r.p"), F.lit(2).cast("bigint"))
    return runs.filter("_l.up and _r.down").filter(pos == middle).drop("_a", "_b", "_s", "_e", "_l", "_r")


FAR = -(1 << 63)
"""State of a border that no kept peak lies close to."""


class _Spacing:
    """The peaks of a slice and of a stretch before it, and which kept peak may follow which.

    A set of peaks is what "highest first, each removes all others closer than ``distance``" leaves exactly if its
    peaks are that far apart and every other peak has a higher one of them closer than that.  Such a one can only be
    the kept peak before or after it, so the set is a path of pairs that are each valid by what lies between them,
    and there is one such path.  What a border knows of the path is its last kept peak, if that lies within twice the
    distance; else all peaks closer than the distance before the border still wait for a higher one.
    """

    def __init__(self, pos: np.ndarray, x: np.ndarray, begin: int, width: int, distance: int):
        order = np.lexsort((x, pos))
        order = order[np.append(pos[order][1:] != pos[order][:-1], True)]  # of repeated positions the highest
        self.pos = pos[order].tolist()
        rank = np.empty(len(order), np.int64)
        rank[np.lexsort((pos[order], x[order]))] = np.arange(len(order))  # of equal peaks the later one comes first
        self.rank = rank.tolist()
        self.begin, self.end, self.distance = begin, begin + width, distance
        self.own = int(np.searchsorted(pos[order], begin, side="left"))

    def entries(self) -> list[int]:
        """-1 for none close, and the peaks before the slice."""
        return [-1, *range(self.own)]

    def label(self, i: int) -> int:
        return FAR if i < 0 else self.pos[i]

    def index(self, label: int) -> int:
        return -1 if label == FAR else self.pos.index(label)

    def after(self, c: int) -> tuple[list[int], int | None]:
        """Peaks of the slice that may follow ``c``, and the first one behind it that it does not remove."""
        pos, rank, distance = self.pos, self.rank, self.distance
        found, first, top = [], None, -1
        start = c + 1 if c >= 0 else next((i for i in range(self.own) if pos[i] > self.begin - distance), self.own)
        for i in range(start, len(pos)):
            if first is not None and pos[i] - pos[first] >= distance:
                break
            near = c >= 0 and pos[i] - pos[c] < distance
            if i >= self.own and not near and rank[i] > top:
                found.append(i)
            if not (near and rank[c] > rank[i]):
                first = i if first is None else first
                top = max(top, rank[i])
        return found, first

    def exit(self, c: int, first: int | None) -> tuple[int, bool] | None:
        """State behind the slice if ``c`` is its last kept peak, and whether nothing waits there."""
        if c >= 0 and self.pos[c] >= self.end - 2 * self.distance:
            return self.pos[c], first is None
        if first is None or self.pos[first] > self.end - self.distance:
            return FAR, first is None
        return None

    def paths(self, entries: list[int]) -> tuple[dict[int, list[int]], list[tuple[int, int, bool, int]]]:
        """What each reached peak may follow; exits: entries (as bits), state, whether nothing waits, last kept peak."""
        reached: dict[int, int] = {}
        before: dict[int, list[int]] = {}
        exits = []

        def go(c: int, bits: int) -> None:
            following, first = self.after(c)
            for q in following:
                reached[q] = reached.get(q, 0) | bits
                before.setdefault(q, []).append(c)
            if (left := self.exit(c, first)) is not None:
                exits.append((bits, *left, c))

        for bit, entry in enumerate(entries):
            go(entry, 1 << bit)
        for i in range(self.own, len(self.pos)):
            if i in reached:
                go(i, reached[i])
        return before, exits


def keep_spaced_peaks(peaks: DataFrame, tl: Timeline, column: str, distance: int) -> DataFrame:
    """Highest first: a kept peak removes all others closer than ``distance``.

    Of equal peaks the later one comes first.  Each slice is condensed to a table of the states in which a
    border may be entered and left (see ``_Spacing``); tables are composed in blocks, the states that join the two
    ends of a key are handed down, and every slice is walked between its own two.  The number of jobs does not grow
    with the peaks, however their heights rise or fall.
    """
    keys = list(tl.keys)
    if distance <= 1:
        return peaks
    width, halo = distance * 64, 2 * distance
    peaks = checkpointed(peaks)
    at = F.col("_at")
    home = floor_div(at, width)
    rows = peaks.select(*keys, F.col(tl.pos).cast("bigint").alias("_at"), F.col(column).cast("double").alias("_x"))
    spread = rows.withColumn(SLICE, F.explode(F.sequence(home, floor_div(at + F.lit(halo), width))))

    def condense(g):
        s = int(g[SLICE][0])
        spacing = _Spacing(g["_at"], g["_x"], s * width, width, distance)
        entries = spacing.entries()
        table = {
            (spacing.label(entry), state, clean)
            for bits, state, clean, _ in spacing.paths(entries)[1]
            for bit, entry in enumerate(entries)
            if bits >> bit & 1
        }
        return packed(table, s, s)

    def packed(table, first, last):
        enter, leave, clean = zip(*sorted(table)) if table else ((), (), ())
        return {"_enter": [list(enter)], "_leave": [list(leave)], "_clean": [list(clean)], "_first": [first], "_last": [last]}

    def tables(g):
        return [
            ({*zip(map(int, e), map(int, l), map(bool, c))}, int(first), int(last))
            for e, l, c, first, last in zip(*(g[name] for name in ("_enter", "_leave", "_clean", "_first", "_last")))
        ]

    def passed(state: int, clean: bool, last: int, first: int) -> int | None:
        """A state behind slice ``last`` as it meets slice ``first``; none lies between them."""
        return state if first == last + 1 else FAR if clean else None

    def compose(g):
        parts = tables(g)
        table, first, last = parts[0]
        for own, begin, end in parts[1:]:
            leaving: dict[int, list] = {}
            for enter, leave, clean in own:
                leaving.setdefault(enter, []).append((leave, clean))
            table = {
                (enter, *out)
                for enter, leave, clean in table
                for out in leaving.get(passed(leave, clean, last, begin), ())
            }
            last = end
        return packed(table, first, last)

    def follow(g, enter):
        parts = tables(g)
        starts = [{FAR if enter is None else int(enter["_from"])}]
        for (table, _, last), (_, begin, _) in zip(parts, parts[1:]):
            starts.append({passed(out, clean, last, begin) for into, out, clean in table if into in starts[-1]} - {None})
        found, wanted = [], None
        for i in range(len(parts) - 1, -1, -1):
            table, _, last = parts[i]
            if wanted is None:
                fits = [r for r in table if (r[2] if enter is None else r[1] == int(enter["_to"]))]
            else:
                fits = [r for r in table if passed(r[1], r[2], last, parts[i + 1][1]) == wanted]
            (row,) = {r[:2] for r in fits if r[0] in starts[i]}  # one path joins both ends
            found.append(row)
            wanted = row[0]
        into, out = zip(*reversed(found))
        return {SLICE: g[SLICE], "_from": list(into), "_to": list(out)}

    def walk(g):
        # the two states of the slice come first
        into, out = int(g["_from"][0]), int(g["_to"][0])
        spacing = _Spacing(g["_at"][1:], g["_x"][1:], int(g[SLICE][0]) * width, width, distance)
        entry = spacing.index(into)
        before, exits = spacing.paths([entry])
        (at,) = {c for _, state, _, c in exits if state == out}
        chain = []
        while at >= spacing.own:
            chain.append(spacing.pos[at])
            (at,) = before[at]
        return {"_at": chain} if chain else None

    columns = "_enter array<bigint>, _leave array<bigint>, _clean array<boolean>, _first bigint, _last bigint"
    condensed = map_groups(spread, [*keys, SLICE], ["_at"], condense, columns)
    borders = entry_states(condensed, keys, compose, columns, follow, "_from bigint, _to bigint")
    both = stacked(spread.withColumn("_kind", F.lit(1)), borders.withColumn("_kind", F.lit(0)))
    kept = map_groups(both, [*keys, SLICE], ["_kind", "_at"], walk, "_at bigint")
    chosen = kept.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_at").alias("_k_at"))
    same = [peaks[k].eqNullSafe(chosen[f"_k_{k}"]) for k in keys] + [peaks[tl.pos] == chosen["_k_at"]]
    return peaks.join(chosen, same, "left_semi")


def _staircase(values: np.ndarray) -> tuple[list[float], list[float]]:
    """Records met when walking through ``values`` and the minimum before each.

    A walker of height v stops at the first record above v.
    """
    records, lows = [], []
    top, low = -np.inf, np.inf
    for v in values:
        if v > top:
            records.append(float(v))
            lows.append(float(low))
            top = v
        low = min(low, v)
    return records, lows


def prominences(
    frames: DataFrame, peaks: DataFrame, tl: Timeline, column: str, width: int | None = None
) -> DataFrame:
    """Add ``prominence``: height above the higher of the two valleys around a peak.

    A valley reaches to the next strictly higher frame, however far that is.  Each
    slice is condensed to the records a walker meets in it; these are chained per
    key, and the peaks of a slice are finished with what lies outside.
    """
    keys, pos = list(tl.keys), tl.pos
    line = Timeline(keys, pos, (), width or tl.width)
    curve = frames.select(*keys, F.col(pos).cast("bigint").alias(pos), F.col(column).cast("double").alias("_x"))
    marked = checkpointed(
        curve.join(peaks.select(*keys, F.col(pos).cast("bigint").alias(pos), F.lit(True).alias("_peak")), [*keys, pos], "left")
        .withColumn(SLICE, line.slice_of())
    )

    def condense(g):
        x = g["_x"]
        lv, ll = _staircase(x[::-1])
        rv, rl = _staircase(x)
        return {"_lv": [lv], "_ll": [ll], "_rv": [rv], "_rl": [rl], "_min": [float(x.min())]}

    def chain(vals, lows, mins, order, ctx_v, ctx_l, total):
        """What a walker meets before each slice of ``order``, and after the last."""
        seen = {}
        for i in order:
            seen[i] = (np.append(ctx_v, np.inf).tolist(), np.append(ctx_l, total).tolist())
            own_v, own_l = np.asarray(vals[i]), np.asarray(lows[i])
            above = ctx_v > own_v[-1]
            ctx_v = np.concatenate((own_v, ctx_v[above]))
            ctx_l = np.concatenate((own_l, np.minimum(ctx_l[above], mins[i])))
            total = min(total, mins[i])
        return seen, (ctx_v, ctx_l, total)

    nothing = (np.empty(0), np.empty(0), np.inf)

    def compose(g):
        n = len(g[SLICE])
        _, left = chain(g["_lv"], g["_ll"], g["_min"], range(n), *nothing)
        _, right = chain(g["_rv"], g["_rl"], g["_min"], range(n - 1, -1, -1), *nothing)
        return {"_lv": [left[0].tolist()], "_ll": [left[1].tolist()], "_rv": [right[0].tolist()], "_rl": [right[1].tolist()],
                "_min": [float(left[2])]}

    def follow(g, enter):
        n = len(g[SLICE])
        left = right = nothing
        if enter is not None:
            left, right = ((np.asarray(enter[v])[:-1], np.asarray(enter[m])[:-1], float(enter[m][-1])) for v, m in (("_cl", "_ml"), ("_cr", "_mr")))
        left, _ = chain(g["_lv"], g["_ll"], g["_min"], range(n), *left)
        right, _ = chain(g["_rv"], g["_rl"], g["_min"], range(n - 1, -1, -1), *right)
        return {
            SLICE: g[SLICE], "_cl": [left[i][0] for i in range(n)], "_ml": [left[i][1] for i in range(n)],
            "_cr": [right[i][0] for i in range(n)], "_mr": [right[i][1] for i in range(n)],
        }

    def base(part: np.ndarray, height: float, ctx, lows) -> float:
        """Lowest value on the way to the first higher one; ``part`` starts at the peak."""
        higher = np.flatnonzero(part > height)
        if higher.size:
            return float(part[: higher[0]].min()) if higher[0] else height
        inside = float(part.min()) if part.size else height
        at = int(np.searchsorted(ctx, height, side="right"))
        return min(inside, float(lows[at]))

    def finish(g):
        ctx = [g[c][0] for c in ("_cl", "_ml", "_cr", "_mr")]
        x, at, peak = g["_x"][1:], g[pos][1:], g["_peak"][1:]
        wanted = np.flatnonzero([p is True or p is np.True_ for p in peak])
        if not wanted.size:
            return None
        out = []
        for i in wanted:
            height = float(x[i])
            left = base(x[i::-1], height, ctx[0], ctx[1])
            right = base(x[i:], height, ctx[2], ctx[3])
            out.append(height - max(left, right))
        return {pos: at[wanted].astype(np.int64), "prominence": out}

    columns = "_lv array<double>, _ll array<double>, _rv array<double>, _rl array<double>, _min double"
    stairs = map_groups(marked, line.home(), [pos], condense, columns)
    arrays = "_cl array<double>, _ml array<double>, _cr array<double>, _mr array<double>"
    entries = entry_states(stairs, keys, compose, columns, follow, arrays)
    rows = stacked(marked.withColumn("_kind", F.lit(1)), entries.withColumn("_kind", F.lit(0)))
    found = map_groups(rows, line.home(), ["_kind", pos], finish, f"`{pos}` bigint, prominence double")
    return peaks.join(found.select(*keys, pos, "prominence"), [*keys, pos])


def find_peaks(
    frames: DataFrame, tl: Timeline, column: str, *, height: float | None = None, distance: int = 1,
    prominence: float | None = None,
) -> DataFrame:
    """Peaks of a curve, filtered by height, then distance, then prominence."""
    if prominence is not None:
        # the curve is read by the maxima and by the valley search
        frames = checkpointed(frames)
    peaks = local_maxima(frames, tl, column)
    if height is not None:
        peaks = peaks.filter(F.col(column) >= height)
    peaks = keep_spaced_peaks(peaks, tl, column, distance)
    if prominence is None:
        return peaks
    return prominences(frames, peaks, tl, column).filter(F.col("prominence") >= prominence)


def gradient(frames: DataFrame, tl: Timeline, column: str, name: str) -> DataFrame:
    """Central difference; one-sided at the ends."""
    near = neighbours(frames, tl, 1, prev={"_a": F.col(column)}, nxt={"_b": F.col(column)})
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    rise = F.coalesce("_b", column) - F.coalesce("_a", column)
    return near.withColumn(name, F.when(both, rise / 2).otherwise(rise)).drop("_a", "_b")

