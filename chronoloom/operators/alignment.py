"""Sequence problems between expected and observed units, and interval-local replacement."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core.durable import checkpointed
from ..core.groups import Arrays, map_groups, stacked
from ..core.quantiles import attach, union_all
from ..core.states import ABSORB, APPEND, fold_states
from ..core.timeline import SLICE, Timeline, floor_div
from ..functions.lattice import Lattice
from ..functions.text import compose
from .joins import interval_join, suppress_near
from .metrics import MIN_CHUNK_ANCHORS

# fixed values: edit costs of the token alignment, in tenths so that ties are exact
INSERT_COST, DELETE_COST, SUBSTITUTE_COST = 10, 11, 10


def _align(expected: list[str], observed: list[str]) -> list[tuple[int | None, int | None, str]]:
    """Cheapest edit path; the diagonal wins ties, then insertion before deletion.

    One numpy pass per expected token: insertions are a running minimum along the row.
    """
    codes = pd.factorize(np.array([*expected, *observed], dtype=object))[0]
    left, right = codes[: len(expected)], codes[len(expected):]
    ramp = np.arange(len(right) + 1) * INSERT_COST
    row = ramp.copy()
    moves = np.ones((len(left) + 1, len(right) + 1), dtype=np.int8)  # 0 diagonal, 1 insert, 2 delete
    moves[:, 0] = 2
    for i, code in enumerate(left, 1):
        diagonal = row[:-1] + np.where(right == code, 0, SUBSTITUTE_COST)
        entered = row + DELETE_COST
        entered[1:] = np.minimum(entered[1:], diagonal)
        below = row + DELETE_COST
        row = np.minimum.accumulate(entered - ramp) + ramp
        inserted = row[1:] == row[:-1] + INSERT_COST
        moves[i, 1:] = np.where(row[1:] == diagonal, 0, np.where(inserted | (row[1:] < below[1:]), 1, 2))
    path = []
    i, j = len(left), len(right)
    while i or j:
        how = moves[i, j]
        i, j = i - (how != 1), j - (how != 2)
        if how == 0:
            path.append((i, j, "match" if left[i] == right[j] else "substitute"))
        else:
            path.append((None, j, "insert") if how == 1 else (i, None, "delete"))
    return path[::-1]


def align_tokens(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edge table between expected and observed tokens of a line.

    Both sides: keys, idx, token.  ``keys`` must name one line or phrase: the cost
    table of a group is expected x observed tokens.
    """
    keys = list(keys)
    rows = expected.select(*keys, F.lit(0).alias("_side"), F.col("idx").cast("bigint").alias("idx"), F.lower("token").alias("token"))
    rows = rows.unionByName(
        observed.select(*keys, F.lit(1).alias("_side"), F.col("idx").cast("bigint").alias("idx"), F.lower("token").alias("token"))
    )

    def solve(g):
        left, right = g["_side"] == 0, g["_side"] == 1
        path = _align(list(g["token"][left]), list(g["token"][right]))
        a, b = g["idx"][left], g["idx"][right]
        return {
            "expected_idx": [None if i is None else int(a[i]) for i, _, _ in path],
            "observed_idx": [None if j is None else int(b[j]) for _, j, _ in path],
            "operation": [how for _, _, how in path],
        } if path else None

    return map_groups(
        rows, keys, ["_side", "idx"], solve, "expected_idx bigint, observed_idx bigint, operation string"
    )


def unit_coverage(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matched share of the expected units.

    Counts the matches of the token alignment (a longest-common-subsequence kind of
    measure), not the recursive longest-block similarity of a text differ.
    """
    return edges.groupBy(*keys).agg(
        F.count("expected_idx").alias("expected"), F.count_if(F.col("operation") == "match").alias("matched")
    ).withColumn(
        "coverage", F.when(F.col("expected") > 0, F.round(F.col("matched") / F.col("expected"), 6)).otherwise(F.lit(0.0))
    )


def decode_moras(edges: DataFrame, plan: DataFrame, phones: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected morae with the span of their matched phones; missing ones stay listed.

    plan: keys, mora_idx, expected_idx; phones: keys, observed_idx, aligned and
    refined spans, confidence.  Confidence = mean x coverage x (1 - .25 x share of
    substitutions).
    """
    keys = list(keys)
    mapped = plan.join(edges.filter("expected_idx is not null"), [*keys, "expected_idx"], "left").join(
        phones, [*keys, "observed_idx"], "left"
    )
    seen = F.col("observed_idx").isNotNull()
    out = mapped.groupBy(*keys, "mora_idx").agg(
        F.count("*").alias("expected_phones"), F.count_if(seen).alias("matched_phones"),
        F.count_if(F.col("operation") == "substitute").alias("_sub"), F.avg("confidence").alias("_mean"),
        F.min("aligned_start").alias("aligned_start"), F.max("aligned_end").alias("aligned_end"),
        F.min("refined_start").alias("refined_start"), F.max("refined_end").alias("refined_end"),
    )
    n = F.col("expected_phones")
    factor = F.greatest(F.lit(0.0), 1 - 0.25 * F.col("_sub") / n)
    confidence = F.least(F.lit(1.0), F.col("_mean") * (F.col("matched_phones") / n) * factor)
    # least() skips nulls: a missing mora has no confidence, not 1
    confidence = F.when(F.col("matched_phones") > 0, confidence)
    return out.withColumns({"confidence": F.round(confidence, 6), "missing": F.col("matched_phones") == 0}).drop("_sub", "_mean")


# --------------------------------------------------------------------------
# monotone assignment of lines to segments


# fixed values: gains and costs of giving a run of lines to a segment, and of its confidence
LINE_GAIN = {"ratio": 2.45, "overlap": 0.55, "length": -0.38, "place": -0.34, "each": -0.20, "further": -0.018}
LINE_TRUST = {"ratio": 0.68, "overlap": 0.32, "length": -0.16, "most_length": 1.5}
SKIPPED_LINE = 0.065


def _letters(text: Column) -> Column:
    return F.regexp_replace(compose(text), "[^\\p{L}\\p{N}]", "")


def _grams(text: Column) -> Column:
    """Pairs of neighbouring characters; a single character stands for itself."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(F.length(text) > 0, pairs).otherwise(F.array().cast("array<string>"))


def _gain(common, own, total, size, written, first, after, seg, segments, lines) -> dict:
    """Gain, similarity and confidence of runs that share ``common`` of ``total`` pairs with a segment of ``own`` pairs.

    ``size`` and ``written`` are the characters of the segment and of the runs.
    """
    ratio, overlap = 2.0 * common / (own + total), common / np.minimum(own, total)
    length = np.abs(np.log((written + 1) / (size + 1)))
    place = np.abs((first + after) / 2.0 / lines - (seg + 0.5) / segments)
    w, t = LINE_GAIN, LINE_TRUST
    gain = (
        w["ratio"] * ratio + w["overlap"] * overlap + w["length"] * length + w["place"] * place + w["each"]
        + w["further"] * (after - first - 1)
    )
    trust = t["ratio"] * ratio + t["overlap"] * overlap + t["length"] * np.minimum(length, t["most_length"])
    return {"gain": gain, "similarity": ratio, "confidence": np.clip(trust, 0.0, 1.0)}


def _longest(own, floor: float):
    """Pairs of a run above which it is below the floor whatever it shares."""
    return own * (2.0 / floor - 1.0) if floor > 0 else np.inf


def line_runs(
    segments: DataFrame, lines: DataFrame, keys: Sequence[str], most: int | None = None, floor: float = 0.20
) -> DataFrame:
    """Runs of lines a segment may stand for: keys, seg, first, after, gain, similarity, confidence.

    Segments and lines meet on shared character pairs, so a segment's task sees only the lines
    that have one in common with it, and the line lengths.  The similarity of a run is the Dice
    coefficient of the pairs, repeats included, taken line by line.
    """
    keys = list(keys)

    def pairs(df: DataFrame, name: str, count: str) -> DataFrame:
        return df.select(*keys, name, F.explode(_grams(F.col("letters"))).alias("gram")).groupBy(*keys, name, "gram").agg(
            F.count("*").alias(count)
        )

    shared = pairs(segments, "seg", "heard").join(pairs(lines, "line", "sung"), [*keys, "gram"])
    sheet = lines.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line", F.length("letters").alias("n")))), lambda x: x["n"]).alias("sizes")
    )
    many = segments.groupBy(*keys).agg(F.count("*").alias("segments"))
    facts = segments.select(*keys, "seg", F.length("letters").alias("size")).join(sheet, keys).join(many, keys)
    rows = stacked(
        facts.withColumn("_kind", F.lit(0)), shared.select(*keys, "seg", "line", "gram", "heard", "sung").withColumn("_kind", F.lit(1))
    )

    def solve(g):
        if g["_kind"][0] or len(g["_kind"]) < 2:
            return None
        sizes, size = np.asarray(g["sizes"][0], dtype=np.int64), int(g["size"][0])
        gram, heard, line = g["gram"][1:], g["heard"][1:], g["line"][1:].astype(np.int64)
        code, names = pd.factorize(gram)
        wanted = np.zeros(len(names), dtype=np.int64)
        wanted[code] = heard
        own = max(1, size - 1)
        grams, chars = np.where(sizes > 0, np.maximum(sizes - 1, 1), 0), sizes
        upto = np.concatenate(([0], np.cumsum(grams)))
        written = np.concatenate(([0], np.cumsum(chars)))
        longest = _longest(own, floor)
        order = np.argsort(line, kind="stable")
        line, code, sung = line[order], code[order], g["sung"][1:][order].astype(np.int64)
        # how often a pair was sung in all earlier rows, and in the rows before the first line of a run
        by_pair = np.argsort(code, kind="stable")
        upto_pair = np.cumsum(sung[by_pair]) - sung[by_pair]
        begins = np.flatnonzero(np.r_[True, np.diff(code[by_pair]) != 0])
        earlier, before = np.empty_like(sung), np.zeros(len(names), dtype=np.int64)
        earlier[by_pair] = upto_pair - np.repeat(upto_pair[begins], np.diff(np.r_[begins, len(code)]))
        found, passed = [], 0
        for first in range(len(sizes)):
            stop = int(np.searchsorted(upto, upto[first] + longest, side="right")) - 1
            stop = min(stop, len(sizes), first + most if most else len(sizes))
            lo, hi = np.searchsorted(line, [first, stop])
            np.add.at(before, code[passed:lo], sung[passed:lo])
            passed = lo
            if hi == lo:
                continue
            # pairs in common after each further row, no pair more often than it was heard
            own_code = code[lo:hi]
            taken = np.clip(wanted[own_code] - (earlier[lo:hi] - before[own_code]), 0, sung[lo:hi])
            common = np.cumsum(np.bincount(line[lo:hi] - first, weights=taken, minlength=stop - first).astype(np.int64))
            after = np.arange(first + 1, stop + 1)
            total = upto[after] - upto[first]
            ratio = 2.0 * common / (own + total)
            keep = (ratio >= floor) & (common > 0)
            if keep.any():
                after, common, total = after[keep], common[keep], total[keep]
                worth = _gain(
                    common, own, total, size, written[after] - written[first], first, after, g["seg"][0], g["segments"][0], len(sizes)
                )
                found.append((np.full(len(after), first), after, *worth.values()))
        if not found:
            return None
        first, after, gain, ratio, trust = (np.concatenate(part) for part in zip(*found, strict=True))
        return {"first": first, "after": after, "gain": gain, "similarity": ratio, "confidence": trust}

    return map_groups(
        rows, [*keys, "seg"], ["_kind", "line"], solve,
        "first bigint, after bigint, gain double, similarity double, confidence double",
    )


def _best_path(runs: dict) -> list[int]:
    """Runs of the best way through a song; they come by segment, first line and end."""
    seg, first, after, gain = (np.asarray(runs[c]) for c in ("seg", "first", "after", "gain"))
    top = int(after.max())
    toll = np.arange(top + 1) * SKIPPED_LINE
    best, source = -toll, np.full(top + 1, -1)  # source: run that ends the best way here
    earlier = np.full(len(seg), -1)
    starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(seg)], strict=True):
        reach = best[first[a:b]] + gain[a:b]
        earlier[a:b] = source[first[a:b]]
        rank = np.lexsort((np.arange(b - a), -reach))
        ends, where = np.unique(after[a:b][rank], return_index=True)
        winner = rank[where]
        better = reach[winner] > best[ends]
        best, source = best.copy(), source.copy()
        best[ends[better]], source[ends[better]] = reach[winner[better]], a + winner[better]
        # lines may be left out: carry the best start of a position forward
        lifted = best + toll
        carried = np.maximum.accumulate(lifted)
        origin = np.maximum.accumulate(np.where(lifted == carried, np.arange(top + 1), 0))
        best, source = carried - toll, source[origin]
    chosen, at = [], int(source[top])
    while at >= 0:
        chosen.append(at)
        at = int(earlier[at])
    return chosen[::-1]


def _pair_codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """``_grams`` of several texts as numbers, and the text each one is from."""
    sizes = np.array([len(t) for t in texts])
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    ends, codes = np.cumsum(sizes[sizes > 0]) - 1, chars << 21
    codes[:-1] |= chars[1:]
    alone = np.zeros(len(chars), dtype=bool)
    alone[ends] = sizes[sizes > 0] == 1
    codes[ends] = chars[ends] << 21  # a single character; others end with the pair before
    inside = np.ones(len(chars), dtype=bool)
    inside[ends] = False
    return codes[inside | alone], text[inside | alone]


def _song_runs(heard: Sequence[str], sung: Sequence[str], most: int | None, floor: float) -> dict | None:
    """``line_runs`` of all segments of a song at once, from tables of runs x pairs."""
    code, line = _pair_codes(sung)
    names, code = np.unique(code, return_inverse=True)
    if not len(names):
        return None
    lines, wide = len(sung), len(names)
    upto = np.zeros((lines + 1, wide), dtype=np.int64)
    np.cumsum(np.bincount(line * wide + code, minlength=lines * wide).reshape(lines, wide), axis=0, out=upto[1:])
    first, after = np.triu_indices(lines + 1, 1)
    if most:
        first, after = first[after - first <= most], after[after - first <= most]
    run = upto[after] - upto[first]
    total = run.sum(axis=1)
    written = np.concatenate(([0], np.cumsum([len(t) for t in sung])))
    written = written[after] - written[first]
    code, seg = _pair_codes(heard)
    at = np.minimum(np.searchsorted(names, code), wide - 1)
    shared = names[at] == code
    wanted = np.bincount(seg[shared] * wide + at[shared], minlength=len(heard) * wide).reshape(len(heard), wide)
    found = []
    for i, text in enumerate(heard):
        own = max(1, len(text) - 1)
        common = np.minimum(run, wanted[i]).sum(axis=1)
        keep = np.flatnonzero((common > 0) & (total <= _longest(own, floor)))
        keep = keep[2.0 * common[keep] / (own + total[keep]) >= floor]
        if len(keep):
            a, b = first[keep], after[keep]
            worth = _gain(common[keep], own, total[keep], len(text), written[keep], a, b, i, len(heard), lines)
            found.append({"seg": np.full(len(keep), i), "first": a, "after": b, **worth})
    return {c: np.concatenate([f[c] for f in found]) for c in found[0]} if found else None


SONG_CELLS, SONG_CHARS = 1 << 20, 1 << 20
"""A song whose table of runs x pairs, times 16 segments, and whose characters are no more is solved in one task."""


def assign_lines(
    segments: DataFrame, lines: DataFrame, keys: Sequence[str], most: int | None = None, floor: float = 0.20
) -> DataFrame:
    """Contiguous line ranges per segment in order; both sides may be skipped.

    segments: keys, idx, text; lines: keys, idx, text.  A segment may take any number of lines
    unless ``most`` bounds it.  A song of bounded size (``SONG_CELLS``) is scored and searched in one
    task.  The runs of a longer one are scored per segment (``line_runs``); only runs above
    ``floor`` reach its path search, which keeps one best sum per line position.
    """
    keys = list(keys)

    def side(df: DataFrame, kind: int) -> DataFrame:
        letters = F.coalesce(_letters(F.col("text")), F.lit(""))
        known = df.filter(" and ".join(f"`{k}` is not null" for k in keys))
        return known.select(*keys, F.lit(kind).alias("_kind"), F.col("idx").cast("bigint").alias("idx"), letters.alias("letters"))

    # the letters are made once: sizes, short and long songs read them
    rows = checkpointed(side(segments, 0).unionByName(side(lines.filter(F.trim("text") != ""), 1)))
    many, chars = F.count_if(F.col("_kind") == 1), F.sum(F.length("letters") * F.col("_kind"))
    cells = many.cast("double") * (many + 1) / 2 * chars
    large = (
        rows.groupBy(*keys).agg(cells.alias("_cells"), F.count_if(F.col("_kind") == 0).alias("_segments"), F.sum(F.length("letters")).alias("_chars"))
        .filter((F.col("_cells") > SONG_CELLS) | (F.col("_cells") * F.col("_segments") > 16.0 * SONG_CELLS) | (F.col("_chars") > SONG_CHARS))
    )
    large = checkpointed(large.select(*keys))

    def song(g):
        heard, sung = (np.flatnonzero(g["_kind"] == kind) for kind in (0, 1))
        if not len(heard) or not len(sung):
            return None
        runs = _song_runs(list(g["letters"][heard]), list(g["letters"][sung]), most, floor)
        path = _best_path(runs) if runs else []
        if not path:
            return None
        # a missing number stays missing, the others stay whole numbers
        idx = g["idx"] if g["_known"].all() else np.where(g["_known"], g["idx"].astype(object), None)
        after = idx[sung[runs["after"][path] - 1]]
        return {
            "segment_idx": idx[heard[runs["seg"][path]]], "line_start": idx[sung[runs["first"][path]]],
            "line_end": after + 1 if g["_known"].all() else np.array([None if i is None else i + 1 for i in after], dtype=object),
            "similarity": runs["similarity"][path], "confidence": runs["confidence"][path],
        }

    def by_song(some: DataFrame) -> DataFrame:
        known = some.withColumns({"_known": F.col("idx").isNotNull(), "idx": F.coalesce("idx", F.lit(0).cast("bigint"))})
        return map_groups(
            known, keys, ["_kind", "_known", "idx"], song,
            "segment_idx bigint, line_start bigint, line_end bigint, similarity double, confidence double",
        )

    if large.isEmpty():
        return by_song(rows)
    return by_song(rows.join(large, keys, "left_anti")).unionByName(_assigned_by_run(rows.join(large, keys, "left_semi"), keys, most, floor))


def _assigned_by_run(rows: DataFrame, keys: list[str], most: int | None, floor: float) -> DataFrame:
    """``assign_lines`` of songs whose segments are scored apart."""
    number = (F.row_number().over(Window.partitionBy(*keys).orderBy("idx")) - 1).cast("bigint")
    heard = rows.filter("_kind = 0").drop("_kind").withColumn("seg", number)
    sung = rows.filter("_kind = 1").drop("_kind").withColumn("line", number)

    def solve(g):
        path = _best_path(g)
        return {c: np.asarray(g[c])[path] for c in ("seg", "first", "after", "similarity", "confidence")} if path else None

    picked = map_groups(
        line_runs(heard, sung, keys, most, floor), keys, ["seg", "first", "after"], solve,
        "seg bigint, first bigint, after bigint, similarity double, confidence double",
    )
    begin = sung.select(*keys, F.col("line").alias("first"), F.col("idx").alias("line_start"))
    end = sung.select(*keys, (F.col("line") + 1).alias("after"), (F.col("idx") + 1).alias("line_end"))
    return (
        picked.join(heard.select(*keys, "seg", F.col("idx").alias("segment_idx")), [*keys, "seg"])
        .join(begin, [*keys, "first"]).join(end, [*keys, "after"])
        .select(*keys, "segment_idx", "line_start", "line_end", "similarity", "confidence")
    )


# --------------------------------------------------------------------------
# phrase grid assignment


NODES_AT_ONCE = 512


def _cheapest_cells(at, home, trust, drop, silent, cells, weights):
    """Cheapest strictly increasing cells of a stretch of anchors; -1 leaves an anchor out.

    ``at`` and ``home`` are refined and aligned places in steps, ``cells`` candidate cells per
    anchor.  Every (anchor, cell) is a node.  A node is worth what it saves against leaving out
    all anchors so far; it builds on the best earlier node with a lower cell.  Earlier nodes are
    read in blocks, newest first, until no older one is cheap enough to matter, since a
    transition costs nothing at best.  So the search is exact and rarely looks far back.
    """
    anchor = np.repeat(np.arange(len(at)), [len(c) for c in cells])
    if not len(anchor):
        return np.full(len(at), -1), np.zeros(len(at), dtype=bool)
    cell = np.concatenate([np.asarray(c, dtype=np.int64) for c in cells if len(c)])
    own = (0.35 + 0.65 * trust)[anchor] * (
        weights["refined"] * (at[anchor] - cell) ** 2 + weights["aligned"] * (home[anchor] - cell) ** 2
    ) - drop[anchor]
    worth, back = np.empty(len(cell)), np.full(len(cell), -1)
    least = np.empty(len(cell) + 1)  # smallest worth among the first n nodes
    least[0] = np.inf
    edges = np.searchsorted(anchor, np.arange(len(at) + 1))
    for i in range(len(at)):
        lo, hi = edges[i], edges[i + 1]
        if lo == hi:
            continue
        here, best, via = cell[lo:hi, None], np.zeros(hi - lo), np.full(hi - lo, -1)
        stop = lo
        while stop > 0 and least[stop] < best.max() - 1e-12:
            start = max(0, stop - NODES_AT_ONCE)
            # newest anchor first, lower cells first: the order in which ties are won
            block = start + np.lexsort((cell[start:stop], -anchor[start:stop]))
            gap = at[i] - at[anchor[block]]
            move = weights["transition"] * np.abs(here - cell[block] - gap) / np.maximum(1.0, gap)
            move[:, silent[anchor[block]] != silent[i]] = 0.0
            total = np.where(cell[block] < here, worth[block] + move, np.inf)
            lowest = total.min(axis=1)
            pick = block[np.argmax(total <= lowest[:, None] + 1e-12, axis=1)]
            better = lowest < best - 1e-12
            best[better], via[better] = lowest[better], pick[better]
            stop = start
        worth[lo:hi], back[lo:hi] = own[lo:hi] + best, via
        least[lo + 1 : hi + 1] = np.minimum(least[lo], np.minimum.accumulate(worth[lo:hi]))
    out, placed = np.full(len(at), -1), np.zeros(len(at), dtype=bool)
    node = int(np.argmin(worth)) if worth.min() < -1e-12 else -1
    while node >= 0:
        out[anchor[node]], placed[anchor[node]] = cell[node], True
        node = int(back[node])
    return out, placed


def _independent(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Numbers the parts of a phrase that no choice connects, as ``_part``.

    After a silence the expected gap is forgotten; if no cell before it reaches one behind it,
    either side can be solved alone.
    """
    line = Window.partitionBy(*group).orderBy(*order)
    rows = rows.withColumn("_hush", F.count_if(F.col("kind") == "silence").over(line))
    ends = rows.filter("_use").groupBy(*group, "_hush").agg(
        F.min(F.array_min("_cells")).alias("_low"), F.max(F.array_max("_cells")).alias("_high")
    )
    along = Window.partitionBy(*group).orderBy("_hush")
    before = F.max("_high").over(along.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.min("_low").over(along.rowsBetween(0, Window.unboundedFollowing))
    ends = ends.withColumn("_cut", F.coalesce(before < behind, F.lit(True)).cast("int"))
    parts = ends.withColumn("_part", F.sum("_cut").over(along)).select(*group, "_hush", "_part")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*group, "_hush")]
    return rows.filter("_use").alias("l").join(parts.alias("r"), same).select("l.*", "r._part")


def assign_cells(
    anchors: DataFrame, tl: Timeline, rate: int, *, subdivisions: int = 4, radius: int = 2, max_steps: float = 0.60,
    refined_weight: float = 0.72, aligned_weight: float = 0.18, transition_weight: float = 0.22,
    unassigned_penalty: float = 1.05, scale: int = 1000,
    kinds: Sequence[str] = ("mora", "phrase"), phrase: Sequence[str] = ("phrase_id",),
) -> DataFrame:
    """Strictly increasing lattice cells for the anchors of each phrase.

    anchors: keys, phrase columns, ``tl.pos`` (refined), aligned, confidence, kind,
    bpm, beat_offset, tie columns.  Candidate cells and the parts of a phrase that do
    not touch each other come from Catalyst; the exact search runs per part.  A silence
    between two anchors resets the expected gap.  Adds ``grid_sample`` (null = unsnapped).
    """
    keys = list(tl.keys)
    group = [*keys, *phrase]
    lat = Lattice(rate, F.col("bpm"), F.col("beat_offset"), subdivisions, scale)
    pos = F.col(tl.pos).cast("bigint")

    def around(centre: Column) -> Column:
        return F.sequence(centre - radius, centre + radius)

    cells = F.array_sort(F.array_union(around(lat.cell(pos)), around(lat.cell(F.col("aligned")))))
    near = F.filter(
        cells,
        lambda c: (lat.position(c) >= 0) & (F.abs(pos - lat.position(c)) * lat.den <= lat.num * F.lit(max_steps)),
    )
    tie = list(tl.tie)
    rows = anchors.select(
        *group, pos.alias(tl.pos), *tie, "aligned", "confidence", "kind", "beat_offset",
        lat.num.alias("_num"), lat.den.alias("_den"), near.alias("_cells"), F.col("kind").isin(*kinds).alias("_use"),
    )
    parts = _independent(rows, group, [tl.pos, *tie])
    weights = {"refined": refined_weight, "aligned": aligned_weight, "transition": transition_weight}

    def solve(g):
        step = int(g["_num"][0]) / int(g["_den"][0])
        start = int(g["beat_offset"][0])
        trust = np.asarray(g["confidence"], dtype=float)
        found, placed = _cheapest_cells(
            (g[tl.pos] - start) / step, (g["aligned"] - start) / step, trust, unassigned_penalty * (0.20 + 0.80 * trust),
            g["_hush"], g["_cells"], weights,
        )
        return {"_cell": found[placed], **{t: g[t][placed] for t in tie}} if placed.any() else None

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    picked = map_groups(
        parts, [*group, "_part"], [tl.pos, *tie], solve, "_cell bigint, " + ", ".join(f"`{t}` {types[t]}" for t in tie)
    ).drop("_part")
    joined = anchors.join(picked, [*group, *tie], "left")
    return joined.withColumn("grid_sample", F.when(F.col("_cell").isNotNull(), lat.position(F.col("_cell")))).drop("_cell")


# --------------------------------------------------------------------------
# spans take the nearest unused event


def match_unused(
    spans: DataFrame, events: DataFrame, keys: Sequence[str], before: int, after: int, end_slack: int = 0,
    width: int | None = None,
) -> DataFrame:
    """In order of start, each span takes the nearest event nobody took before it.

    spans: keys, span_id, start, end, active_start; events: keys, event_id, at,
    confidence.  The window is [start - before, min(start + after, end + end_slack));
    distance counts from ``active_start``, the more confident event wins a tie.
    Slices with a halo; a span whose window touches rows an earlier, still open
    span may use waits for the next round.
    """
    keys = list(keys)
    reach = before + after
    width = width or max(1, reach) * 64
    halo = 2 * max(1, reach)
    stop = F.least(F.col("start") + after, F.col("end") + end_slack)
    open_spans = checkpointed(
        spans.select(*keys, F.col("start").cast("bigint").alias("_at"), F.lit(0).alias("_side"), F.col("span_id").alias("_id"),
                     F.col("active_start").cast("double").alias("_v"), stop.cast("bigint").alias("_stop"))
    )
    free = checkpointed(
        events.select(*keys, F.col("at").cast("bigint").alias("_at"), F.lit(1).alias("_side"), F.col("event_id").alias("_id"),
                      F.col("confidence").cast("double").alias("_v"), F.lit(None).cast("bigint").alias("_stop"))
    )
    found: list[DataFrame] = []
    turn = 0

    def solver(shift: int):
        def solve(g):
            begin = int(g[SLICE][0]) * width - shift
            side, at = g["_side"], g["_at"]
            span, event = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            # nothing open to the left of the loaded rows means nothing is unknown
            low = -(2**62) if g["_first"][0] >= begin - halo else begin - halo + reach
            places = at[event]
            m = len(event)
            # next free event to the left and right, with path compression
            left, right = np.arange(m + 1), np.arange(m + 2)

            def free_left(j):  # last free index <= j, -1 when none; stored shifted by one
                j += 1
                while left[j] != j:
                    left[j] = left[left[j]]
                    j = left[j]
                return j - 1

            def free_right(j):  # first free index >= j, m when none
                while right[j] != j:
                    right[j] = right[right[j]]
                    j = right[j]
                return j

            out_id, out_event, waits = [], [], []
            for i in span[np.lexsort((g["_id"][span], at[span]))]:
                own = begin <= at[i] < begin + width
                start, stop_at = at[i] - before, int(g["_stop"][i])
                if start <= low:
                    low = max(low, stop_at - 1)
                    if own:
                        out_id.append(int(g["_id"][i])), out_event.append(None), waits.append(True)
                    continue
                a, b = np.searchsorted(places, [start, stop_at])
                middle = int(np.clip(np.searchsorted(places, g["_v"][i]), a, b))
                choice = []
                for step, j in ((-1, free_left(middle - 1)), (1, free_right(middle))):
                    spot = places[j] if a <= j < b else None
                    # all free events at that very place; the confident one wins
                    while a <= j < b and places[j] == spot:
                        choice.append(j)
                        j = free_left(j - 1) if step < 0 else free_right(j + 1)
                pick = None
                if choice:
                    pick = min(choice, key=lambda j: (abs(places[j] - g["_v"][i]), -g["_v"][event[j]], g["_id"][event[j]]))
                    left[pick + 1], right[pick] = pick, pick + 1
                if own:
                    out_id.append(int(g["_id"][i]))
                    out_event.append(None if pick is None else int(g["_id"][event[pick]]))
                    waits.append(False)
            return {"span_id": out_id, "event_id": out_event, "_open": waits} if out_id else None

        return solve

    while True:
        shift = (turn % 2) * (width // 2)
        firsts = open_spans.groupBy(*keys).agg(F.min("_at").alias("_first"))
        at = F.col("_at") + F.lit(shift)
        rows = attach(open_spans.unionByName(free), firsts, keys).filter("_first is not null")
        rows = rows.withColumn(
            SLICE, F.explode(F.sequence(floor_div(at - F.lit(halo), width), floor_div(at + F.lit(halo), width)))
        )
        result = checkpointed(
            map_groups(rows, [*keys, SLICE], ["_at", "_side", "_id"], solver(shift), "span_id bigint, event_id bigint, _open boolean")
        )
        done = result.filter("not _open").select(*keys, "span_id", "event_id")
        found.append(done)
        rest = result.filter("_open").select(*keys, F.col("span_id").alias("_id"))
        if rest.isEmpty():
            return union_all(found)
        open_spans = checkpointed(open_spans.join(rest, [*keys, "_id"], "left_semi"))
        taken = done.filter("event_id is not null").select(*keys, F.col("event_id").alias("_id"))
        free = checkpointed(free.join(taken, [*keys, "_id"], "left_anti"))
        turn += 1


# --------------------------------------------------------------------------
# interval-local replacement


def replace_in_intervals(
    hits: DataFrame, anchors: DataFrame, chunks: DataFrame, lengths: DataFrame, tl: Timeline, tolerance: int, step: int
) -> tuple[DataFrame, DataFrame]:
    """Replace automatic vocal hits inside proven chunks by new anchors: the hits, and four counters per key.

    hits: keys, id, ``tl.pos``, snapped, primary_stem, edited, locked.  anchors: keys, id,
    chunk_idx, ``tl.pos`` (refined), grid_sample, active, chart_candidate, in time order
    with non-decreasing grid samples.  chunks: keys, idx, start, end, status,
    anchor_count.  lengths: keys, sample_count.  ``step`` bounds the lattice step.
    """
    keys, pos = list(tl.keys), tl.pos
    length = F.col("sample_count")
    proven = attach(chunks, lengths, keys).filter((F.col("status") == "success") & (F.col("anchor_count") >= MIN_CHUNK_ANCHORS)).select(
        *keys, "idx", F.greatest(F.col("start"), F.lit(0)).alias("start"), F.least(F.col("end"), length).alias("end")
    )
    automatic = hits.filter((F.col("primary_stem") == "vocals") & ~F.col("edited") & ~F.col("locked"))
    removable = interval_join(automatic, proven, tl, "start", "end", "idx", how="semi")
    protected = hits.join(removable.select(*keys, "id"), [*keys, "id"], "left_anti")

    def inside(c: Column) -> Column:
        return F.least(F.greatest(c, F.lit(0)), length - 1)

    wanted = attach(anchors.filter("grid_sample is not null and active and chart_candidate"), lengths, keys)
    chosen = wanted.withColumns({"snapped": inside(F.col("grid_sample")), pos: inside(F.col(pos))}).drop("sample_count")
    chosen = chosen.join(proven.withColumnRenamed("idx", "chunk_idx"), [*keys, "chunk_idx"]).filter(
        (F.col(pos) >= F.col("start")) & (F.col(pos) < F.col("end"))
    ).drop("start", "end")
    chosen = checkpointed(suppress_near(chosen, protected, tl, tolerance, "snapped"))

    def decide(rows: Arrays, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        close = (rows[pos][j] - rows[pos][i] <= tolerance) | (rows["snapped"][j] == rows["snapped"][i])
        return np.where(close, ABSORB, APPEND)

    kept = fold_states(chosen, tl, max(tolerance, step), decide, ["snapped"], "id")
    pending = checkpointed(chosen.join(kept, [*keys, "id"], "left_semi"))
    used = proven.join(pending.select(*keys, F.col("chunk_idx").alias("idx")).distinct(), [*keys, "idx"], "left_semi")
    removed = interval_join(removable, used, tl, "start", "end", "idx", how="semi").select(*keys, "id")
    result = hits.join(removed, [*keys, "id"], "left_anti").unionByName(
        pending.select(*keys, "id", pos, "snapped", F.lit("vocals").alias("primary_stem"),
                       F.lit(False).alias("edited"), F.lit(False).alias("locked")),
        allowMissingColumns=True,
    )

    def n(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias(name))

    counters = (
        hits.select(*keys).distinct().join(n(pending, "created"), keys, "left").join(n(removed, "removed"), keys, "left")
        .join(n(used, "chunks"), keys, "left").join(n(automatic, "_auto"), keys, "left")
        .na.fill(0, ["created", "removed", "chunks", "_auto"])
        .withColumn("preserved", F.col("_auto") - F.col("removed")).drop("_auto")
    )
    return result, counters
