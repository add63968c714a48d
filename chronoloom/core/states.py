"""Ordered folds with a row as state and a pairwise rule, exact across slices.

Like ``chains`` but for rules on several attributes: the state is the last kept
row, and a later row is absorbed by it, replaces it, or is appended after it.
Only rows within ``window`` of the state can be absorbed or replace it, so a slice
is condensed to its first window of rows with the state each of them leads to.
Rows are columns of arrays and states are indices into them; the rule is asked for
many pairs at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import checkpointed
from .folds import entry_states
from .groups import WHOLE, Arrays, map_groups, stacked
from .timeline import SLICE, Timeline

ABSORB, REPLACE, TAKE_OVER, APPEND = 0, 1, 2, 3
"""Outcomes: absorbed (tags go to the state); replaces it without its tags;
replaces it and takes its tags over; appended as the next state."""

Rule = Callable[[Arrays, np.ndarray, np.ndarray], np.ndarray]
AT_ONCE = 512
"""States whose next row is searched at once."""


def column_of(values: Sequence) -> np.ndarray:
    """A column of arrays, which numpy would otherwise stack."""
    out = np.empty(len(values), object)
    for i, v in enumerate(values):
        out[i] = v
    return out


class Pairs:
    """Outcomes of pairs of rows (state, later row), both given as indices into columns."""

    def __init__(self, rows: Arrays, pos: str, window: int, decide: Rule, prepare: Callable[[Arrays], Arrays] | None):
        self.rows = prepare(rows) if prepare else rows
        self.at = rows[pos].astype(np.int64)
        self.window, self.decide = window, decide

    def outcomes(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        found = np.full(len(i), APPEND, np.int8)
        close = np.flatnonzero(self.at[j] - self.at[i] <= self.window)
        if len(close):
            found[close] = self.decide(self.rows, i[close], j[close])
        return found

    def changes(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each state the next row that is not absorbed (none: the number of rows) and its outcome."""
        n = len(self.at)
        j, what = i + 1, np.full(len(i), APPEND, np.int8)
        open_ = np.flatnonzero(j < n)
        while len(open_):
            what[open_] = self.outcomes(i[open_], j[open_])
            open_ = open_[what[open_] == ABSORB]
            j[open_] += 1
            open_ = open_[j[open_] < n]
        return j, what

    def paths(self, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Next rows and outcomes of the first ``wanted`` rows and of all that these lead to; which those are."""
        n = len(self.at)
        after, what = np.full(n, n), np.full(n, APPEND, np.int8)
        need, done = np.arange(n) < wanted, np.zeros(n, bool)
        while len(todo := np.flatnonzero(need & ~done)):
            batch = todo[:AT_ONCE]
            if len(batch) < 64:  # a lone chain: the rows behind it are likely to be next
                ahead = np.arange(batch[-1] + 1, min(n, batch[-1] + 64))
                batch = np.append(batch, ahead[~done[ahead]])
            after[batch], what[batch] = self.changes(batch)
            done[batch] = True
            reached = after[batch[need[batch]]]
            # a row of the batch that is only now known to be needed passes it on
            while len(reached := reached[reached < n]):
                fresh = np.unique(reached[~need[reached]])
                need[fresh] = True
                reached = after[fresh[done[fresh]]]
        return after, what, need


class Marks:
    """Tags of rows as a matrix over the tags of a group."""

    def __init__(self, *lists: Sequence):
        names = sorted({t for tags in lists for row in tags for t in row})
        self.names = np.array(names, object)
        self.spot = {t: i for i, t in enumerate(names)}

    def matrix(self, tags: Sequence) -> np.ndarray:
        out = np.zeros((len(tags), len(self.names)), bool)
        for i, row in enumerate(tags):
            for t in row:
                out[i, self.spot[t]] = True
        return out

    def lists(self, matrix: np.ndarray) -> list[list[str]]:
        return [self.names[row].tolist() for row in matrix]


def fold_states(
    df: DataFrame,
    tl: Timeline,
    window: int,
    decide: Rule,
    attributes: Sequence[str],
    row_id: str,
    tags: str | None = None,
    width: int | None = None,
    prepare: Callable[[Arrays], Arrays] | None = None,
) -> DataFrame:
    """Kept rows of every key: keys, ``row_id`` and, if asked, the united ``tags``.

    ``decide(rows, i, j)`` gives the outcomes of states ``i`` and rows ``j``, both arrays of indices into the
    columns ``rows`` (the attributes, position and id); ``prepare`` may add columns once per group.
    ``tags`` is an array column over a small vocabulary.
    """
    keys, pos = list(tl.keys), tl.pos
    line = Timeline(keys, pos, tl.tie, width or max(1, window) * 16)
    columns = list(dict.fromkeys([*attributes, pos, row_id]))
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = checkpointed(
        df.select(*keys, *[F.col(c) for c in columns if c not in keys], *[t for t in tl.tie if t not in columns],
                  *([tags] if tags and tags not in columns else [])).withColumn(SLICE, line.slice_of())
    )

    def pairs(own: Arrays) -> Pairs:
        return Pairs(own, pos, window, decide, prepare)

    def listed(values, c) -> np.ndarray:
        """One column of a table: an array of numbers, or of arrays."""
        return column_of(values) if types[c].startswith("array") else np.asarray(values)

    def taken(g, start=0):
        own = {c: g[c][start:] for c in columns}
        return own, (g[tags][start:] if tags else [()] * len(own[pos]))

    def transfer(g):
        own, held = taken(g)
        known, at = pairs(own), own[pos].astype(np.int64)
        n = len(at)
        zone = min(n, int(np.searchsorted(at, at[0] + window, side="right")) + 1)
        after, what, need = known.paths(zone)
        marks = Marks(held)
        sums = np.vstack([np.zeros((1, len(marks.names)), np.int64), np.cumsum(marks.matrix(held), axis=0)])
        gathered = sums[after] > sums[:-1]  # tags from a row up to its next
        end, linked = np.arange(n), np.ones(n, bool)
        for i in np.flatnonzero(need)[::-1].tolist():
            j = int(after[i])
            if j == n:
                continue
            end[i], linked[i] = end[j], what[i] == TAKE_OVER and linked[j]
            gathered[i] = gathered[j] | gathered[i] if linked[i] else gathered[j]
        out = {f"_e_{c}": [list(own[c][:zone])] for c in columns}
        out |= {f"_x_{c}": [list(own[c][end[:zone]])] for c in columns}
        out["_e_tags"] = [[sorted(set(t)) for t in held[:zone]]]
        out["_x_tags"] = [marks.lists(gathered[:zone])]
        out["_x_linked"] = [linked[:zone].tolist()]
        return out

    def passed(g, s, states: Arrays, held: np.ndarray, linked: np.ndarray, marks: Marks):
        """States (columns), their tags and whether the entering tags are among them, after table ``s``."""
        entry = {c: listed(g[f"_e_{c}"][s], c) for c in columns}
        exits = {c: listed(g[f"_x_{c}"][s], c) for c in columns}
        e_tags, x_tags = marks.matrix(g["_e_tags"][s]), marks.matrix(g["_x_tags"][s])
        x_linked = np.asarray(g["_x_linked"][s], bool)
        m = len(linked)
        known = pairs({c: np.concatenate([states[c], entry[c]]) for c in columns})
        to = np.full(m, -1)
        held, linked = held.copy(), linked.copy()
        open_ = np.arange(m)
        for i in range(len(x_linked)):
            what = known.outcomes(open_, np.full(len(open_), m + i))
            held[open_[what == ABSORB]] |= e_tags[i]
            gone = open_[what != ABSORB]
            keeps = (what[what != ABSORB] == TAKE_OVER) & x_linked[i]
            held[gone] = x_tags[i] | (held[gone] & keeps[:, None])
            linked[gone] &= keeps
            to[gone] = i
            open_ = open_[what == ABSORB]
            if not len(open_):
                break
        moved = to >= 0
        out = {c: states[c].copy() for c in columns}
        for c in columns:
            out[c][moved] = exits[c][to[moved]]
        return out, held, linked

    def compose(g):
        marks = Marks(*g["_e_tags"], *g["_x_tags"])
        entry = {c: list(g[f"_e_{c}"][0]) for c in columns}
        entry_tags = list(g["_e_tags"][0])
        states = {c: listed(g[f"_x_{c}"][0], c) for c in columns}
        held, linked = marks.matrix(g["_x_tags"][0]), np.asarray(g["_x_linked"][0], bool)
        horizon = entry[pos][0] + window
        for s in range(1, len(g[SLICE])):
            states, held, linked = passed(g, s, states, held, linked, marks)
            if entry[pos][-1] <= horizon:
                # a state may still be in reach of rows behind those so far
                after = np.asarray(g[f"_e_{pos}"][s])
                n = min(len(after), int(np.searchsorted(after, horizon, side="right")) + 1)
                for c in columns:
                    entry[c] += list(g[f"_e_{c}"][s][:n])
                    states[c] = np.concatenate([states[c], listed(g[f"_x_{c}"][s][:n], c)])
                entry_tags += list(g["_e_tags"][s][:n])
                held = np.vstack([held, marks.matrix(g["_x_tags"][s][:n])])
                linked = np.append(linked, np.asarray(g["_x_linked"][s][:n], bool))
        out = {f"_e_{c}": [entry[c]] for c in columns} | {f"_x_{c}": [list(states[c])] for c in columns}
        return out | {"_e_tags": [entry_tags], "_x_tags": [marks.lists(held)], "_x_linked": [linked.tolist()]}

    def follow(g, enter):
        n = len(g[SLICE])
        has = enter is not None and bool(enter["_has"])
        marks = Marks(*g["_e_tags"], *g["_x_tags"], [enter["_tags"]] if has else [])
        states = {c: listed([enter[f"_s_{c}"]], c) for c in columns} if has else None
        held = marks.matrix([enter["_tags"]]) if has else None
        # the last slice of a key gives its state away; no block but the last one may
        closes = enter is None or bool(enter["_last"])
        seen: dict[str, list] = {c: [] for c in columns}
        known, enter_tags = [], []
        for s in range(n):
            known.append(states is not None)
            enter_tags.append(marks.lists(held)[0] if states else [])
            for c in columns:
                blank = 0 if types[c] in WHOLE else None
                seen[c].append(states[c][0] if states else blank)
            if states:
                states, held, _ = passed(g, s, states, held, np.ones(1, bool), marks)
            else:  # the first row of a key begins
                states = {c: listed(g[f"_x_{c}"][s][:1], c) for c in columns}
                held = marks.matrix(g["_x_tags"][s][:1])
        out = {SLICE: g[SLICE], "_has": known, "_tags": enter_tags, "_last": [closes and s == n - 1 for s in range(n)]}
        return out | {f"_s_{c}": seen[c] for c in columns}

    def walk(g):
        own, held = taken(g, 1)
        has = bool(g["_has"][0])
        if has:  # the state that enters comes first
            own = {c: np.concatenate([listed([g[f"_s_{c}"][0]], c), own[c]]) for c in columns}
            held = [g["_tags"][0], *held]
        n = len(own[pos])
        if not n:
            return None
        after, what, _ = pairs(own).paths(1)
        ids, united = [], []
        at, before = 0, set()
        while at < n:
            until = int(after[at])
            before = before.union(*held[at:until]) if tags else before
            if until < n and what[at] != APPEND:
                before = before if what[at] == TAKE_OVER else set()
            elif until < n or bool(g["_last"][0]):
                ids.append(own[row_id][at])
                united.append(sorted(before))
                before = set()
            at = until
        return {row_id: ids, "_kept_tags": united} if ids else None

    def arrays(prefix):
        return ", ".join(f"{prefix}{c} array<{types[c]}>" for c in columns)

    ddl = f"{arrays('_e_')}, {arrays('_x_')}, _e_tags array<array<string>>, _x_tags array<array<string>>, _x_linked array<boolean>"
    tables = map_groups(rows, line.home(), [pos, *tl.tie], transfer, ddl)
    states = ", ".join(f"_s_{c} {types[c]}" for c in columns)
    entries = entry_states(tables, keys, compose, ddl, follow, f"_has boolean, _tags array<string>, _last boolean, {states}")
    both = stacked(rows.withColumn("_kind", F.lit(1)), entries.withColumn("_kind", F.lit(0)))
    out = map_groups(
        both, line.home(), ["_kind", pos, *tl.tie], walk, f"`{row_id}` {types[row_id]}, _kept_tags array<string>"
    )
    return out.select(*keys, row_id, *([F.col("_kept_tags").alias(tags)] if tags else []))
