"""Short sequence functions over many small groups, in Arrow batches.

``groupBy().applyInPandas`` builds one pandas frame per group, which costs
milliseconds; slices are many and small.  Here Spark shuffles and sorts the rows
and one pass over the partition hands numpy views of every group to the function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Arrays = dict[str, np.ndarray]


def map_groups(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    fn: Callable[[Arrays], dict | None],
    columns: str,
) -> DataFrame:
    """Apply ``fn`` to every group, rows in ``order``.

    ``fn`` gets one numpy array per column and returns equally long lists or
    arrays for ``columns`` (DDL without the group columns), or None for no rows.
    A group is held in memory as a whole, so ``group`` must bound its size.
    """
    group = list(group)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    ddl = ", ".join(f"`{g}` {types[g]}" for g in group) + ", " + columns
    names = [part.strip().split()[0].strip("`") for part in _split_ddl(columns)]

    def finish(pieces: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pieces[0] if len(pieces) == 1 else pd.concat(pieces, ignore_index=True)
        arrays = {c: pdf[c].to_numpy() for c in pdf.columns}
        starts = np.flatnonzero(_changes(arrays, group, len(pdf)))
        ends = np.append(starts[1:], len(pdf))
        outs: dict[str, list] = {c: [] for c in [*group, *names]}
        for a, b in zip(starts, ends, strict=True):
            result = fn({c: v[a:b] for c, v in arrays.items()})
            if result is None:
                continue
            size = len(result[names[0]])
            for g in group:
                outs[g].append(np.repeat(arrays[g][a : a + 1], size))
            for c in names:
                outs[c].append(result[c])
        # an empty frame has no usable column types
        if any(len(part) for part in outs[names[0]]):
            yield pd.DataFrame({c: _joined(parts) for c, parts in outs.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pending: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            arrays = {c: pdf[c].to_numpy() for c in group}
            last = int(np.flatnonzero(_changes(arrays, group, len(pdf)))[-1])
            if pending:
                ends = [(pending[-1][g].iloc[-1], pdf[g].iloc[0]) for g in group]
                same = all(a == b or (pd.isna(a) and pd.isna(b)) for a, b in ends)
                if last == 0 and same:
                    pending.append(pdf)
                    continue
                if last == 0:
                    yield from finish(pending)
                    pending = [pdf]
                    continue
            elif last == 0:
                pending = [pdf]
                continue
            yield from finish([*pending, pdf.iloc[:last]])
            pending = [pdf.iloc[last:]]
        if pending:
            yield from finish(pending)

    # Python work is worth all slots: keep the configured partition count
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *group).sortWithinPartitions(*group, *order).mapInPandas(run, ddl)


WHOLE = ("tinyint", "smallint", "int", "bigint")


def stacked(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Union for ``map_groups``; integers that one side lacks are 0, not null.

    A null turns an integer column of a batch into doubles, which would round ids
    above 2**53.
    """

    def filled(df: DataFrame, like: DataFrame) -> DataFrame:
        have = set(df.columns)
        missing = {
            f.name: F.lit(0).cast(f.dataType) for f in like.schema.fields
            if f.name not in have and f.dataType.simpleString() in WHOLE
        }
        return df.withColumns(missing) if missing else df

    return filled(rows, others).unionByName(filled(others, rows), allowMissingColumns=True)


def _changes(arrays: Arrays, group: Sequence[str], n: int) -> np.ndarray:
    changed = np.zeros(n, dtype=bool)
    changed[0] = True
    for g in group:
        values = arrays[g]
        empty = pd.isna(values)  # a null key is one group
        changed[1:] |= (values[1:] != values[:-1]) & ~(empty[1:] & empty[:-1])
    return changed


def _joined(parts: list):
    if not parts:
        return []
    if all(isinstance(p, np.ndarray) for p in parts):
        return np.concatenate(parts)
    return [x for p in parts for x in p]


def _split_ddl(ddl: str) -> list[str]:
    parts, depth, current = [], 0, ""
    for char in ddl:
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += char
    return [*parts, current]
