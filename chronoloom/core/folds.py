"""State on entry to every slice of a key, without a task that sees the whole key.

Each slice has been condensed to a small table "state that enters -> state that leaves".
Such tables compose: those of ``FAN_IN`` neighbouring slices become one, and again, until
no key has more than ``FAN_IN`` of them.  These are followed from the start of the key, and
each block hands its own entry down to its parts, level by level.  Where every key has few
slices to begin with, they are followed at once: how many levels there are is read from the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import checkpointed
from .groups import Arrays, map_groups, stacked
from .timeline import SLICE, floor_div

FAN_IN = 1024
BLOCK = "_block"


def levels_of(tables: DataFrame, keys: Sequence[str]) -> int:
    """How often tables must be composed until no key has more than ``FAN_IN`` of them."""
    spans = tables.groupBy(*keys).agg(F.count("*").alias("n"), (F.max(SLICE) - F.min(SLICE)).alias("span"))
    steps = range(math.ceil(63 / math.log2(FAN_IN)))
    # after so many steps the slices of a key lie in at most this many blocks
    blocks = [F.max(F.least("n", F.expr(f"span div {FAN_IN**k}L + 2"))) for k in steps]
    most = spans.agg(*blocks).first()
    return next(k for k in steps if (most[k] or 0) <= FAN_IN)


def entry_states(
    tables: DataFrame,
    keys: Sequence[str],
    compose: Callable[[Arrays], dict],
    table_columns: str,
    follow: Callable[[Arrays, dict | None], dict],
    entry_columns: str,
) -> DataFrame:
    """keys, slice and ``entry_columns`` for every row of ``tables``.

    ``compose`` makes one table of the ordered tables of a block; ``follow`` walks ordered
    tables from an entry (None at the start of a key) and returns slice and entry of each.
    Neither ever gets more than ``FAN_IN`` tables.
    """
    keys = list(keys)
    ddl = f"{SLICE} bigint, {entry_columns}"
    level = checkpointed(tables)
    parts = []
    for _ in range(levels_of(level, keys)):
        parts.append(level.withColumn(BLOCK, floor_div(F.col(SLICE), FAN_IN)))
        blocks = map_groups(parts[-1], [*keys, BLOCK], [SLICE], compose, table_columns)
        level = checkpointed(blocks.withColumnRenamed(BLOCK, SLICE))
    entries = map_groups(level, keys, [SLICE], lambda g: follow(g, None), ddl)
    names = [c for c in entries.columns if c not in (*keys, SLICE)]

    def down(g):
        # the entry of the block comes first
        return follow({c: v[1:] for c, v in g.items()}, {c: g[c][0] for c in names})

    for part in reversed(parts):
        heads = entries.withColumnRenamed(SLICE, BLOCK)
        rows = stacked(part.withColumn("_kind", F.lit(1)), heads.withColumn("_kind", F.lit(0)))
        entries = map_groups(rows, [*keys, BLOCK], ["_kind", SLICE], down, ddl).drop(BLOCK)
    return entries
