"""Spacing and tail suppression of merged attacks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.groups import Arrays
from ..core.states import ABSORB, APPEND, REPLACE, TAKE_OVER, fold_states
from ..core.timeline import Timeline

BANDS = ("low", "mid", "high")


def with_valley_curve(candidates: DataFrame, frames: DataFrame, keys: Sequence[str], pos: str, hop: int,
                      reach: int, curve: str) -> DataFrame:
    """Attach the curve of the ``reach`` frames before a candidate's frame, oldest first.

    At most ``reach`` frames per candidate, joined on the frame index; ``suppress_tails``
    needs as many as lie within its tail (``tail // hop + 1``) and raises if there are fewer.
    """
    frame = F.rint(F.col(pos) / hop).cast("bigint")
    placed = candidates.withColumn("_frame", frame)
    spread = placed.select(
        *keys, "id", F.explode(F.sequence(F.col("_frame") - reach, F.col("_frame") - 1)).alias("frame_idx")
    )
    values = spread.join(frames.select(*keys, "frame_idx", F.col(curve).alias("_v")), [*keys, "frame_idx"])
    back = values.groupBy(*keys, "id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "_v"))), lambda r: r["_v"]).alias("back")
    )
    empty = F.array().cast("array<double>")
    joined = placed.join(back, [*keys, "id"], "left").withColumn("back", F.coalesce("back", empty))
    return joined.withColumn("_reach", F.lit(reach).cast("bigint"))


def suppress_tails(
    candidates: DataFrame, tl: Timeline, *, minimum: int, tail: int, config: Mapping[str, float]
) -> DataFrame:
    """Drop echoes: rows too close to a stronger one and weaker, similar tails.

    Rows carry confidence, peak_value, the bands low/mid/high, ``_frame``, the curve
    before them (``back``) and votes.  Votes of a suppressed row go to the row that
    suppressed it.
    """
    strength, similar_at, reset = (
        config["tail_strength_ratio"], config["tail_band_similarity"], config["tail_valley_reset_ratio"]
    )

    def prepare(rows: Arrays) -> Arrays:
        bands = np.array([rows[b].astype(float) for b in BANDS]).T
        # lowest value of the last 1, 2, ... frames before a row; no frame lowers nothing
        valleys = np.full((len(bands), max([1, *map(len, rows["back"])])), np.inf)
        for i, back in enumerate(rows["back"]):
            valleys[i, : len(back)] = np.asarray(back, float)[::-1]
        norms = np.linalg.norm(bands, axis=1)
        return rows | {"bands": bands, "norm": norms, "valleys": np.minimum.accumulate(valleys, axis=1)}

    def decide(rows: Arrays, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        gap = rows[tl.pos][j] - rows[tl.pos][i]
        between = (rows["_frame"][j] - rows["_frame"][i]).astype(np.int64) - 1
        asked = (gap >= minimum) & (gap <= tail) & (between > rows["_reach"][j])
        if asked.any():
            at = int(np.argmax(asked))
            raise ValueError(f"the curve reaches back {rows['_reach'][j][at]} frames, {between[at]} are needed")
        scale = rows["norm"][i] * rows["norm"][j]
        alike = (rows["bands"][i] * rows["bands"][j]).sum(1)
        similar = (scale > 1e-9) & (alike / np.maximum(scale, 1e-300) >= similar_at)
        mine, other = rows["peak_value"][i], rows["peak_value"][j]
        spot = np.clip(between, 1, rows["valleys"].shape[1]) - 1
        apart = (between >= 1) & (rows["valleys"][j, spot] <= np.minimum(mine, other) * reset)
        echo = similar & ~apart
        stronger = rows["confidence"][j] > rows["confidence"][i]
        return np.select(
            [(gap < minimum) & stronger, gap < minimum, gap > tail, echo & (other <= mine * strength), echo & (mine <= other * strength)],
            [REPLACE, ABSORB, APPEND, ABSORB, TAKE_OVER],
            APPEND,
        )

    kept = fold_states(
        candidates, tl, max(minimum, tail), decide, ["confidence", "peak_value", *BANDS, "_frame", "_reach", "back"], "id", "votes",
        prepare=prepare,
    )
    return candidates.drop("votes", "back", "_frame", "_reach").join(kept, [*tl.keys, "id"])
