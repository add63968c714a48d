"""Token counts of lyrics by a compiled tokenizer transducer."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import sliced
from .transducer import Machine

SCHEMA = "n_bytes long, n_tokens long"


@lru_cache(maxsize=1)
def _machine(path: str) -> Machine:
    return Machine(path)


def count_lyric_tokens(tracks: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """Tokens of each track's lyrics, as the byte-level BPE file `tokenizer` gives them.

    tracks: track_id, lyrics_text. Returns track_id, n_bytes (UTF-8), n_tokens and over_limit
    (n_tokens > limit). The file must lie at the same path on every machine. The tokenizer is compiled into two deterministic
    transducers: one marks pre-tokens, its chunk state maps are composed by a prefix scan; the
    other emits token counts per byte. No begin or end token is added; special strings inside a
    text count as one token each.

    Null lyrics count as empty (0 bytes, 0 tokens); rows repeat as they come; an empty table
    gives an empty result; other columns are ignored. One pass, no shuffle; a worker remembers
    a bounded number of pre-tokens and transitions, and walks long texts piece by piece.
    """

    def count(batches):
        machine = _machine(tokenizer)
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(machine.counts(texts), pa.int64()),
                ],
                ["track_id", "n_bytes", "n_tokens"],
            )

    rows = tracks.select("track_id", F.coalesce("lyrics_text", F.lit("")).alias("lyrics_text"))
    kind = rows.schema["track_id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"track_id {kind}, {SCHEMA}")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
