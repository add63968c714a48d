"""Fingerprints of lyrics and of their edited form."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import sliced
from .sketches import Sketch

SCHEMA = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, n_shingles double, "
    "near_edited double, near_next double, kept_share double"
)


NAMES = ["track_id", *(part.split()[0] for part in SCHEMA.split(", "))]
KINDS = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[p.split()[1]] for p in SCHEMA.split(", ")]


def edited(text: str, following: str) -> str:
    """text with its last third replaced by the beginning of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


LOWEST = -(1 << 63)  # place of a null id
SEEN = 100_000  # rows whose copies a task remembers


def _tops(places: DataFrame, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """place and hash of the highest row of each of about `ranges` contiguous ranges, in ascending order."""
    dealt = places.distinct().repartitionByRange(ranges, "place", "hash")
    highest = dealt.groupBy(F.spark_partition_id()).agg(F.max(F.struct("place", "hash")).alias("top"))
    tops = sorted((r["top"]["place"], r["top"]["hash"]) for r in highest.collect())  # one row per range
    return tuple(np.array([t[i] for t in tops], np.int64) for i in (0, 1))


def range_of(place: np.ndarray, hashed: np.ndarray, tops: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first range whose highest row is not below each row."""
    first, last = (np.searchsorted(tops[0], place, side) for side in ("left", "right"))
    at = first.copy()
    for i in np.flatnonzero(last > first).tolist():  # ranges that share their highest place
        at[i] += np.searchsorted(tops[1][first[i] : last[i]], hashed[i], "left")
    return at


COPIES = "part int, extra boolean, place long, hash long, copies long"


def _dealt(tops: tuple[np.ndarray, np.ndarray]):
    """Rows with their range, counted downwards. Of equal rows a task hands on one, and how many more there are."""
    last = len(tops[0]) - 1

    def deal(batches):
        seen: dict[tuple, int] = {}
        kinds = None

        def rest() -> pa.RecordBatch:
            keys = [key for key, n in seen.items() if n]
            place, hashed, track = ([k[i] for k in keys] for i in range(3))
            part = last - range_of(np.array(place, np.int64), np.array(hashed, np.int64), tops)
            values = [part, [False] * len(keys), place, hashed, [seen[k] for k in keys], track, [None] * len(keys)]
            columns = [pa.array(v, t) for v, t in zip(values, [pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), *kinds])]
            return pa.RecordBatch.from_arrays(columns, ["part", "extra", "place", "hash", "copies", "track_id", "lyrics_text"])

        for batch in sliced(batches):
            kinds = [batch.column("track_id").type, batch.column("lyrics_text").type]
            place, hashed = (batch.column(c).to_numpy() for c in ("place", "hash"))
            fresh = []
            for i, key in enumerate(zip(place.tolist(), hashed.tolist(), batch.column("track_id").to_pylist())):
                if key in seen:
                    seen[key] += 1
                else:
                    seen[key] = 0
                    fresh.append(i)
            own = batch.take(pa.array(fresh, pa.int64()))
            place, hashed = place[fresh], hashed[fresh]
            part = pa.array((last - range_of(place, hashed, tops)).astype(np.int32))
            ones = pa.array(np.ones(len(fresh), np.int64))
            flags = pa.array(np.zeros(len(fresh), bool))
            columns = [part, flags, pa.array(place), pa.array(hashed), ones, own.column("track_id"), own.column("lyrics_text")]
            yield pa.RecordBatch.from_arrays(columns, ["part", "extra", "place", "hash", "copies", "track_id", "lyrics_text"])
            if len(seen) > SEEN:
                yield rest()
                seen.clear()
        if kinds:
            yield rest()

    return deal


AT_ONCE = 5_000  # result rows of one track that are made at a time


def _compare(k: int, width: int):
    """Walks ranges in order; each track is compared with the row after it, and its copies with itself."""

    def compare(batches):
        held = None  # part, extra, key, text, sketch, copies
        kind = pa.null()

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[] for _ in NAMES]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *KINDS])], NAMES)

        for batch in sliced(batches):
            kind = batch.column("track_id").type
            out: list[tuple] = []
            for part, extra, place, hashed, copies, track, text in zip(*(c.to_pylist() for c in batch.columns)):
                key = place, hashed, track
                if held is not None and held[0] == part and held[2] == key and held[1] == extra:
                    held[5] += copies
                    continue
                here = [part, extra, key, text, Sketch.of(text, k, width), copies]
                if held is not None and held[0] == part and not held[1]:
                    if held[5] > 1:
                        same = _row(held, held, k, width)
                        for at in range(0, held[5] - 1, AT_ONCE):
                            yield made([same] * min(AT_ONCE, held[5] - 1 - at))
                    out.append(_row(held, here, k, width))
                held = here
            yield made(out)

    return compare


def _row(track: list, following: list, k: int, width: int) -> tuple:
    text = edited(track[3], following[3])
    own, other = track[4], Sketch.of(text, k, width)
    return (
        track[2][2],
        len(track[3]),
        hashlib.sha256(text.encode()).hexdigest(),
        own.text(),
        other.text(),
        own.distinct(),
        own.resemblance(other),
        own.resemblance(following[4]),
        own.containment(other),
    )


def fingerprint_lyrics(tracks: DataFrame, k: int = 128, width: int = 8, ranges_per_task: int = 8) -> DataFrame:
    """Bottom-k sketches of each track's lyrics and of an edited form that runs into the next track.

    tracks: track_id (a number), lyrics_text. Shingles are runs of `width` code points; a sketch
    holds the k smallest distinct 32-bit hashes, merges across parts and gives resemblance,
    containment and the number of distinct shingles. The next track is the one with the next
    lower id, after the lowest the highest; the edited text replaces the last third of the code
    points by as many of the next track's first. Returns track_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint (hexadecimal hashes), n_shingles, near_edited, near_next
    (resemblance), kept_share (containment of the text in its edited form).

    Null lyrics count as empty: an empty fingerprint; two empty texts have likeness 1. Equal ids
    follow each other by a hash of the text, equal rows each other; a null id comes after all others. A single track
    follows itself. An empty table gives an empty result; other columns are ignored. Texts of any length are taken whole.

    Tracks are dealt out once, in ranges of (id, text hash), `ranges_per_task` for each task, so an id on many rows is
    many ranges; each range ends with the first track of the next one. Of equal rows a task sends the text once and the number
    of the others. Ranges are streamed in order.
    """
    rows = tracks.select(
        "track_id",
        F.coalesce("lyrics_text", F.lit("")).alias("lyrics_text"),
        F.coalesce(F.col("track_id").cast("long"), F.lit(LOWEST)).alias("place"),
    ).withColumn("hash", F.xxhash64("lyrics_text"))
    spark = tracks.sparkSession
    kind = rows.schema["track_id"].dataType.simpleString()
    tops = _tops(rows.select("place", "hash"), ranges_per_task * int(spark.conf.get("spark.sql.shuffle.partitions")))
    last = len(tops[0]) - 1
    # the highest row of a range, once, also ends the range above; that of all ends the lowest
    named = spark.createDataFrame(
        [(i, p, h) for i, (p, h) in enumerate(zip(*(t.tolist() for t in tops)))], "range int, _place long, _hash long"
    )
    part = F.when(F.col("range") == last, last).otherwise(last - 1 - F.col("range")).cast("int")
    extra = (
        rows.join(F.broadcast(named), (F.col("place") == F.col("_place")) & (F.col("hash") == F.col("_hash")))  # a row per range
        .groupBy("range", "place", "hash").agg(F.min(F.struct("track_id", "lyrics_text")).alias("row"))
        .select(
            part.alias("part"), F.lit(True).alias("extra"), "place", "hash", F.lit(1).cast("long").alias("copies"),
            "row.track_id", "row.lyrics_text",
        )
    )
    dealt = rows.mapInArrow(_dealt(tops), f"{COPIES}, track_id {kind}, lyrics_text string").unionByName(extra)
    ordered = dealt.repartition("part").sortWithinPartitions(
        "part", "extra", F.desc("place"), F.desc("hash"), "track_id", F.asc_nulls_last("lyrics_text")
    )
    return ordered.mapInArrow(_compare(k, width), f"track_id {kind}, {SCHEMA}")
