"""Contiguous shards of equal byte size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import before, in_cells


def shard_of(total: int, shards: int) -> Column:
    """The part, from 0, in which the middle byte of a row (columns start, size) lies.

    An integer division: a decimal quotient is rounded before its floor is taken.
    """
    return F.expr(f"int((2 * cast(start AS decimal(30,0)) + size) * {shards} div {2 * total})")


def shard_tracks(tracks: DataFrame, shards: int) -> DataFrame:
    """Puts every track into one of `shards` contiguous ranges of track_id of near equal size.

    tracks: track_id, lyrics_text. Size: UTF-8 bytes of the lyrics plus 1. Byte-size prefix sums
    come from the totals of contiguous ranges; shard k takes the tracks whose middle byte lies in
    the k-th of `shards` equal parts, so a shard is off by at most one track's size. Returns
    track_id, size, text_crc32, law ("bytes"), shard, slot (rank in the shard, from 0) and
    grown_shard (null: sizes decide here, not the number of shards).

    Null lyrics have size 1 and the checksum of the empty text. Tracks with the same id are
    ordered by checksum and size, equal rows by their place in the table, so a row that is repeated however often is cut
    into cells like any range; a null id comes first. Very long texts have the size they have: a shard may then be
    off by that much. An empty table gives an empty result; other columns are ignored. Built-in functions only; texts are read
    once and not shuffled.
    """
    text = F.coalesce("lyrics_text", F.lit(""))
    sized = tracks.select(
        "track_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit(1).cast("long").alias("row"),
        F.monotonically_increasing_id().alias("place"),  # fixed by the table that in_cells writes
    )
    order = ["track_id", "text_crc32", "size", "place"]
    cells = in_cells(sized, *order)
    placed = before(cells, order, {"start": "size", "rank": "row"})
    total = cells.agg(F.sum("size")).first()[0] or 1
    sharded = placed.withColumn("shard", shard_of(total, shards))
    # at most `shards` rows
    firsts = sharded.groupBy("shard").agg(F.min("rank").alias("first"))
    return sharded.join(F.broadcast(firsts), "shard").select(
        "track_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
