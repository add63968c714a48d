"""Mixing genres to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefix import before, in_cells
from .store import written


def genre_targets(sizes: DataFrame, weights: list[float], passes: int) -> DataFrame:
    """Target words per genre. sizes: genre, source_size (one row per genre).

    Genres in code-point order, null last, get the weights in turn. All words are shared by
    weight; no target exceeds `passes` times its genre's size, and what is above goes to the
    others by weight until none is above. In order of capacity per weight that is one pass:
    a genre is full if the level left for it and all after it reaches its capacity per weight.
    """
    ordered = Window.orderBy(F.col("genre").isNull(), "genre")
    turn = F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights)))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (turn + 1).cast("int")))
    ranked = ranked.withColumn("capacity", F.col("source_size") * float(passes))
    by_fill = Window.orderBy(F.col("capacity") / F.col("weight"), F.col("genre").isNull(), "genre")
    earlier = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    later = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("capacity").over(earlier), F.lit(0.0))) / F.sum(
        "weight"
    ).over(later)
    levelled = ranked.withColumn("level", level).withColumn(
        "full", F.col("level") * F.col("weight") >= F.col("capacity")
    )
    # from the first genre that is not full on, the level stays
    open_level = F.min(F.when(~F.col("full"), F.struct(F.col("capacity") / F.col("weight"), "level"))).over(everything)
    target = F.when(F.col("full"), F.col("capacity")).otherwise(open_level["level"] * F.col("weight"))
    return levelled.select("genre", "source_size", target.alias("target"))


def mix_genres(tracks: DataFrame, weights: list[float], passes: int = 3, whole: bool = False) -> DataFrame:
    """Stream of tracks in which each genre's words come near its weighted target.

    tracks: track_id, genre, lyrics_text. Size of a track: its words, runs of characters other
    than ASCII white space. Each genre is a queue of its tracks in shuffled order, repeated up to
    `passes` times; a track's virtual finish time is the genre's cumulative words over its
    target. A queue closes at its target: the copy that reaches it is cut there or, with `whole`,
    taken whole if at least half of it fits. All queues are merged by finish time and the stream
    ends where the sum of all sizes is reached. Returns one row per track: track_id, genre, size,
    source_size, target (both of its genre), taken (words the mix takes over all copies), finish
    (of its first copy; null where the genre has no words).

    Null lyrics have size 0, and tracks without words take nothing; a null genre is a genre.
    Rows with the same id and size are interchangeable. An empty table gives an
    empty result; other columns are ignored. Built-in functions only; the order depends on
    hashes of track_id alone, so runs agree. Texts are not shuffled, and a large genre is cut
    into cells like any range.
    """
    words = F.regexp_count(F.coalesce("lyrics_text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    sized = tracks.select(
        "track_id",
        "genre",
        words.cast("long").alias("size"),
        F.xxhash64(F.col("track_id").cast("string"), F.lit("mix")).alias("shuffle"),
        F.monotonically_increasing_id().alias("row"),  # fixed by the table that in_cells writes
    )
    order = ["shuffle", "track_id", "size", "row"]
    cells = in_cells(sized, "genre", *order)
    sizes = cells.groupBy("genre").agg(F.sum("size").alias("source_size"))
    targets = genre_targets(sizes, weights, passes).withColumnRenamed("genre", "_genre")
    queued = written(
        before(cells, order, {"start": "size"}, within=("genre",))
        .join(targets, F.col("genre").eqNullSafe(F.col("_genre")), "inner")
        .withColumn("finish", (F.col("start") + F.col("size")) / F.nullif("target", F.lit(0.0)))
        .drop("_genre")
    )
    budget = queued.agg(F.sum("size")).first()[0] or 0
    copies = queued.filter("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    waited = F.col("copy") * F.col("source_size") + F.col("start")
    ended = waited + F.col("size")
    if whole:
        offered = F.when(2 * (F.col("target") - waited) >= F.col("size"), F.col("size")).otherwise(0)
    else:  # the queue's words before the target, up to the copy's end less those up to its start
        offered = (F.least(ended, F.floor("target")) - F.least(waited, F.floor("target"))).cast("long")
    stream = copies.select(
        (ended / F.col("target")).alias("virtual_finish"), "genre", "copy", *order, offered.alias("offered")
    ).filter("offered > 0")
    by_finish = ["virtual_finish", "genre", "copy", *order]
    sent = before(in_cells(stream, *by_finish), by_finish, {"sent": "offered"})
    room = F.col("offered") if whole else F.least("offered", F.lit(budget) - F.col("sent"))
    taken = sent.filter(F.col("sent") < F.lit(budget)).groupBy("row").agg(F.sum(room).alias("taken"))
    return queued.join(taken, "row", "left").select(
        "track_id", "genre", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "finish"
    )
