"""Ranked search for lyric lines in all lyrics: hashed max-sketches bound scores, exact rescoring decides."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import sliced
from .store import written

#: Bytes of a text to bytes of its terms: A-Z in lower case, ASCII that is no letter or digit as a blank.
FOLD = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))
PIECE = 1 << 20  # bytes of a text whose terms are held at a time
ROWS = 1_000  # tracks whose bounds are computed at a time
STEP = 64  # tracks rescored before the threshold is looked at again


def term_counts(text: str) -> Counter:
    """Occurrences of each term (as UTF-8) of a text."""
    folded = text.encode().translate(FOLD)
    counts: Counter = Counter()
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        counts.update(folded[at:end].split())
        at = end
    return counts


def slot_of(term: bytes, width: int) -> int:
    return zlib.crc32(term) % width


def sketched(tracks: DataFrame, vocabulary: dict[bytes, int], width: int) -> DataFrame:
    """track_id, n (terms), the max-sketch (slots, peaks) and the lines' terms in it (found, times).

    A term's impact grows with its count in a track, whatever the corpus; so the largest impact of a slot's terms is
    that of the largest count, and the sketch keeps counts: `peaks` are maxima over the terms of each of `slots`.
    """

    def sketch(batches):
        for batch in sliced(batches):
            totals, parts = [], []
            for text in batch.column(1).to_pylist():
                counts = term_counts(text)
                times = np.fromiter(counts.values(), np.int64, len(counts))
                peaks = np.zeros(width, np.int64)
                np.maximum.at(peaks, np.fromiter((zlib.crc32(t) % width for t in counts), np.int64, len(counts)), times)
                ids = np.fromiter((vocabulary.get(t, -1) for t in counts), np.int64, len(counts))
                order = np.argsort(ids)
                order = order[np.searchsorted(ids[order], 0) :]
                slots = np.flatnonzero(peaks)
                totals.append(counts.total())
                parts.append((slots, peaks[slots], ids[order], times[order]))
            lists = [_lists([p[i] for p in parts]) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64()), *lists],
                ["track_id", "n", "slots", "peaks", "found", "times"],
            )

    rows = tracks.select("track_id", F.coalesce("lyrics_text", F.lit("")).alias("lyrics_text"))
    kind = rows.schema["track_id"].dataType.simpleString()
    lists = ", ".join(f"{name} array<long>" for name in ("slots", "peaks", "found", "times"))
    return rows.mapInArrow(sketch, f"track_id {kind}, n long, {lists}")


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def impacts(times: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """What a term that occurs so often adds per unit of its weight, in a track of such a norm."""
    return (1_000_000_000 * times) // (1_000 * times + 20 * norms)


def norms(n: np.ndarray, tracks: int, terms: int) -> np.ndarray:
    """100 for a track of average length: half fixed, half in proportion."""
    return np.array([50 + 50 * x * tracks // terms for x in n.tolist()], np.int64)


class Best:
    """The k best (score, id) seen: high scores first, then small ids, null ids last."""

    def __init__(self, k: int):
        self.k, self.rows, self.threshold = k, [], 1

    def add(self, scores: list[int], ids: list) -> None:
        self.rows += zip(scores, ids)
        if len(self.rows) >= 4 * self.k:
            self.cut()

    def cut(self) -> list[tuple]:
        self.rows = sorted(self.rows, key=lambda r: (-r[0], r[1] is None, r[1]))[: self.k]
        if len(self.rows) == self.k:
            self.threshold = max(self.threshold, self.rows[-1][0])
        return self.rows


def rescored(batch: pa.RecordBatch, lines: list[tuple], best: list[Best], tracks: int, terms: int, width: int) -> None:
    """Adds the tracks of a batch to the best of each line, by descending bound, until the bound is below the threshold."""
    n = batch.num_rows
    m = norms(batch.column("n").to_numpy(), tracks, terms)
    ids = batch.column("track_id")

    def flat(name: str) -> tuple[np.ndarray, np.ndarray]:
        lists = batch.column(name)
        rows = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
        return rows, lists.flatten().to_numpy()

    rows, slots = flat("slots")
    peaks = np.zeros((width, n), np.int64)
    peaks[slots, rows] = impacts(flat("peaks")[1], m[rows])
    rows, found = flat("found")
    place = 1 + int(found.max(initial=0))
    keys = np.append(rows * place + found, np.iinfo(np.int64).max)  # ascending: by track, then term
    exact = np.append(impacts(flat("times")[1], m[rows]), 0)
    for (slots, ids_of_terms, weights), top in zip(lines, best):
        bounds = weights @ peaks[slots]
        open_ = np.flatnonzero(bounds >= top.threshold)
        open_ = open_[np.argsort(-bounds[open_], kind="stable")]
        known = ids_of_terms < place
        for at in range(0, len(open_), STEP):
            chunk = open_[at : at + STEP]
            if bounds[chunk[0]] < top.threshold:
                break
            wanted = chunk[:, None] * place + ids_of_terms[known]
            spots = np.searchsorted(keys, wanted)
            scores = np.where(keys[spots] == wanted, exact[spots], 0) @ weights[known]
            good = np.flatnonzero(scores >= top.threshold)
            if len(good):
                top.add(scores[good].tolist(), ids.take(pa.array(chunk[good])).to_pylist())
                if len(top.rows) >= top.k:
                    top.cut()


def blocks(lines: DataFrame, most_lines: int, most_terms: int) -> Iterator[list[tuple]]:
    """Lines (line_id, terms) that have terms, in blocks; the driver holds one block at a time."""
    block, size = [], 0
    for line_id, text in lines.select("line_id", "line_text").toLocalIterator():
        terms = sorted(term_counts(text or ""))
        if not terms:
            continue
        if block and (len(block) == most_lines or size + len(terms) > most_terms):
            yield block
            block, size = [], 0
        block.append((line_id, terms))
        size += len(terms)
    if block:
        yield block


def search_lyrics(
    tracks: DataFrame,
    lines: DataFrame,
    k: int = 50,
    width: int = 2048,
    most_lines: int = 1_000,
    most_terms: int = 200_000,
) -> DataFrame:
    """The k tracks whose lyrics score highest for each lyric line.

    tracks: track_id, lyrics_text; lines: line_id, line_text. Terms are maximal runs of ASCII letters and digits (A-Z
    in lower case) and all characters beyond ASCII. A track scores, over the distinct terms of a line, the sum of
    floor(1000 ln((2N + 2) / (2 df + 1))) times 10^9 tf div (1000 tf + 20 m); m is 50 plus 50 times the track's length
    over the average one, rounded down. Returns line_id, rank (from 1), track_id, score: scores above 0, high ones
    first, equal ones by ascending track_id (null last).

    Each track's counts fold into `width` hashed slots by their maximum. The slots of a line's terms give an upper
    bound of the score; a task takes its tracks by descending bound and rescores them exactly until the bound is below
    the k-th best score it has met. Only its k best leave the task; they are merged in two steps, so no task gets all.

    Lines come to the driver in blocks of at most `most_lines` lines and `most_terms` terms (one longer line is a block
    of its own), and each block reads all tracks once; no line or track is left out. Null and empty texts have no
    terms: such lines give no rows, such tracks are never found. Very long texts are cut into terms piece by piece.
    Repeated rows of either table count as they come; equal ids may take several ranks. An empty table gives an empty
    result; other columns are ignored.
    """
    track_kind = tracks.schema["track_id"].dataType
    line_field = lines.schema["line_id"]
    spark = tracks.sparkSession
    parts = []
    for block in blocks(lines, most_lines, most_terms):
        names = [(i, line_id) for i, (line_id, _) in enumerate(block)]
        found = _searched(tracks, [terms for _, terms in block], k, width)
        named = spark.createDataFrame(names, f"line long, line_id {line_field.dataType.simpleString()}")
        parts.append(found.join(F.broadcast(named), "line").select("line_id", "rank", "track_id", "score"))
    if not parts:
        return spark.createDataFrame(
            [], f"line_id {line_field.dataType.simpleString()}, rank int, track_id {track_kind.simpleString()}, score long"
        )
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _searched(tracks: DataFrame, lines: list[list[bytes]], k: int, width: int) -> DataFrame:
    """line (its number), rank, track_id, score for one block of lines."""
    vocabulary = {term: i for i, term in enumerate(sorted({t for terms in lines for t in terms}))}
    index = written(sketched(tracks, vocabulary, width))
    n_tracks, n_terms = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = dict(index.select(F.explode("found").alias("term")).groupBy("term").count().collect())  # the block's terms at most

    def prepared(terms: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known = [(slot_of(t, width), vocabulary[t], held[vocabulary[t]]) for t in terms if vocabulary[t] in held]
        slots, ids, df = np.array(known, np.int64).reshape(-1, 3).T
        weights = [math.floor(1000 * math.log((2 * n_tracks + 2) / (2 * d + 1))) for d in df.tolist()]
        return slots, ids, np.array(weights, np.int64)

    ready = [prepared(terms) for terms in lines]
    kind = tracks.schema["track_id"].dataType.simpleString()

    def search(batches):
        best, id_type = [Best(k) for _ in ready], pa.null()
        for batch in sliced(batches, ROWS):
            id_type = batch.column("track_id").type
            if n_terms and batch.num_rows:
                rescored(batch, ready, best, n_tracks, n_terms, width)
        if pa.types.is_null(id_type):
            return
        rows = [(i, track, score) for i, top in enumerate(best) for score, track in top.cut()]
        line, track, score = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(line, pa.int64()), pa.array(track, id_type), pa.array(score, pa.int64())],
            ["line", "track_id", "score"],
        )

    local = index.mapInArrow(search, f"line long, track_id {kind}, score long")
    order = [F.desc("score"), F.asc_nulls_last("track_id")]
    part = F.pmod(F.xxhash64("track_id"), F.lit(64))
    for keys in (["line", "part"], ["line"]):
        rows = local.withColumn("part", part) if "part" in keys else rows
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    return rows.drop("part")
