"""Quality scores of lyrics by a factorisation machine."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import sliced
from .machine import FactorisationMachine
from .quality import BLANK, CLASSES, class_table, repeated_lines, repeated_words
from .words import PerWord, WordBook

STATISTICS = 15


class Features:
    """Structure statistics, size facts and hashed words of texts, as dense rows."""

    def __init__(self, slots: int):
        self.slots = slots
        self.classes = class_table()
        self.book = WordBook()
        self.slot_of = PerWord(self.book, lambda w: zlib.crc32(w.lower()) % slots)
        self.length_of = PerWord(self.book, len)

    def rows(self, texts: list[str]) -> np.ndarray:
        self.book.trim()
        coded = [self.book.codes(t.encode().split()) for t in texts]
        slot_of, length_of = self.slot_of.table(), self.length_of.table()
        rows = np.zeros((len(texts), STATISTICS + self.slots), np.float32)
        for row, text, codes in zip(rows, texts, coded):
            row[:STATISTICS] = self._statistics(text, codes, length_of)
            counts = np.log1p(np.bincount(slot_of[codes], minlength=self.slots))
            row[STATISTICS:] = counts / max(np.sqrt((counts**2).sum()), 1e-9)
        return rows

    def _statistics(self, text: str, codes: np.ndarray, length_of: np.ndarray) -> list[float]:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kinds = np.bincount(self.classes[np.minimum(points, 0x10000)], minlength=len(CLASSES))
        n = max(1, len(codes))
        shares = kinds / max(1, len(points) - kinds[BLANK])
        distinct = len(np.unique(codes)) / n
        return [
            *shares[:BLANK],
            min(1.0, 5 * shares[4]),
            distinct,
            min(1.0, (length_of[codes].mean() if len(codes) else 0) / 20),
            repeated_words(codes) / n,
            min(1.0, repeated_lines(text) / (1 + text.count("\n"))),
            np.log1p(len(codes)) / 10,
            np.log1p(len(points)) / 12,
            float(len(codes) < 10),
            1.0 if len(codes) else 0.0,
        ]


def classify_lyrics(
    tracks: DataFrame,
    ratings: DataFrame,
    most_ratings: int = 6_000,
    slots: int = 2_048,
    cut: float = 0.3,
    carried: str | None = None,
) -> DataFrame:
    """Probability that a track's lyrics are rated good, by a factorisation machine.

    tracks: track_id, lyrics_text. ratings: track_id, quality (1 good, 0 bad). Inputs of a
    score are hashed words, structure statistics and size facts of the text alone; their pairs
    interact by low-rank factors, in time linear in the inputs. The machine learns from
    rated tracks whose crc32(track_id as text) mod 5 is not 0: the `most_ratings` of them with
    the lowest hashed id, a bounded sample that the driver fits, of several rows of one id the one with
    the lowest hashed text; every track is scored. Returns
    track_id, held_out, score (0 to 1), predicted (1 if score >= cut, else 0), and the column
    `carried` as it is, if one is named (under its own name, also if that is one of these).

    Null lyrics count as empty and get a score, too; ratings that are null or of unknown tracks
    are not used, of several for one track the highest; with one class only, all scores are alike.
    A null id is not held out. Rows repeat as they come; an empty table gives an empty result;
    other columns are ignored. Scoring is one pass without a shuffle.
    """
    text = F.coalesce("lyrics_text", F.lit("")).alias("lyrics_text")

    def remainder(column: str):
        return F.crc32(F.col(column).cast("string").cast("binary")) % 5

    usable = ratings.filter(F.col("track_id").isNotNull() & F.col("quality").isNotNull() & (remainder("track_id") != 0))
    sample = (
        usable.groupBy("track_id")
        .agg(F.max("quality").cast("double").alias("quality"))
        .orderBy(F.xxhash64(F.col("track_id").cast("string")), "track_id")
        .limit(most_ratings)
    )
    rated = (
        tracks.select("track_id", text)
        .join(F.broadcast(sample), "track_id")  # at most most_ratings rows
        .groupBy("track_id", "quality")
        .agg(F.min_by("lyrics_text", F.xxhash64("lyrics_text")).alias("lyrics_text"))
        .select("track_id", "lyrics_text", "quality")
    )
    machine, scale = _fitted(rated, slots)

    def score(batches):
        features = Features(slots)
        for batch in sliced(batches, 1_000):
            scores = machine.scores(scale(features.rows(batch.column(2).to_pylist())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), *batch.columns[3:]],
                ["track_id", "held_out", "score", *(["_carried"] if carried else [])],
            )

    held_out = F.coalesce(remainder("track_id") == 0, F.lit(False)).alias("held_out")
    rest = [F.col(carried).alias("_carried")] if carried else []
    rows = tracks.select("track_id", held_out, text.alias("_lyrics"), *rest)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = [f"track_id {kinds['track_id']}", "held_out boolean", "score double"]
    scored = rows.mapInArrow(score, ", ".join([*schema, *(f"_carried {kinds['_carried']}" for _ in rest)]))
    predicted = (F.col("score") >= cut).cast("int").alias("predicted")
    return scored.select("track_id", "held_out", "score", predicted, *(F.col("_carried").alias(carried) for _ in rest))


class Scale:
    """Statistics to mean 0 and deviation 1 in the sample; hashed words stay as they are."""

    def __init__(self, statistics: np.ndarray):
        part = statistics.astype(np.float64)
        self.mean = part.mean(0) if len(part) else np.zeros(STATISTICS)
        self.spread = np.maximum(part.std(0), 0.02) if len(part) else np.ones(STATISTICS)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        scaled = rows.astype(np.float64)
        scaled[:, :STATISTICS] = np.clip((scaled[:, :STATISTICS] - self.mean) / self.spread, -4, 4)
        return scaled


class Sample:
    """Feature rows as they come from the tasks, made dense a batch at a time: the places and values that are not 0."""

    def __init__(self, packed: list[bytes], width: int):
        self.packed, self.shape = packed, (len(packed), width)
        self.scale = Scale(np.array([self._dense(b)[:STATISTICS] for b in packed], np.float32).reshape(-1, STATISTICS))

    @staticmethod
    def pack(row: np.ndarray) -> bytes:
        row = row.astype(np.float16)
        places = np.flatnonzero(row)
        return places.astype(np.uint16).tobytes() + row[places].tobytes()

    def _dense(self, packed: bytes) -> np.ndarray:
        n = len(packed) // 4
        row = np.zeros(self.shape[1], np.float32)
        row[np.frombuffer(packed, np.uint16, n)] = np.frombuffer(packed, np.float16, n, 2 * n)
        return row

    def __len__(self) -> int:
        return len(self.packed)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.scale(np.array([self._dense(self.packed[i]) for i in at])).astype(np.float32)


def _fitted(rated: DataFrame, slots: int) -> tuple[FactorisationMachine, Scale]:
    """rated: track_id, lyrics_text, quality. Features are made by tasks; rows come as bytes."""

    def featured(batches):
        features = Features(slots)
        for batch in sliced(batches, 1_000):
            rows = features.rows(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([Sample.pack(r) for r in rows], pa.binary())],
                ["track_id", "quality", "inputs"],
            )

    kind = rated.schema["track_id"].dataType.simpleString()
    found = rated.mapInArrow(featured, f"track_id {kind}, quality double, inputs binary").collect()
    found.sort(key=lambda r: (str(r["track_id"]), r["inputs"]))
    sample = Sample([bytes(r["inputs"]) for r in found], STATISTICS + slots)
    marks = np.array([r["quality"] for r in found], np.float32)
    return FactorisationMachine.fitted(sample, marks), sample.scale
