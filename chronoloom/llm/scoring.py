"""Language-model scores of lyrics by a hidden Markov model over hashed words."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import sliced
from .hmm import Model, expected_counts, grouped, log10_likelihood, windows
from .store import written

END = "\n"  # no word contains white space
COMMON = 200_000  # words with a share of 1/COMMON or more, so at most that many


LONGEST = 64  # bytes of a word that is kept as it is


def _words(text: str) -> list[bytes]:
    """A-Z in lower case, cut at ASCII white space."""
    return text.encode().lower().split()


def _bounded(word: bytes) -> bytes:
    """The word, or a short name of a longer one that no word can have."""
    return word if len(word) <= LONGEST else b"\t" + hashlib.sha256(word).hexdigest().encode()


def word_counts(tracks: DataFrame) -> DataFrame:
    """word (see `_bounded`), n over the training tracks, the end of each counted as a word of its own."""

    def count(batches):
        for batch in batches:
            seen = Counter()
            for part in sliced([batch]):
                for text in part.column(0).to_pylist():
                    seen.update(_words(text))
            seen[END.encode()] += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(map(_bounded, seen), pa.binary()).cast(pa.string()),
                    pa.array(list(seen.values()), pa.int64()),
                ],
                ["word", "n"],
            )

    return (
        tracks.filter(~F.col("held_out"))
        .select("lyrics_text")
        .mapInArrow(count, "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )


def _slot(word, slots: int):
    """Emission slot of a word; the last slot is the end's own."""
    hashed = F.pmod(F.crc32(F.col(word).cast("binary")), F.lit(slots)).cast("int")
    return F.when(F.col(word) == END, slots).otherwise(hashed)


class WordBook:
    """Codes of words: the common ones first, others as they are met, up to a bound."""

    def __init__(self, known: dict[bytes, tuple[int, int]], slots: int, room: int = 400_000):
        self.known, self.slots, self.room, self.n_common = known, slots, room, len(known)
        self._reset()

    def _reset(self) -> None:
        self.code_of = {word: code for code, word in enumerate(self.known)}
        self.words = list(self.known)
        self.slot_of = [slot for slot, _ in self.known.values()]
        self.count_of = [n for _, n in self.known.values()]

    def trim(self) -> None:
        if len(self.words) > self.room + self.n_common:
            self._reset()

    def _met(self, word: bytes) -> int:
        name = _bounded(word)
        if name is not word and name in self.code_of:
            code = self.code_of[word] = self.code_of[name]
            return code
        code = self.code_of[word] = self.code_of[name] = len(self.words)
        self.words.append(name)
        self.slot_of.append(zlib.crc32(name) % self.slots)
        self.count_of.append(0)
        return code

    def codes(self, words: list[bytes]) -> np.ndarray:
        get, met = self.code_of.get, self._met
        return np.array([met(w) if (c := get(w)) is None else c for w in words], np.int64)


def encoded(tracks: DataFrame, common: dict[bytes, tuple[int, int]], slots: int) -> DataFrame:
    """One row per track: slots of its words in order, what its common words add, its rare words."""
    shared = tracks.sparkSession.sparkContext.broadcast(common)

    def encode(batches):
        known = shared.value
        row = TaskContext.get().partitionId() << 40
        book = WordBook(known, slots)
        end_count = known[END.encode()][1] if END.encode() in known else 0
        end_log = np.log10(end_count + 0.1)
        for batch in sliced(batches):
            book.trim()
            codes = [book.codes(_words(text)) for text in batch.column(2).to_pylist()]
            slot_of, count_of = np.array(book.slot_of, np.uint16), np.array(book.count_of, np.int64)
            log_of = np.log10(count_of + 0.1)
            n_known, logs, spelled, rare, times = [], [], [], [], []
            for code in codes:
                common = code < book.n_common
                n_known.append(int(common.sum()) + (end_count > 0))
                logs.append(float(log_of[code[common]].sum() + end_log))
                spelled.append(np.append(slot_of[code], np.uint16(slots)).tobytes())
                unusual, n = np.unique(code[~common], return_counts=True)
                rare.append([book.words[c] for c in unusual.tolist()])
                times.append(n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(np.arange(row, row + batch.num_rows)),
                    pa.array([len(c) + 1 for c in codes], pa.int64()),
                    pa.array(n_known, pa.int64()),
                    pa.array(logs, pa.float64()),
                    pa.array(spelled, pa.binary()),
                    pa.array(rare, pa.list_(pa.binary())),
                    pa.array(times, pa.list_(pa.int64())),
                ],
                ["track_id", "held_out", "row", "n_tokens", "n_known", "common_log", "slots", "rare", "rare_n"],
            )
            row += batch.num_rows

    kind = tracks.schema["track_id"].dataType.simpleString()
    schema = (
        f"track_id {kind}, held_out boolean, row long, n_tokens long, n_known long, common_log double, "
        "slots binary, rare array<binary>, rare_n array<long>"
    )
    return tracks.select("track_id", "held_out", "lyrics_text").mapInArrow(encode, schema)


def trained(sequences: DataFrame, share: np.ndarray, states: int, rounds: int) -> Model:
    """Baum-Welch over all training sequences; each round sums expected counts across tasks."""
    model = Model.first(states, share)
    slots = len(share)
    names = [f"s{k}" for k in range(states)]

    def expect(batches):
        starts, moves = np.zeros(states), np.zeros((states, states))
        emits = np.zeros((slots, states))
        for batch in batches:
            pieces = [w for b in batch.column(0).to_pylist() for w in windows(np.frombuffer(b, np.uint16))]
            for group in grouped(pieces):
                s, m, e = expected_counts(model, group)
                starts, moves, emits = starts + s, moves + m, emits + e
        stacked = np.vstack([emits, moves, starts[None, :]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(stacked))), *(pa.array(np.ascontiguousarray(stacked[:, k])) for k in range(states))],
            ["slot", *names],
        )

    for _ in range(rounds):
        summed = (
            sequences.select("slots")
            .mapInArrow(expect, "slot long, " + ", ".join(f"{n} double" for n in names))
            .groupBy("slot")
            .agg(*(F.sum(n).alias(n) for n in names))
        )
        table = np.zeros((slots + states + 1, states))
        for row in summed.collect():  # slots + states + 1 rows
            table[row[0]] = row[1:]
        model = Model.fitted(table[-1], table[slots:-1], table[:slots], share)
    return model


def score_lyrics(tracks: DataFrame, states: int = 6, rounds: int = 4, slots: int = 16_384) -> DataFrame:
    """log10 probability of each track's lyrics under a unigram base and a hidden Markov model.

    tracks: track_id, lyrics_text. Tokens: words in lower-case A-Z, then one end. Tracks whose
    crc32(track_id as text) mod 10 is not 0 are learned from. The model's latent states emit
    slots of hashed words; within a slot a word has its smoothed share of the slot's training
    count, and each slot keeps a share for unknown words, so probabilities add up to one.
    Baum-Welch counts of all training tracks are summed across partitions `rounds` times.
    Returns track_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null lyrics count as empty (one token, the end); a null id is learned from; rows repeat as
    they come; an empty table gives an empty result; other columns are ignored. Words with at least
    1/200,000 of all tokens go to every task, at most that many; all others are joined. Words of more than 64 bytes go by
    a hash of theirs, so no word is too long for either way. For
    training only, sequences are cut into windows of 2,048 tokens; scores run over whole texts.
    """
    held_out = F.coalesce(F.crc32(F.col("track_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    rows = tracks.select(
        "track_id", F.coalesce("lyrics_text", F.lit("")).alias("lyrics_text"), held_out.alias("held_out")
    )
    counts = written(word_counts(rows))
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = counts.filter((F.col("n") * COMMON >= F.lit(total)) | (F.col("word") == END))
    common = {
        r["word"].encode(): (r["slot"], r["n"]) for r in frequent.select("word", _slot("word", slots).alias("slot"), "n").collect()
    }
    stats = counts.groupBy(_slot("word", slots).alias("slot")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    mass = np.full(slots + 1, 0.1)
    for r in stats.collect():  # one row per slot
        mass[r["slot"]] = r["n"] + 0.1 * (r["kinds"] + 1)
    coded = written(encoded(rows, common, slots))
    # a track's rare words: their counts come by a join
    rare = coded.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("w")).select(
        "row", F.col("w.rare").cast("string").alias("word"), F.col("w.rare_n").alias("times")
    )
    found = rare.join(counts, "word", "left")
    added = found.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("rare_log"),
    )
    model = trained(coded.filter(~F.col("held_out")), mass / mass.sum(), states, rounds)
    log_mass = np.log10(mass)

    def forward(batches):
        for batch in sliced(batches):
            sequences = [np.frombuffer(b, np.uint16) for b in batch.column(batch.num_columns - 1).to_pylist()]
            inside = log10_likelihood(model, sequences) - np.array([log_mass[s].sum() for s in sequences])
            columns = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(inside, pa.float64())], [*names, "inside"])

    names = ["track_id", "held_out", "row", "n_tokens", "n_known", "common_log"]
    kept = coded.select(*names, "slots")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema if f.name != "slots")
    scored = kept.mapInArrow(forward, schema + ", inside double").join(added, "row", "left")
    logs = F.col("common_log") + F.coalesce("rare_log", F.lit(0.0))
    whole = float(np.log10(total + 0.1 * (kinds + 1)))
    return scored.select(
        "track_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * whole).alias("base_score"),
        (logs + F.col("inside")).alias("score"),
    )
