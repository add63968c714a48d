"""Packing lyrics into sequences along a space-filling curve."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .batches import sliced
from .crosswalk import byte_alphabet
from .curve import Projection
from .prefix import before, in_cells
from .store import written

CLOSING = 2  # id that closes a document
MARK = "\x01"  # between words that are tokenised side by side, and the end of a plain part of a word
RUN = 1 << 23  # bytes of text that are spelled at once


#: Words whose parts are known without the tokenizer's rules (ASCII but for the apostrophe, and letters of
#: Latin-1), and these parts, once in lower case: runs of letters, single digits, runs of marks.
PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
PART = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
LAST = "</w>"  # fixed value: ends the last token of a part in the vocabulary


class PlainWords:
    """Ids of plain words: the merges of a vocabulary file, applied to many parts at once.

    A part is written with a closing byte, which the vocabulary has as the suffix of last tokens.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        alphabet, vocabulary = byte_alphabet(), model["vocab"]
        closing = MARK.encode()
        ranks = {}
        for token, i in vocabulary.items():
            last = token.endswith(LAST)
            core = token.removesuffix(LAST) if last else token
            if all(c in alphabet for c in core):
                ranks[bytes(alphabet[c] for c in core) + closing * last] = i
        merged = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
        #: whether an id's merge comes before those of all higher ids, as the encoder assumes
        self.usable = merged == list(range(512, 512 + len(merged))) and len(ranks) == 512 + len(merged)
        self.encoder = tiktoken.Encoding("words", pat_str=r"[^\x01\n]*\x01|\n", mergeable_ranks=ranks, special_tokens={}) if self.usable else None
        self.newline = ranks.get(b"\n")

    def fits(self, word: str) -> bool:
        return self.usable and "<|" not in word and PLAIN.fullmatch(word) is not None

    def ids(self, words: list[str]) -> list[bytes]:
        closed = PART.sub(r"\g<0>" + MARK, "\n".join(words).lower()) + "\n"
        found = self.encoder.encode_to_numpy(closed)
        ends = (4 * np.flatnonzero(found == self.newline)).tolist()
        raw = found.tobytes()
        return [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends)]


class WordIds:
    """Ids of a tokenizer that never joins across white space, remembered per word."""

    def __init__(self, path: str, room: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.room = room
        self.mark = self._batch([MARK])[0][-1]
        self.known: dict[str, bytes] = {}
        self.plain = PlainWords(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def ids(self, texts: pa.StringArray) -> list[np.ndarray]:
        """Ids of each text and the closing id, some megabytes of text at a time."""
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero(np.diff(sizes // RUN)) + 1
        bounds = [0, *cuts.tolist(), len(texts)]
        return [ids for at, until in zip(bounds, bounds[1:]) for ids in self._spelled(texts.slice(at, until - at))]

    def _spelled(self, texts: pa.StringArray) -> list[np.ndarray]:
        cut = pc.ascii_split_whitespace(texts)
        words = cut.flatten().dictionary_encode()
        spelled = [*self._known(words.dictionary.to_pylist()), np.array([CLOSING], np.uint32).tobytes()]
        table = np.frombuffer(b"".join(spelled), np.uint32)
        length = np.fromiter(map(len, spelled), np.int32, len(spelled)) // 4
        begin = np.cumsum(length, dtype=np.int32) - length
        ends = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))
        order = np.insert(words.indices.to_numpy(), ends, len(spelled) - 1)  # a closing id after each text
        taken = length[order]
        until = np.cumsum(taken, dtype=np.int32)
        ids = table[np.repeat(begin[order] - until + taken, taken) + np.arange(taken.sum(), dtype=np.int32)]
        return np.split(ids, until[ends + np.arange(len(ends))][:-1]) if len(texts) else []

    def _known(self, words: list[str]) -> list[bytes]:
        """Ids of each distinct word; those not met before are encoded, plain ones by the merges alone."""
        if len(self.known) > self.room:
            self.known = {}
        known = self.known
        new = [w for w in words if w not in known]
        fits = self.plain.fits
        if plain := [w for w in new if fits(w)]:
            known.update(zip(plain, self.plain.ids(plain)))
            new = [w for w in new if w not in known]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            known.update(zip(part, self._encoded(part)))
        return [*map(known.__getitem__, words)]

    def _encoded(self, words: list[str], side_by_side: int = 100) -> list[bytes]:
        """Ids of words, many in one text with a mark between them; one by one where that mark is a word's."""
        groups = [words[i : i + side_by_side] for i in range(0, len(words), side_by_side)]
        found = []
        for group, text in zip(groups, self._batch([f" {MARK} ".join(group) for group in groups])):
            ends = [*np.flatnonzero(text == self.mark).tolist(), len(text)]
            if len(ends) == len(group):
                raw = text.tobytes()
                found += [raw[4 * a : 4 * b] for a, b in zip([0, *(e + 1 for e in ends)], ends)]
            else:
                found += [ids.tobytes() for ids in self._batch(group)]
        return found

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=1)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def _tokenised(tracks: DataFrame, tokenizer: str) -> DataFrame:
    """track_id, curve_key, n_tokens and the compressed ids of each track."""

    def tokenise(batches):
        coder = _word_ids(tokenizer)
        places = Projection(coder.vocabulary + CLOSING + 1)
        press = zstandard.ZstdCompressor(level=1)
        for batch in sliced(batches):
            ids = coder.ids(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(places.keys(ids)),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([press.compress(x.tobytes()) for x in ids], pa.binary()),
                ],
                ["track_id", "curve_key", "n_tokens", "ids"],
            )

    rows = tracks.select("track_id", F.coalesce("lyrics_text", F.lit("")).alias("lyrics_text"))
    kind = rows.schema["track_id"].dataType.simpleString()
    return rows.mapInArrow(tokenise, f"track_id {kind}, curve_key long, n_tokens long, ids binary")


def pack_lyrics(tracks: DataFrame, tokenizer: str, length: int = 4096) -> DataFrame:
    """Pieces of lyrics packed into sequences of `length` tokens, similar tracks side by side.

    tracks: track_id, lyrics_text. Each track is tokenised and closed with id 2; a hashed vector
    of its distinct tokens is projected to four dimensions and placed on a Hilbert curve. Along
    the curve (ties by track_id) tokens are laid end to end and cut every `length`, so only the last
    sequence is padded. Returns one row per piece: track_id, start (the track's ids before it),
    length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Null lyrics count as empty: one piece with the closing id. Rows repeat as they come, each
    packed on its own; a null id packs like any; an empty table gives an empty result; other
    columns are ignored. Ids are written once, compressed, and shuffled once; only narrow rows
    are range-sorted.
    """
    tokenised = written(_tokenised(tracks, tokenizer).withColumn("row", F.monotonically_increasing_id()))
    order = ["curve_key", "track_id", "row"]
    placed = before(in_cells(tokenised.select(*order, "n_tokens"), *order), order, {"first": "n_tokens"})
    kind = tokenised.schema["track_id"].dataType.simpleString()

    def cut(batches):
        unpress = zstandard.ZstdDecompressor()
        for batch in sliced(batches):
            owner, columns = [], {k: [] for k in ("start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            for i, (first, packed) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                ids = np.frombuffer(unpress.decompress(packed), np.uint32)
                at = 0
                while at < len(ids):
                    sequence, offset = divmod(first + at, length)
                    piece = ids[at : at + length - offset]
                    owner.append(i)
                    for name, value in zip(columns, (at, len(piece), piece.tobytes(), len(ids), sequence, offset)):
                        columns[name].append(value)
                    at += len(piece)
            kinds = {"ids": pa.binary()}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64()))]
                + [pa.array(v, kinds.get(k, pa.int64())) for k, v in columns.items()],
                ["track_id", *columns],
            )

    joined = tokenised.select("row", "ids").join(placed, "row").select("track_id", "first", "ids")
    return joined.mapInArrow(
        cut,
        f"track_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )
