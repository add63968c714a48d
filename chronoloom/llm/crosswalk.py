"""Two tokenizations of lyrics side by side: shared token ends, linked ids and how usual each link is."""

from __future__ import annotations

import hashlib
import json
from functools import cached_property, lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .batches import sliced
from .store import written

#: Fixed value: how a byte-level BPE cuts texts into pre-tokens.
PRE_TOKENS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = "▁"  # fixed value: how pieces write a space
CHUNK = 1 << 16  # characters given to a tokenizer at a time, if the text has words
OTHER = 1 << 16  # second ids in a window's key lie from here on
MEMO = 1 << 17  # windows remembered; when there are more, the rarer ones are forgotten
LINK = 1 << 32  # a link is the first id times this plus the second


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from U+0100."""
    alphabet, fresh = {}, 0x100
    for byte in range(256):
        shown = 0x21 <= byte <= 0x7E or 0xA1 <= byte <= 0xAC or 0xAE <= byte
        alphabet[chr(byte if shown else fresh)] = byte
        fresh += not shown
    return alphabet


class ByteLevel:
    """A byte-level BPE vocabulary file: ids of texts, bytes of ids; special strings are plain text.

    Texts of Latin-1 characters go through a faster encoder of the same merges, if the file's merges are in the order of
    its ids; all others through the file's own library, which is loaded when the first of them comes.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model, special = stored["model"], {t["content"] for t in stored["added_tokens"]}
        alphabet = byte_alphabet()
        vocabulary = model["vocab"] | {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        ranks = {self.bytes[i]: i for token, i in model["vocab"].items() if token not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merged = [model["vocab"].get("".join(m), -1) for m in pairs]
        in_order = merged == sorted(set(merged)) and merged[0] >= 0 and len(ranks) == 256 + len(merged)
        self.fast = tiktoken.Encoding("lyrics", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={}) if in_order else None

    @cached_property
    def library(self) -> Tokenizer:
        library = Tokenizer.from_file(self.path)
        library.encode_special_tokens = True
        return library

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and _latin(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


class Pieces:
    """A sentence-piece model: ids of texts (a space comes first), bytes of ids."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)
        ]
        self.by_word = not any(a != SPACE and b == SPACE for p in names for a, b in pairwise(p))

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), np.uint32)


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def chunks(text: str, size: int = CHUNK) -> list[str]:
    """The text, which begins with a space, cut before words of ASCII letters: ` a` after a character that is no blank.

    Neither tokenizer joins anything across such a place. A stretch without one stays whole.
    """
    cuts, at = [0], size
    while at < len(text):
        space = text.find(" ", at)
        if space < 0:
            break
        after = text[space + 1 : space + 2]
        if after.isascii() and after.isalpha() and not text[space - 1].isspace():
            cuts.append(space)
            at = space + size
        else:
            at = space + 1
    return [text[a:b] for a, b in pairwise([*cuts, len(text)])]


class Crosswalk:
    """Groups and links of texts under two tokenizers; remembers the alignment of windows by their ids."""

    def __init__(self, first: str, second: str):
        self.first, self.second = ByteLevel(first), Pieces(second)
        if len(self.first.bytes) > OTHER:
            raise ValueError(f"the first vocabulary has more than {OTHER} ids")
        self.lengths = [np.array([len(b) for b in side.bytes], np.int64) for side in (self.first, self.second)]
        self.spaced = [np.array([b[:1] == b" " for b in side.bytes]) for side in (self.first, self.second)]
        names = [[str(i) for i in range(len(side.bytes))] for side in (self.first, self.second)]
        self.written = [(i + end).encode() for side, signs in zip(names, (",|", ",;")) for end in signs for i in side]
        self.memo: dict[bytes, int] = {}
        self.raw: list[bytes | None] = []  # the window's bytes; None if the two sides differ
        self.shown: list[bytes] = []  # each group ends in `;`
        self.linked: list[bytes] = []
        self.met = np.zeros(0, np.int64)  # how often each window came

    def forget(self) -> None:
        """Keeps the half of the room that came most often."""
        kept = np.argsort(-self.met, kind="stable")[: MEMO // 2].tolist()
        keys = list(self.memo)
        self.memo = {keys[i]: n for n, i in enumerate(kept)}
        self.raw, self.shown, self.linked = ([values[i] for i in kept] for values in (self.raw, self.shown, self.linked))
        self.met = self.met[kept] // 2

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a space and the text under both tokenizers; none for an empty text."""
        parts = chunks(" " + text) if self.second.by_word else [" " + text]
        if not text:
            return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        return np.concatenate([self.first.ids(p) for p in parts]), np.concatenate([self.second.ids(p[1:]) for p in parts])

    def learn(self, keys: list[bytes]) -> None:
        """Aligns new windows together and remembers of each its bytes, its groups as text and its links."""
        ids = np.frombuffer(b"".join(keys), np.uint32).astype(np.int64)
        ends = np.cumsum([len(key) // 4 for key in keys])  # of each window's ids
        second = ids >= OTHER
        a, b = ids[~second], ids[second] - OTHER
        reach = [np.cumsum(lengths[side]) for lengths, side in zip(self.lengths, (a, b))]  # each window is as long on both sides
        last = [_among(reach[0], reach[1]), _among(reach[1], reach[0])]  # tokens that end a group
        last_a, last_b = map(np.flatnonzero, last)
        links = (a[last_a] * LINK + b[last_b]).tobytes()
        group_a, group_b = (np.cumsum(x) - x for x in last)
        order = np.empty(len(ids), np.int64)  # what to write, group by group
        order[np.arange(len(a)) + np.append(0, last_b + 1)[group_a]] = a + last[0] * len(self.first.bytes)
        order[np.arange(len(b)) + last_a[group_b] + 1] = b + last[1] * len(self.second.bytes) + 2 * len(self.first.bytes)
        parts = list(map(self.written.__getitem__, order.tolist()))
        joined = [b"".join(map(side.bytes.__getitem__, own.tolist())) for side, own in ((self.first, a), (self.second, b))]
        ends_a = np.cumsum(~second)[ends - 1]  # first ids up to each window's end
        cuts = [np.append(0, x).tolist() for x in (ends, reach[0][ends_a - 1], 8 * np.cumsum(last[0])[ends_a - 1])]
        for i, key in enumerate(keys):
            (t0, t1), (r0, r1), (l0, l1) = ((c[i], c[i + 1]) for c in cuts)
            raw = joined[0][r0:r1]
            self.memo[key] = len(self.raw)
            self.raw.append(raw if raw == joined[1][r0:r1] else None)
            self.shown.append(b"".join(parts[t0:t1]))
            self.linked.append(links[l0:l1])

    def aligned(self, texts: list[str]) -> list[tuple[int, int, str, bytes]]:
        """n_a, n_b, hash of the groups and links (as packed longs) of each text; zeros if it has no tokens."""
        if len(self.memo) > MEMO:
            self.forget()
        sides = [self.tokens(text) for text in texts]
        raws = [b" " + text.encode() for text in texts]
        found: list[tuple[int, int, str, bytes]] = [(0, 0, "", b"")] * len(texts)
        fits = [
            i
            for i, (pair, raw) in enumerate(zip(sides, raws))
            if len(pair[0]) and all(int(lengths[ids].sum()) == len(raw) for lengths, ids in zip(self.lengths, pair))
        ]
        if not fits:
            return found
        windows, firsts = self.windows([sides[i] for i in fits], [len(raws[i]) for i in fits])
        if fresh := [key for key in dict.fromkeys(windows) if key not in self.memo]:
            self.learn(fresh)
        spots = list(map(self.memo.__getitem__, windows))
        came = np.bincount(spots, minlength=len(self.raw))
        came[: len(self.met)] += self.met
        self.met = came
        for i, (w0, w1) in zip(fits, pairwise(firsts)):
            own = spots[w0:w1]
            parts = list(map(self.raw.__getitem__, own))
            if None in parts or b"".join(parts) != raws[i]:
                continue
            shown = b"".join(map(self.shown.__getitem__, own))[:-1]
            links = b"".join(map(self.linked.__getitem__, own))
            found[i] = (len(sides[i][0]), len(sides[i][1]), hashlib.sha256(shown).hexdigest(), links)
        return found

    def windows(self, sides: list[tuple[np.ndarray, np.ndarray]], sizes: list[int]) -> tuple[list[bytes], list[int]]:
        """Keys of the windows of all texts, and where each text's begin (and the last one ends).

        A window begins where a token that begins with a space begins on both sides, so the tokens before it end
        together there; the place is compared by bytes.
        """
        ids = [np.concatenate([pair[s] for pair in sides]) for s in (0, 1)]
        starts = []
        for side, lengths in zip(ids, self.lengths):
            ends = np.cumsum(lengths[side])
            starts.append(ends - lengths[side])
        bases = np.cumsum([0, *sizes])
        total = int(bases[-1])
        begins = np.zeros(total + 1, bool)
        begins[starts[0][self.spaced[0][ids[0]]]] = True
        both = np.zeros(total + 1, bool)
        candidates = starts[1][self.spaced[1][ids[1]]]
        both[candidates[begins[candidates]]] = True
        both[bases] = True
        cuts = np.flatnonzero(both)  # the last is the end of all
        at = [np.searchsorted(s, cuts) for s in starts]
        packed = np.empty(len(ids[0]) + len(ids[1]), np.uint32)
        window = [np.repeat(np.arange(len(cuts) - 1), np.diff(a)) for a in at]
        packed[np.arange(len(ids[0])) + at[1][window[0]]] = ids[0]
        packed[np.arange(len(ids[1])) + at[0][window[1] + 1]] = ids[1] + OTHER
        buffer = packed.tobytes()
        keys = [buffer[i:j] for i, j in pairwise(((at[0] + at[1]) * 4).tolist())]
        return keys, np.searchsorted(cuts, bases).tolist()


def _among(values: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of the ascending values are among the others, that end where they do."""
    marked = np.zeros(int(others[-1]) + 1, bool)
    marked[others] = True
    return marked[values]


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's compressed links begin (and the last one's end), and the links of all."""
    press = zstandard.ZstdDecompressor()
    parts = [press.decompress(b) for b in column.to_pylist()]
    return np.cumsum([0, *(len(p) // 8 for p in parts)]), np.frombuffer(b"".join(parts), np.int64)


@lru_cache(maxsize=1)
def crosswalk(first: str, second: str) -> Crosswalk:
    return Crosswalk(first, second)


def align_lyric_tokens(tracks: DataFrame, first: str, second: str) -> DataFrame:
    """How the tokens of two tokenizers fall together in each track's lyrics, and how usual their links are.

    tracks: track_id, lyrics_text. first: a byte-level BPE file, given a space and the text; second: a sentence-piece
    model, given the text (it adds the space). Both files must lie at the same path on every machine. Where tokens of both end at the same byte, groups end and the two tokens
    are linked. Returns track_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose count in all tracks is the
    highest of their second id), count_sum (of the counts of the links) and groups_sha256 of the groups written as
    `a1,a2|b1;a3|b2,b3` (empty without tokens).

    Both tokenize the whole text. Places where a token that begins with a space begins on both sides, compared by bytes,
    cut the ids into windows; the alignment of a window is remembered by its ids. Of two tokens that end together one is
    a suffix of the other, so there are at most as many distinct links as the two vocabularies have bytes (about twice
    that where single bytes have two ids, some 600,000 for 50,000 and 32,000 ids): the table of counts that every task
    gets has that bound, whatever the corpus.

    Null and empty lyrics, and those whose tokens do not join to their bytes, have no tokens: zeros and an empty hash.
    Very long texts are tokenized in chunks cut before words, where neither tokenizer joins anything; a stretch without
    words goes whole. Rows repeat as they come; an empty table gives an empty result; other columns are ignored.
    """

    def align(batches):
        walk = crosswalk(first, second)
        press = zstandard.ZstdCompressor(level=1)
        for batch in sliced(batches, size=1 << 20):
            rows = walk.aligned(batch.column(1).to_pylist())
            n_a, n_b, hashed, links = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_a, pa.int64()),
                    pa.array(n_b, pa.int64()),
                    pa.array(hashed, pa.string()),
                    pa.array(map(press.compress, links), pa.binary()),
                ],
                ["track_id", "n_a", "n_b", "groups_sha256", "links"],
            )

    rows = tracks.select("track_id", F.coalesce("lyrics_text", F.lit("")).alias("lyrics_text"))
    kind = rows.schema["track_id"].dataType.simpleString()
    linked = written(rows.mapInArrow(align, f"track_id {kind}, n_a long, n_b long, groups_sha256 string, links binary"))

    def count(batches):
        known, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in sliced(batches, 500):
            _, links = unpacked(batch.column(0))
            known, spots = np.unique(np.concatenate([known, links]), return_inverse=True)
            weights = np.concatenate([times, np.ones(len(links), np.int64)])
            times = np.bincount(spots, weights, len(known)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(times)], ["link", "n"])

    counts = linked.select("links").mapInArrow(count, "link long, n long").groupBy("link").agg(F.sum("n").alias("n"))
    known = counts.orderBy("link").toArrow()  # bounded by the vocabularies' bytes
    link, n = (known.column(c).to_numpy() for c in ("link", "n"))
    token = link % LINK
    highest = np.zeros(int(token.max(initial=0)) + 1, np.int64)
    np.maximum.at(highest, token, n)
    best = n == highest[token]

    def weigh(batches):
        for batch in sliced(batches, 500):
            ends, links = unpacked(batch.column("links"))
            spots = np.searchsorted(link, links)
            sums = [np.append(0, np.cumsum(values[spots])) for values in (best.astype(np.int64), n)]
            size = pa.array(np.diff(ends), pa.int64())
            n_best, count_sum = (pa.array(s[ends[1:]] - s[ends[:-1]], pa.int64()) for s in sums)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("track_id", "n_a", "n_b")]
                + [size, size, n_best, count_sum, batch.column("groups_sha256")],
                ["track_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )

    return linked.mapInArrow(
        weigh,
        f"track_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string",
    )
