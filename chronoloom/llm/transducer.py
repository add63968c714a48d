"""Deterministic transducers of a byte-level BPE tokenizer, with emitted-token counts.

Two machines in cascade. `Splitter` walks code points and marks where a pre-token starts; its
few states make whole chunk state maps cheap, so all chunks run side by side and a prefix scan
of the maps gives the entry state of each. `Counter` walks the bytes of one pre-token; each
transition says how many tokens it adds or takes back. Its states are made when first met.
"""

from __future__ import annotations

import json

import numpy as np
import regex

LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, LAST, MIDDLE, END = range(9)
START, LETTERS, NUMBERS, OTHERS, PREFIX, BLANK, ONE_LEFT, TWO_LEFT = range(8)
CUT = regex.compile(r"\S \S")
BREAK = 8  # added to a state where the read symbol starts a pre-token


def _splitter_table() -> np.ndarray:
    """Next state for (state, symbol), plus BREAK where the symbol starts a pre-token."""
    table = np.zeros((8, 9), np.uint8)
    for state in range(8):
        for symbol, run in ((LETTER, LETTERS), (NUMBER, NUMBERS), (OTHER, OTHERS)):
            table[state, symbol] = run if state in (run, PREFIX) else run + BREAK
        for symbol, left in ((SHORT, ONE_LEFT), (LONG, TWO_LEFT)):
            table[state, symbol] = OTHERS if state in (OTHERS, PREFIX) else left + BREAK
        table[state, SPACE] = PREFIX + BREAK
        table[state, LAST] = START + BREAK
        table[state, MIDDLE] = BLANK if state == BLANK else BLANK + BREAK
        table[state, END] = START + BREAK
    table[ONE_LEFT, :END] = START
    table[TWO_LEFT, :END] = ONE_LEFT
    return table.ravel()


class Splitter:
    """Pre-token starts of many texts at once.

    Texts are laid end to end, each closed by an END symbol, and cut into equal chunks. Every
    chunk is run from all states until the states agree; the maps are composed by a doubling
    prefix scan; a second run from the entry states marks the starts.
    """

    def __init__(self, chunk: int = 512):
        points = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        self.chunk = chunk
        self.kinds = np.full(0x110000, OTHER, np.uint8)
        for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", MIDDLE)):
            self.kinds[[ord(c) for c in regex.findall(pattern, points)]] = kind
        self.full = _splitter_table()
        self.states = self.full & 7

    def symbols(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Symbols that carry what the rules look ahead for: ends of white space, contractions."""
        kinds = self.kinds[points]
        kinds[ends] = END
        after = np.append(kinds[1:], END)
        last = (kinds == MIDDLE) & (after != MIDDLE) & (after != END)
        kinds[last & (points == 0x20)] = SPACE
        kinds[last & (points != 0x20)] = LAST
        quote = np.flatnonzero(points == 0x27)
        quote = quote[kinds[quote] == OTHER]
        ahead = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = ahead[quote + 1], ahead[quote + 2]
        kinds[quote[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        for a, b in ("re", "ve", "ll"):
            kinds[quote[(one == ord(a)) & (two == ord(b))]] = LONG
        return kinds

    def starts(self, symbols: np.ndarray) -> np.ndarray:
        """Positions that start a pre-token or close a text."""
        n = -(-len(symbols) // self.chunk)
        lanes = np.full(n * self.chunk, END, np.uint8)
        lanes[: len(symbols)] = symbols
        lanes = np.ascontiguousarray(lanes.reshape(n, self.chunk).T)
        entry = self._entries(lanes)
        marks = np.empty(lanes.shape, bool)
        for i, column in enumerate(lanes):
            read = self.full[entry * 9 + column]
            marks[i] = read >= BREAK
            entry = (read & 7).astype(np.intp)
        return np.flatnonzero(marks.T.ravel()[: len(symbols)])

    def _entries(self, lanes: np.ndarray) -> np.ndarray:
        """Entry state of each chunk: an exclusive prefix scan over the composed state maps."""
        chunk, n = lanes.shape
        maps = np.repeat(np.arange(8)[:, None], n, axis=1)
        at = 0
        while at < chunk and (maps != maps[0]).any():
            maps = self.states[maps * 9 + lanes[at]].astype(np.intp)
            at += 1
        if at < chunk:  # the chunks have forgotten where they began
            state = maps[0]
            for column in lanes[at:]:
                state = self.states[state * 9 + column].astype(np.intp)
            maps = np.repeat(state[None, :], 8, axis=0)
        step = 1
        while step < n:
            joined = maps.copy()
            joined[:, step:] = np.take_along_axis(maps[:, step:], maps[:, :-step], axis=0)
            maps, step = joined, step * 2
        return np.concatenate([[START], maps[START, :-1]])


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that vocabulary files use for bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """Token counts of pre-tokens by a transducer over bytes, made state by state.

    After each byte the encoding of what was read ends in one token. A state keeps, for every
    suffix that a longer token could still cover, the last token before that suffix and the
    number of tokens since. That decides the next last token: the one that forms a pair the
    merges would leave apart.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list, room: int = 1_000_000):
        chars = _byte_of_char()
        spell = lambda token: bytes(chars[c] for c in token)
        self.room = room
        self.trie: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        self.inner: set[int] = set()
        nodes = 1
        for token, number in vocabulary.items():
            if any(c not in chars for c in token):
                continue  # a special token
            node = 0
            for byte in spell(token):
                key = node << 8 | byte
                if key not in self.trie:
                    self.trie[key] = nodes
                    nodes += 1
                self.inner.add(node)
                node = self.trie[key]
            self.token_at[node] = number
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(merges):
            left, right = pair if isinstance(pair, (list, tuple)) else pair.split(" ")
            a, b, whole = vocabulary[left], vocabulary[right], vocabulary[left + right]
            self.rank[a, b] = rank
            made.setdefault(whole, (rank, a, b))
        never = len(self.rank)
        self.right: dict[int, list] = {}
        self.left: dict[int, list] = {}
        for number in self.token_at.values():
            for side, spines in ((2, self.right), (1, self.left)):
                spine, until, part = [], never, number
                while part in made:
                    spine.append((part, made[part][0], until))
                    until, part = made[part][0], made[part][side]
                spine.append((part, -1, until))
                spines[number] = spine
        self._forget()

    def _forget(self) -> None:
        self.counts: dict[str, int] = {}
        self.steps: dict[int, tuple[int, int]] = {}
        self.states: list[tuple] = [((0, -1, 0),)]
        self.numbers: dict[tuple, int] = {self.states[0]: 0}
        self.apart: dict[int, bool] = {}

    def _pair_stays(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b together leaves exactly a, b.

        A token of a's right edge lives from its own merge to that of the token around it; the
        same holds for b's left edge. Two that live together merge if a merge of theirs comes up
        meanwhile. Of equal merges the leftmost goes first.
        """
        key = a << 20 | b
        known = self.apart.get(key)
        if known is None:
            known = True
            for x, born_x, until_x in self.right[a]:
                for y, born_y, until_y in self.left[b]:
                    rank = self.rank.get((x, y))
                    if rank is not None and born_x < rank < until_x and born_y < rank <= until_y:
                        known = False
                        break
                if not known:
                    break
            self.apart[key] = known
        return known

    def _step(self, key: int) -> tuple[int, int]:
        """Next state and emitted tokens for state << 8 | byte."""
        state, byte = self.states[key >> 8], key & 255
        last = emitted = None
        kept = []
        for node, before, since in state:
            child = self.trie.get(node << 8 | byte)
            if child is None:
                continue
            if child in self.inner:
                kept.append((child, before, since))
            token = self.token_at.get(child)
            if last is None and token is not None and (before < 0 or self._pair_stays(before, token)):
                last, emitted = token, 1 - since
        reached = (*((n, b, s + emitted) for n, b, s in kept), (0, last, 0))
        number = self.numbers.setdefault(reached, len(self.states))
        if number == len(self.states):
            self.states.append(reached)
        self.steps[key] = number, emitted
        return number, emitted

    def count(self, word: str) -> int:
        """Tokens of one pre-token."""
        known = self.counts.get(word)
        if known is None:
            if len(self.counts) + len(self.steps) > self.room:
                self._forget()
            steps, state, known = self.steps, 0, 0
            for byte in word.encode():
                key = state << 8 | byte
                step = steps.get(key) or self._step(key)
                state = step[0]
                known += step[1]
            self.counts[word] = known
        return known


class Machine:
    """Token counts of texts; special strings are split off first, each is one token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec["added_tokens"]]
        merges = spec["model"]["merges"]
        self.counter = Counter(spec["model"]["vocab"], merges)
        self.splitter = Splitter()
        self.between = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def counts(self, texts: list[str], at_once: int = 1 << 21) -> np.ndarray:
        """Tokens of each text. Long texts are cut before a single space between other
        characters, where a pre-token starts whatever came before."""
        total = np.zeros(len(texts), np.int64)
        pieces, owner, held = [], [], 0
        for i, text in enumerate(texts):
            parts = self.between.split(text) if self.between else [text]
            total[i] = len(parts) - 1
            for part in parts:
                while part:
                    cut = CUT.search(part, at_once) if len(part) > at_once else None
                    piece, part = (part[: cut.start() + 1], part[cut.start() + 1 :]) if cut else (part, "")
                    if held and held + len(piece) > at_once:
                        np.add.at(total, owner, self._emitted(pieces))
                        pieces, owner, held = [], [], 0
                    pieces.append(piece)
                    owner.append(i)
                    held += len(piece)
        if pieces:
            np.add.at(total, owner, self._emitted(pieces))
        return total

    def _emitted(self, pieces: list[str]) -> np.ndarray:
        joined = "\0".join(pieces) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        starts = self.splitter.starts(self.splitter.symbols(points, ends))
        bounds = starts.tolist()
        count = self.counter.count
        known = self.counter.counts
        emitted = np.fromiter(
            (known.get(w) or count(w) for w in map(joined.__getitem__, map(slice, bounds, bounds[1:]))),
            np.int64,
            len(bounds) - 1,
        )
        emitted = np.append(emitted, 0)
        is_end = np.zeros(len(points), bool)
        is_end[ends] = True
        emitted[is_end[starts]] = 0
        total = np.concatenate([[0], np.cumsum(emitted)])
        until = total[np.searchsorted(starts, ends)]
        return np.diff(until, prepend=0)
