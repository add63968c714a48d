"""URL rules by a bit-parallel wildcard automaton."""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GlobAutomaton:
    """All globs at once as Shift-And masks over 64-bit words.

    `*` stands for any bytes but `/`, `**` for any bytes. Each glob owns a start bit and one bit
    per literal byte; a wildcard makes the bit before it stay alive on the bytes it covers.
    """

    def __init__(self, globs: list[str]):
        items = [self._parse(g) for g in globs]
        n_bits = sum(len(literals) + 1 for literals, _ in items)
        self.words = max(1, -(-n_bits // 64))
        take = np.zeros((256, self.words), np.uint64)
        stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        bit = 0
        for literals, loops in items:
            self._set(self.start, bit)
            for i in range(len(literals) + 1):
                if i:
                    self._set(take[literals[i - 1]], bit + i)
                for byte in loops.get(i, ()):
                    self._set(stay[byte], bit + i)
            bit += len(literals)
            self.final.append((bit // 64, np.uint64(1 << bit % 64)))
            bit += 1
        self.take, self.stay = take, stay

    @staticmethod
    def _set(words: np.ndarray, bit: int) -> None:
        words[bit // 64] |= np.uint64(1 << bit % 64)

    @staticmethod
    def _parse(glob: str) -> tuple[bytes, dict[int, list[int]]]:
        raw, literals, loops = glob.encode(), bytearray(), {}
        i = 0
        while i < len(raw):
            if raw[i : i + 2] == b"**":
                loops[len(literals)] = list(range(256))
                i += 2
            elif raw[i : i + 1] == b"*":
                loops.setdefault(len(literals), [b for b in range(256) if b != 0x2F])
                i += 1
            else:
                literals.append(raw[i])
                i += 1
        return bytes(literals), loops

    def matches(self, subjects: list[bytes]) -> np.ndarray:
        """Boolean matrix: subject x glob. All subjects take a step together, long ones last."""
        lengths = np.fromiter(map(len, subjects), np.int64, len(subjects))
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(subjects) or b"\0", np.uint8)
        at = (np.cumsum(lengths) - lengths)[order]
        left = lengths[order]
        state = np.repeat(self.start[None, :], len(subjects), axis=0)
        active = len(subjects)
        for step in range(int(left[0]) if len(subjects) else 0):
            while active and left[active - 1] <= step:
                active -= 1
            byte = data[at[:active] + step]
            now = state[:active]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:active] = moved & self.take[byte] | now & self.stay[byte]
        found = np.empty((len(subjects), len(self.final)), bool)
        for g, (word, bit) in enumerate(self.final):
            found[order, g] = (state[:, word] & bit) != 0
        return found


def judge_cover_urls(
    projects: DataFrame,
    rules: list[tuple[str, str]],
    blocked_globs: list[str] = (),
) -> DataFrame:
    """Rule and verdict for each project's cover URL.

    projects: project_id, cover_url. rules: (verdict, "host/path"); a rule fits its host and all
    subdomains if the path starts with the rule's, and the longest fitting rule wins (the first
    given one of equals). blocked_globs: globs over "host/path" that block what no rule fits,
    `*` within host or path segment, `**` anywhere; everything else is allowed. Returns
    project_id, host, path, rule (null where none fits), verdict, glob (the first that blocked).

    Host: between the first "://" and "/", "?", "#" or the end, A-Z in lower case; path: from
    there to "?", "#" or the end. A null URL or one without "://" has an empty host and path and
    fits no rule. Rows repeat as they come; an empty table gives an empty result; other columns
    are ignored. One pass, no shuffle.
    """
    ranked = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1]), i))
    names = [rules[i][1] for i in ranked]
    verdicts = [rules[i][0] for i in ranked]
    patterns = [f"*.{name}**" for name in names] + [f".{glob}" for glob in blocked_globs]
    globs = list(blocked_globs)

    def judge(batches):
        automaton = GlobAutomaton(patterns)
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            subjects = [f".{h}{p}".encode() for h, p in zip(hosts, paths)]
            found = automaton.matches(subjects)
            by_rule, by_glob = found[:, : len(names)], found[:, len(names) :]
            first = np.where(by_rule.any(1), by_rule.argmax(1), -1) if names else np.full(len(hosts), -1)
            bad = np.where(by_glob.any(1), by_glob.argmax(1), -1) if globs else np.full(len(hosts), -1)
            rule = [names[i] if i >= 0 else None for i in first]
            glob = [globs[j] if i < 0 and j >= 0 else None for i, j in zip(first, bad)]
            verdict = [verdicts[i] if i >= 0 else "block" if j >= 0 else "allow" for i, j in zip(first, bad)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2)]
                + [pa.array(x, pa.string()) for x in (rule, verdict, glob)],
                ["project_id", "host", "path", "rule", "verdict", "glob"],
            )

    url = F.coalesce("cover_url", F.lit(""))
    host = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    parts = projects.select(
        "project_id", host.alias("host"), F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1).alias("path")
    )
    kind = parts.schema["project_id"].dataType.simpleString()
    return parts.mapInArrow(
        judge, f"project_id {kind}, host string, path string, rule string, verdict string, glob string"
    )
