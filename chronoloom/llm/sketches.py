"""Bottom-k sketches of shingle hashes."""

from __future__ import annotations

import numpy as np

SPAN = np.uint64(0x9E3779B97F4A7C15)  # odd multipliers of a mixing hash
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
TOP = 1 << 32


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, width: int, block: int = 1 << 20):
    """32-bit hashes of all runs of `width` code points, block by block; a shorter text is one run."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(points):
        return
    size = min(width, len(points))
    for at in range(0, len(points) - size + 1, block):
        part = points[at : at + block + size - 1].astype(np.uint64)
        n = len(part) - size + 1
        value = np.zeros(n, np.uint64)
        for i in range(size):
            value = value * SPAN + part[i : i + n]
        yield (_mixed(value + np.uint64(size)) >> np.uint64(32)).astype(np.uint32)


def _lowest(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distinct values, in order."""
    reach = 2 * k
    while reach < len(hashes):
        head = np.unique(np.partition(hashes, reach)[:reach])
        if len(head) >= k:
            return head[:k]
        reach *= 4
    return np.unique(hashes)[:k]


class Sketch:
    """The k smallest distinct shingle hashes of a text, or of the union of several parts."""

    def __init__(self, k: int, hashes: np.ndarray | None = None):
        self.k = k
        self.hashes = np.zeros(0, np.uint32) if hashes is None else hashes

    @classmethod
    def of(cls, text: str, k: int, width: int) -> Sketch:
        sketch = cls(k)
        for hashes in shingle_hashes(text, width):
            sketch = sketch.merged(cls(k, _lowest(hashes, k)))
        return sketch

    def merged(self, other: Sketch) -> Sketch:
        """Sketch of both parts together."""
        if not len(self.hashes) or not len(other.hashes):
            return self if len(self.hashes) else other
        return Sketch(self.k, np.union1d(self.hashes, other.hashes)[: self.k])

    def distinct(self) -> float:
        """Estimated number of distinct shingles; exact below k."""
        if len(self.hashes) < self.k:
            return float(len(self.hashes))
        return (self.k - 1) * TOP / (float(self.hashes[-1]) + 1)

    def resemblance(self, other: Sketch) -> float:
        """Estimated share of common shingles among all of both; two empty texts are alike."""
        union = self.merged(other).hashes
        if not len(union):
            return 1.0
        both = np.intersect1d(self.hashes, other.hashes, assume_unique=True)
        return float(np.isin(union, both, assume_unique=True).sum() / len(union))

    def containment(self, other: Sketch) -> float:
        """Estimated share of this text's shingles that the other one has, too."""
        own = self.distinct()
        if not own:
            return 1.0
        common = self.resemblance(other) * self.merged(other).distinct()
        return min(1.0, common / own)

    def text(self) -> str:
        """Eight hexadecimal digits per hash."""
        return self.hashes.astype(">u4").tobytes().hex()

    @classmethod
    def read(cls, text: str, k: int) -> Sketch:
        return cls(k, np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32))
