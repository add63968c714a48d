"""Places of token sequences on a Hilbert curve."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (n x d), each coordinate below 2**bits.

    The Gray-code walk is undone from the highest bit down: a set bit mirrors the lower part of
    the first axis, a clear one swaps it with the current axis; then axes are chained.
    """
    axes = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    one = np.uint64(1)
    for bit in range(bits - 1, 0, -1):
        low = np.uint64((1 << bit) - 1)
        for i in range(len(axes)):
            high = (axes[i] >> np.uint64(bit)) & one == one
            swap = (axes[0] ^ axes[i]) & low
            axes[0] = np.where(high, axes[0] ^ low, axes[0] ^ swap)
            if i:
                axes[i] = np.where(high, axes[i], axes[i] ^ swap)
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros_like(axes[0])
    for bit in range(bits - 1, 0, -1):
        set_ = (axes[-1] >> np.uint64(bit)) & one == one
        turn = np.where(set_, turn ^ np.uint64((1 << bit) - 1), turn)
    axes = [a ^ turn for a in axes]
    key = np.zeros_like(axes[0])
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << one | (axis >> np.uint64(bit)) & one
    return key.astype(np.int64)


class Projection:
    """Token sequences to few dimensions: a fixed random sign-like vector per token, rarer
    (higher) ids weigh more, scaled to the unit normal and cut into equal-probability cells."""

    def __init__(self, vocabulary: int, dimensions: int = 4, bits: int = 8, seed: int = 11):
        self.bits = bits
        weight = np.log1p(np.arange(vocabulary))
        self.table = np.random.default_rng(seed).standard_normal((vocabulary, dimensions)) * weight[:, None]
        self.square = weight**2

    def keys(self, sequences: list[np.ndarray]) -> np.ndarray:
        size = len(sequences), self.table.shape[1]
        vectors = np.zeros(size)
        for i, ids in enumerate(sequences):
            distinct = np.unique(ids)
            vectors[i] = self.table[distinct].sum(0) / np.sqrt(max(self.square[distinct].sum(), 1e-9))
        share = 1 / (1 + np.exp(-1.702 * vectors))  # close to the normal distribution function
        cells = np.minimum((share * (1 << self.bits)).astype(np.int64), (1 << self.bits) - 1)
        return hilbert_keys(cells, self.bits)
