"""A hidden Markov language model of lyrics."""

from __future__ import annotations

import numpy as np

LONGEST = 2048  # training windows; scoring runs over whole sequences


class Model:
    """start (K), move (K x K) and emit (slots x K) probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, states: int, share: np.ndarray, seed: int = 7) -> Model:
        """States that stay, and emissions of the corpus shares under a fixed random tilt."""
        tilt = np.exp(np.random.default_rng(seed).normal(0.0, 1.0, (len(share), states)))
        emit = share[:, None] * tilt
        move = np.full((states, states), 0.05 / max(1, states - 1))
        np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))

    @classmethod
    def fitted(cls, starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, share: np.ndarray) -> Model:
        """Maximisation step. Every state also sees a pseudo-count of each slot's corpus share,
        so nothing becomes impossible."""
        states = len(starts)
        emit = emits + 1000.0 * share[:, None]
        move = moves + 1.0
        start = starts + 1.0
        assert emit.shape[1] == states
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _side_by_side(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences as lanes, longest first: order, lanes active per step, symbols step by step."""
    lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths[order[0]]) if len(sequences) else 0
    ended = np.bincount(lengths, minlength=longest + 1)
    active = len(sequences) - np.cumsum(ended)[:longest]
    data = np.concatenate(sequences) if len(sequences) else np.zeros(0, np.uint16)
    at = (np.cumsum(lengths) - lengths)[order]
    step = np.repeat(np.arange(longest), active)
    lane = np.arange(len(data)) - np.repeat(np.cumsum(active) - active, active)
    return order, active, data[at[lane] + step]


def log10_likelihood(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Exact log10 probability of each sequence by the scaled forward recursion."""
    order, active, symbols = _side_by_side(sequences)
    total = np.zeros(len(sequences))
    alpha, at = None, 0
    for n in active.tolist():
        seen = model.emit[symbols[at : at + n]]
        at += n
        alpha = model.start * seen if alpha is None else (alpha[:n] @ model.move) * seen
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        total[:n] += np.log10(scale)
    result = np.empty(len(sequences))
    result[order] = total
    return result


def expected_counts(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch expectation: starts, moves and emissions summed over the sequences."""
    states = len(model.start)
    starts, moves = np.zeros(states), np.zeros((states, states))
    emits = np.zeros((len(model.emit), states))
    _, active, symbols = _side_by_side(sequences)
    if not len(symbols):
        return starts, moves, emits
    bounds = np.concatenate([[0], np.cumsum(active)]).tolist()
    seen = model.emit[symbols]
    alpha, scale = np.empty_like(seen), np.empty(len(symbols))
    for t in range(len(active)):
        a, b = bounds[t], bounds[t + 1]
        now = model.start * seen[a:b] if t == 0 else (alpha[bounds[t - 1] : bounds[t - 1] + b - a] @ model.move) * seen[a:b]
        scale[a:b] = now.sum(1)
        alpha[a:b] = now / scale[a:b, None]
    beta = np.ones((int(active[0]), states))
    gamma = np.empty_like(seen)
    for t in range(len(active) - 1, -1, -1):
        a, b = bounds[t], bounds[t + 1]
        gamma[a:b] = alpha[a:b] * beta[: b - a]
        ahead = beta[: b - a] * seen[a:b] / scale[a:b, None]
        if t:
            moves += alpha[bounds[t - 1] : bounds[t - 1] + b - a].T @ ahead
            beta[: b - a] = ahead @ model.move.T
        else:
            starts += gamma[a:b].sum(0)
    moves *= model.move
    for k in range(states):
        emits[:, k] = np.bincount(symbols, gamma[:, k], len(emits))
    return starts, moves, emits


def windows(sequence: np.ndarray) -> list[np.ndarray]:
    return [sequence[i : i + LONGEST] for i in range(0, len(sequence), LONGEST)]


def grouped(sequences: list[np.ndarray], tokens: int = 1 << 19):
    """Sequences of like length together, about `tokens` symbols at a time."""
    batch, held = [], 0
    for sequence in sorted(sequences, key=len):
        batch.append(sequence)
        held += len(sequence)
        if held >= tokens:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch
