"""Exact positions on a rational time lattice, as BIGINT column expressions.

A lattice step is num/den positions, num = rate * 60 * scale and
den = round(bpm * scale) * subdivisions.  Rounding is half away from zero, as in
exact fractions.  ``scale`` is the bpm resolution: 1000 covers estimated tempi,
10**6 stored ones.  With scale 1000 and subdivisions <= 8 all intermediate values
stay inside BIGINT for positions below 2**40; larger ones raise under ANSI mode
instead of wrapping.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: subdivision label -> cells per beat
SUBDIVISIONS = {"1/4": 1, "1/8": 2, "1/12": 3, "1/16": 4, "1/24": 6, "1/32": 8}


def _big(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("bigint")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def round_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator to the nearest integer, ties away from zero."""
    two = F.lit(2).cast("bigint")
    size = _div(two * F.abs(numerator) + denominator, two * denominator)
    return F.when(numerator < 0, -size).otherwise(size)


@dataclass(frozen=True)
class Lattice:
    """Tempo as columns (or constants); all methods return columns."""

    rate: Column | int
    bpm: Column | float
    offset: Column | int
    subdivisions: Column | int = 4
    scale: int = 1000

    @property
    def num(self) -> Column:
        return _big(self.rate) * F.lit(60 * self.scale).cast("bigint")

    @property
    def den(self) -> Column:
        bpm = self.bpm if isinstance(self.bpm, Column) else F.lit(self.bpm)
        return F.round(bpm * F.lit(self.scale)).cast("bigint") * _big(self.subdivisions)

    def step(self) -> Column:
        """Step width as a double."""
        return self.num.cast("double") / self.den.cast("double")

    def cell(self, pos: Column) -> Column:
        """Index of the nearest cell; negative before the offset (pick-up)."""
        return round_ratio((_big(pos) - _big(self.offset)) * self.den, self.num)

    def position(self, cell: Column) -> Column:
        """Position of a cell."""
        return round_ratio(_big(self.offset) * self.den + _big(cell) * self.num, self.den)

    def nearest(self, pos: Column) -> Column:
        return self.position(self.cell(pos))

    def beat(self, beat: Column, subdivision: Column) -> Column:
        """Position of (beat, subdivision of the beat)."""
        return self.position(_big(beat) * _big(self.subdivisions) + _big(subdivision))


def position_to_seconds(pos: Column, rate: Column | int) -> Column:
    """Seconds of a position; null for a negative position or rate."""
    rate = rate if isinstance(rate, Column) else F.lit(rate)
    return F.when((pos >= 0) & (rate > 0), pos / rate)


def seconds_to_position(seconds: Column, rate: Column | int) -> Column:
    """Nearest position of a time in seconds, decimal arithmetic, half up."""
    rate = rate if isinstance(rate, Column) else F.lit(rate)
    exact = seconds.cast("decimal(20,9)") * rate.cast("decimal(10,0)")
    return F.when((seconds >= 0) & (rate > 0), F.round(exact, 0).cast("bigint"))


def remap_position(pos: Column, source: Column | int, target: Column | int) -> Column:
    """Position at another rate, integer half up."""
    source, target = _big(source), _big(target)
    two = F.lit(2).cast("bigint")
    return F.when(
        (pos >= 0) & (source > 0) & (target > 0),
        _div(two * _big(pos) * target + source, two * source),
    )


def snap_float(pos: Column, rate, bpm: Column, offset: Column, subdivisions: int = 4) -> Column:
    """Double-precision snap with half-even rounding, clamped at zero."""
    rate = rate if isinstance(rate, Column) else F.lit(rate)
    step = rate * F.lit(60.0) / (bpm * F.lit(subdivisions))
    index = F.rint((pos - offset) / step)
    snapped = F.greatest(F.rint(offset + index * step), F.lit(0.0)).cast("bigint")
    return F.when(bpm > 0, snapped).otherwise(pos)


def snap_error_ms(acoustic: Column, chart: Column, rate) -> Column:
    """Signed distance in milliseconds, positive when heard late."""
    return (acoustic - chart) * F.lit(1000.0) / rate


def grid_confidence(error_ms: Column, width_ms: float = 30.0) -> Column:
    return F.exp(F.lit(-0.5) * F.pow(F.abs(error_ms) / F.lit(width_ms), F.lit(2.0)))


def rhythm_score(distance: Column, step: Column) -> Column:
    """Closeness to the grid, 1 on a line and 1/e half a step (at least 1) away."""
    half = F.greatest(step / F.lit(2.0), F.lit(1.0))
    return F.exp(-F.pow(distance / half, F.lit(2.0)))


def line_distance(pos: Column, step: Column, offset: Column) -> Column:
    """Distance to the nearest grid line, half-even index, doubles."""
    return F.abs(pos - (offset + F.rint((pos - offset) / step) * step))


def min_grid_error(pos: Column, rate, bpm: Column, offset: Column) -> Column:
    """Distance to the closest line of the 1/8, triplet and 1/16 grids."""
    rate = rate if isinstance(rate, Column) else F.lit(rate)
    beat = rate * F.lit(60.0) / bpm
    errors = [line_distance(pos, beat / F.lit(parts), offset) for parts in (2, 3, 4)]
    return F.when(bpm > 0, F.least(*errors)).otherwise(F.lit(float("inf")))


def beat_salience(salience: Column, pos: Column, rate, bpm: Column, offset: Column,
                  width_sec: float = 0.035) -> Column:
    """Nine parts salience, one part closeness to the beat."""
    rate = rate if isinstance(rate, Column) else F.lit(rate)
    period = rate * F.lit(60.0) / bpm
    tolerance = F.greatest(rate * F.lit(width_sec), F.lit(1.0))
    distance = F.abs(F.pmod(pos - offset + period / 2, period) - period / 2)
    relation = F.exp(F.lit(-0.5) * F.pow(distance / tolerance, F.lit(2.0)))
    mixed = F.lit(0.9) * salience + F.lit(0.1) * relation
    return F.when(bpm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed))).otherwise(salience)


def musical_position(pos: Column, rate, bpm: Column, offset: Column, numerator: Column,
                     subdivisions: int = 4) -> Column:
    """bar:beat:subdivision, counted from one; clamped before the first beat."""
    rate = rate if isinstance(rate, Column) else F.lit(rate)
    beats = (pos - offset) / (rate * F.lit(60.0) / bpm)
    # half up, also for negative values
    slot = F.greatest(F.floor(beats * F.lit(subdivisions) + F.lit(0.5)), F.lit(0)).cast("bigint")
    beat = _div(slot, _big(subdivisions))
    bar = _div(beat, _big(numerator))
    text = F.format_string(
        "%d:%d:%d", bar + 1, F.pmod(beat, _big(numerator)) + 1,
        F.pmod(slot, _big(subdivisions)) + 1,
    )
    return F.when((bpm > 0) & (rate > 0), text).otherwise(F.lit("1:1:1"))


def clock(seconds: Column) -> Column:
    """m:ss.mmm; not-finite and negative times count as zero."""
    finite = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < F.lit(float("inf")))
    safe = F.when(finite, F.greatest(seconds, F.lit(0.0))).otherwise(F.lit(0.0))
    total = F.floor(safe * 1000 + F.lit(0.5)).cast("bigint")
    return F.format_string(
        "%d:%02d.%03d",
        _div(total, _big(60_000)),
        _div(F.pmod(total, _big(60_000)), _big(1000)),
        F.pmod(total, _big(1000)),
    )


def subdivision_count(label: Column) -> Column:
    """Cells per beat of a note-value label; null when unknown."""
    pairs = [F.lit(x) for pair in SUBDIVISIONS.items() for x in pair]
    return F.element_at(F.create_map(*pairs), label)
