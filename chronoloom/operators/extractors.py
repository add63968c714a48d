"""Pluggable scorers and extractors that cannot fail a job.

An extractor is a function over a pandas batch with a fixed output schema.  Every
result row says whether it worked: ``status`` (ok, failed, unavailable), ``error``
and ``warnings``.  A batch that raises is tried again row by row, so one bad row
costs only itself; an extractor that is not available hands over to its fallback.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

STATUS_COLUMNS = "status string, error string, warnings array<string>"


class ExtractionError(RuntimeError):
    """A structured failure: a stable code and a message."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Extractor:
    """``run`` maps a batch to a frame with the key columns and ``schema`` (DDL)."""

    name: str
    run: Callable[[pd.DataFrame], pd.DataFrame]
    schema: str
    available: Callable[[], str | None] = field(default=lambda: None)
    """None when usable, otherwise the reason why not; asked on the executor."""


REGISTRY: dict[str, Extractor] = {}


def register_extractor(extractor: Extractor) -> Extractor:
    REGISTRY[extractor.name] = extractor
    return extractor


def extract(df: DataFrame, name: str, keys: list[str], fallback: str | None = None) -> DataFrame:
    """Run an extractor over all rows; both extractors must share one schema."""
    chosen = REGISTRY[name]
    spare = REGISTRY[fallback] if fallback else None
    if spare is not None and spare.schema != chosen.schema:
        raise ValueError("an extractor and its fallback need the same schema")
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    ddl = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", {chosen.schema}, {STATUS_COLUMNS}"
    columns = [c.strip().split()[0] for c in chosen.schema.split(",")]

    def marked(out: pd.DataFrame, status: str, error, warnings: list[str]) -> pd.DataFrame:
        out["status"], out["error"] = status, error
        out["warnings"] = [warnings] * len(out)
        return out

    def failed(pdf: pd.DataFrame, status: str, error, warnings: list[str]) -> pd.DataFrame:
        out = pdf[keys].copy()
        for c in columns:
            out[c] = None
        return marked(out, status, error, warnings)

    def halved(worker, pdf: pd.DataFrame, warnings: list[str]) -> Iterator[pd.DataFrame]:
        """The whole batch, or its halves where it fails, down to single failing rows.

        Where more than a third of the rows so far fail by themselves, a failing part is not halved but tried row by
        row, which is fewer calls. Results are marked and handed on once per batch, not once per part.
        """
        done: dict[tuple, list[pd.DataFrame]] = {}  # by column types, which may differ from part to part
        bad, errors, good = [], [], 0
        open_parts = [(0, len(pdf))]
        while open_parts:
            a, b = open_parts.pop()
            try:
                out = worker.run(pdf.iloc[a:b])[[*keys, *columns]]
                done.setdefault(tuple(out.dtypes), []).append(out)
                good += b - a
            except Exception as problem:  # noqa: BLE001 - reported in the row
                if b - a == 1:
                    bad.append(a)
                    errors.append(str(problem))
                elif 2 * len(bad) > good:
                    open_parts += [(i, i + 1) for i in reversed(range(a, b))]
                else:
                    middle = (a + b) // 2
                    open_parts += [(middle, b), (a, middle)]
        for parts in done.values():
            yield marked(pd.concat(parts, ignore_index=True), "ok", None, warnings)
        if bad:
            yield failed(pdf.iloc[bad], "failed", errors, warnings)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker, warnings = chosen, []
        reason = worker.available()
        if reason is not None and spare is not None:
            warnings = [f"{worker.name} is not available ({reason}); {spare.name} was used"]
            worker, reason = spare, spare.available()
        for pdf in batches:
            if not len(pdf):
                continue
            if reason is not None:
                yield failed(pdf, "unavailable", reason, warnings)
                continue
            yield from halved(worker, pdf, warnings)

    return df.mapInPandas(run, ddl)
