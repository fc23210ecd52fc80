"""Repair of dates that run backwards along a branch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revloom.operators.shared import dealt


class Repair:
    """Fed a branch's revisions newest first; gives them out with dates in order.

    A parent newer than its child is pulled back to it, unless it is not newer than the
    grandchild: then the child is the odd one out and moves up to its parent.
    """

    def __init__(self):
        self.child = self.date = self.grandchild = None

    def feed(self, row, date: int) -> Iterator[tuple]:
        if self.child is not None:
            if date > self.date:
                if self.grandchild is not None and date <= self.grandchild:
                    self.date = date
                else:
                    date = self.date
            yield self.child, self.date
            self.grandchild = self.date
        self.child, self.date = row, date

    def finish(self) -> Iterator[tuple]:
        if self.child is not None:
            yield self.child, self.date


def repaired_dates(rows: DataFrame, keys: list[str], order: str, date: str = "t") -> DataFrame:
    """Adds ``repaired`` to (keys, order, date).  Each date depends on the repaired ones after
    it, so a branch streams through one task, in constant memory."""
    names = [*keys, order, date]
    schema = ", ".join(f"{n} {dict(rows.dtypes)[n]}" for n in names) + ", repaired long"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, state, out = None, Repair(), []
        for pdf in batches:
            for row in zip(*[pdf[n] for n in names], strict=True):
                if row[: len(keys)] != group:
                    out += [(*r, d) for r, d in state.finish()]
                    group, state = row[: len(keys)], Repair()
                out += [(*r, d) for r, d in state.feed(row, row[-1])]
            yield pd.DataFrame(out, columns=[*names, "repaired"])
            out = []
        yield pd.DataFrame([(*r, d) for r, d in state.finish()], columns=[*names, "repaired"])

    placed = dealt(rows.select(*names), keys).sortWithinPartitions(*keys, F.desc(order))
    return placed.mapInPandas(fold, schema)
