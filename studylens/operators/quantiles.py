"""Exact quantiles of large columns.

``median`` and ``percentile`` keep every distinct value in one task. Here a bounded
sketch cuts the column into cells, the cells around the wanted ranks become the next
bracket, and the search goes on inside it until few distinct values are left to count.
Each round reads the columns once and returns one row; no task and no driver holds more
than about VALUE_LIMIT values.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VALUE_LIMIT = 50_000
SKETCH_ACCURACY = 10_000
CELLS = 256
MAX_ROUNDS = 60


@dataclass
class _Search:
    """Looks for the values at the 0-based ranks ``first`` and ``last`` of one column."""

    column: str
    share: float
    bracket: tuple[float, float] | None = None
    outer: tuple[float, float] | None = None  # the bracket before, known to hold both ranks
    margin: int = 1  # cells kept on either side
    rows: int | None = None
    first: int = 0
    last: int = 0
    below: int = 0  # rows under the bracket
    few: bool = False  # whether its distinct values may be counted
    many: bool = False  # whether the whole column has more than that
    answer: float | None = None
    done: bool = False

    def inside(self) -> str:
        value = f"`{self.column}`"
        if self.bracket is None:
            return f"{value} IS NOT NULL"
        low, high = self.bracket
        return f"{value} BETWEEN {low!r}D AND {high!r}D"

    def measures(self, i: int) -> list[str]:
        value, own = f"`{self.column}`", f"FILTER (WHERE {self.inside()})"
        below = "0L" if self.bracket is None else f"count_if({value} < {self.bracket[0]!r}D)"
        shares = ", ".join(f"{c / CELLS!r}D" for c in range(CELLS + 1))
        cuts = f"percentile_approx({value}, array({shares}), {SKETCH_ACCURACY}) {own}"
        return [
            f"count(1) {own} AS inside{i}",
            f"{below} AS below{i}",
            f"approx_count_distinct({value}) {own} AS distinct{i}",
            # Columns with few values never need the sketch, so the first round goes without.
            f"{cuts if self.many else 'CAST(NULL AS ARRAY<DOUBLE>)'} AS cuts{i}",
        ]

    def narrow(self, inside: int, below: int, distinct: int, cuts: list[float] | None) -> None:
        """Takes in one measurement: count now, or go on in a tighter bracket."""
        if self.rows is None:
            position = (inside - 1) * self.share
            self.rows, self.first, self.last = inside, math.floor(position), math.ceil(position)
            self.done = inside == 0
            if self.done:
                return
        if not below <= self.first <= self.last < below + inside:
            # The sketch missed a rank, which its error bound all but excludes: take a wider bracket.
            self.bracket, self.margin, self.few = self.outer, self.margin * 4, False
            return
        self.below, self.few = below, distinct <= VALUE_LIMIT
        if not self.few and not self.many:
            self.many = True
        elif not self.few:
            start = math.floor((self.first - below) / inside * CELLS) - self.margin
            end = math.ceil((self.last + 1 - below) / inside * CELLS) + self.margin
            self.outer, self.bracket = self.bracket, (cuts[max(0, start)], cuts[min(CELLS, end)])

    def pick(self, values: list[tuple[float, int]]) -> None:
        """Reads the answer off the (value, count) pairs of the bracket."""
        reached, at = self.below, {}
        for value, count in sorted(values):
            for rank in (self.first, self.last):
                if reached <= rank < reached + count:
                    at[rank] = value
            reached += count
        low, high = at[self.first], at[self.last]
        self.answer = low + (high - low) * ((self.rows - 1) * self.share - self.first)
        self.done = True


def finite(column: str) -> str:
    """A column as double, null where it holds no finite number."""
    value = f"CAST(`{column}` AS DOUBLE)"
    return f"CASE WHEN abs({value}) < double('Infinity') THEN {value} END"


def exact_quantiles(df: DataFrame, shares: Mapping[str, float]) -> tuple[dict[str, float | None], int]:
    """({column: quantile}, number of rows); a column without values gives None. Null, NaN and infinite values are ignored.

    Quantiles between two values are interpolated linearly. Nothing is approximate: the
    sketch only says where to look, and every bracket is checked by exact counts.
    """
    doubles = df.selectExpr(*[f"{finite(c)} AS `{c}`" for c in shares])
    searches = [_Search(c, p) for c, p in shares.items()]
    total = 0
    for _ in range(MAX_ROUNDS):
        searching = [s for s in searches if not s.done]
        if not searching:
            return {s.column: s.answer for s in searches}, total
        measures = [m for i, s in enumerate(searching) for m in s.measures(i)]
        row = doubles.selectExpr("count(1) AS total", *measures).first()
        total = row["total"]
        for i, s in enumerate(searching):
            s.narrow(row[f"inside{i}"], row[f"below{i}"], row[f"distinct{i}"], row[f"cuts{i}"])
        _count_values(doubles, [s for s in searching if s.few and not s.done])
    raise RuntimeError(f"the quantile search over {list(shares)} does not narrow down")


def _count_values(df: DataFrame, searches: list[_Search]) -> None:
    if not searches:
        return
    pairs = ", ".join(
        f"named_struct('s', {i}, 'v', CASE WHEN {s.inside()} THEN `{s.column}` END)" for i, s in enumerate(searches)
    )
    values = df.selectExpr(f"inline(array({pairs}))").filter("v IS NOT NULL")
    counts = values.groupBy("s", "v").agg(F.count(F.lit(1)).alias("n"))
    # The estimate of distinct values errs by a few percent; twice its limit is never reached.
    rows = counts.limit(2 * VALUE_LIMIT * len(searches) + 1).collect()
    if len(rows) > 2 * VALUE_LIMIT * len(searches):
        raise RuntimeError("more distinct values than estimated")
    for i, s in enumerate(searches):
        s.pick([(r["v"], r["n"]) for r in rows if r["s"] == i])
