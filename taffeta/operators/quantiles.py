"""Exact order statistics without a sort and without a map of values.

Several ranks of several columns narrow down together. Each step is two aggregates over the columns: a
sketch of bounded size names two values of the data about each wanted rank, then exact counts below and
at them tell which open interval, or which of the two values, holds it. A step leaves about one part in
``ACCURACY / 4`` of an interval's rows, however its values are spread; a value of many copies is met as
one of the two. What is left below ``FEW`` rows is collected and sorted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000
FEW = 1000


@dataclass
class _Wanted:
    """A rank of a column, and the open interval that its value lies in: ``before`` values up to ``low``,
    ``upto`` below ``high``."""

    column: str
    rank: int
    before: int
    upto: int
    low: float | None = None
    high: float | None = None
    found: float | None = None
    pair: tuple = ()

    @property
    def rows(self) -> int:
        return self.upto - self.before

    def shares(self) -> list[float]:
        at, margin = (self.rank - self.before + 1) / self.rows, 2 / ACCURACY
        return [max(0.0, at - margin), min(1.0, at + margin)]

    def narrow(self, less: dict, most: dict) -> None:
        (a, b), c = self.pair, self.column
        if self.rank < less[c, a]:
            self.high, self.upto = a, less[c, a]
        elif self.rank < most[c, a]:
            self.found = a
        elif self.rank < less[c, b]:
            self.low, self.before, self.high, self.upto = a, most[c, a], b, less[c, b]
        elif self.rank < most[c, b]:
            self.found = b
        else:
            self.low, self.before = b, most[c, b]


def _look(group: list[_Wanted]) -> Column:
    """The values about the ranks of one interval, or all its values if they are few."""
    of = group[0]
    v = F.col(of.column)
    inside = v.isNotNull()
    if of.low is not None:
        inside = inside & (v > F.lit(of.low))
    if of.high is not None:
        inside = inside & (v < F.lit(of.high))
    held = F.when(inside, v)
    if of.rows <= FEW:
        return F.array_sort(F.collect_list(held))
    return F.percentile_approx(held, [p for w in group for p in w.shares()], ACCURACY)


def order_statistics(df: DataFrame, counts: dict[str, int], ranks: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """The values at the given ranks (from 0) of each column's values that are not null; ``counts`` says how
    many those are. ``df`` is read a few times: store it first if it is costly."""
    wanted = {(c, r): _Wanted(c, r, 0, counts[c]) for c, rs in ranks.items() for r in rs if r < counts[c]}
    while todo := [w for w in wanted.values() if w.found is None]:
        groups: dict[tuple, list[_Wanted]] = {}
        for w in todo:
            groups.setdefault((w.column, w.low, w.high), []).append(w)
        seen = df.agg(*[_look(g).alias(f"_{i}") for i, g in enumerate(groups.values())]).first()
        for group, values in zip(groups.values(), seen):
            for i, w in enumerate(group):
                if w.rows <= FEW:
                    w.found = values[w.rank - w.before]
                else:
                    w.pair = (values[2 * i], values[2 * i + 1])
        todo = [w for w in todo if w.found is None]
        if todo:
            values = sorted({(w.column, x) for w in todo for x in w.pair})
            tests = [F.count_if(test) for c, x in values for test in (F.col(c) < F.lit(x), F.col(c) <= F.lit(x))]
            row = df.agg(*[t.alias(f"_{i}") for i, t in enumerate(tests)]).first()
            less, most = ({v: row[2 * i + j] for i, v in enumerate(values)} for j in (0, 1))
            for w in todo:
                w.narrow(less, most)
    return {key: w.found for key, w in wanted.items()}


def quantiles(df: DataFrame, counts: dict[str, int], shares: list[float]) -> dict[str, list[float | None]]:
    """Each column's quantiles with linear interpolation; None without values."""
    places = {c: [(n - 1) * q for q in shares] for c, n in counts.items() if n}
    ranks = {c: sorted({r for p in ps for r in (int(p), min(int(p) + 1, counts[c] - 1))}) for c, ps in places.items()}
    held = order_statistics(df, counts, ranks)

    def at(c: str, p: float) -> float:
        low, high = held[c, int(p)], held[c, min(int(p) + 1, counts[c] - 1)]
        return low + (high - low) * (p - int(p))

    return {c: [at(c, p) for p in places[c]] if c in places else [None] * len(shares) for c in counts}
