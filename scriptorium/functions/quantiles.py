"""Exact percentiles of real numbers by selection: no task holds more than a bounded number of values.

A sketch gives two values that very likely lie on either side of the wanted place; one pass counts what lies
below, on and between them, which settles the place or leaves a small part of the values to go on with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut, discard

SKETCH = 1024  # rank error about 0.3 %
MARGIN = 0.01  # on either side of the wanted place
HELD = 20_000  # values that are sorted in one task


class _Place:
    """The open interval in which the value of 0-based rank ``rank`` lies; ``below`` values lie before it."""

    def __init__(self, rank: int, n: int):
        self.rank, self.low, self.high, self.below, self.inside = rank, None, None, 0, n
        self.value: float | None = None
        self.bounds: tuple[float, float] | None = None

    def within(self, v):
        cond = F.lit(True)
        if self.low is not None:
            cond = cond & (v > self.low)
        if self.high is not None:
            cond = cond & (v < self.high)
        return cond

    def narrow(self, counts) -> None:
        """Take in how many values are below, at most, below and at most the two bounds."""
        x, y = self.bounds
        under_x, upto_x, under_y, upto_y = counts
        total = self.below + self.inside
        self.bounds = None
        if under_x <= self.rank < upto_x:
            self.value = x
        elif under_y <= self.rank < upto_y:
            self.value = y
        elif self.rank < under_x:
            self.high, self.inside = x, under_x - self.below
        elif self.rank >= upto_y:
            self.low, self.below, self.inside = y, upto_y, total - upto_y
        else:
            self.low, self.high, self.below, self.inside = x, y, upto_x, under_y - upto_x


def _values_at(values: DataFrame, ranks: list[int], n: int) -> dict[int, float]:
    """The values of 0-based ranks of the one column ``v``, which holds ``n`` numbers without nulls."""
    v = F.col("v")
    places = [_Place(r, n) for r in ranks]
    while open_places := [p for p in places if p.value is None]:
        for p in [p for p in open_places if p.inside <= HELD]:
            rest = values.filter(p.within(v)).agg(F.sort_array(F.collect_list(v)).alias("l")).first()["l"]
            p.value = rest[p.rank - p.below]
        wide = [p for p in open_places if p.value is None]
        if not wide:
            continue
        asked = []
        for i, p in enumerate(wide):
            t = (p.rank - p.below + 0.5) / p.inside
            sketch = F.kll_sketch_agg_double(F.when(p.within(v), v), F.lit(SKETCH))
            for name, at in (("x", max(t - MARGIN, 0.0)), ("y", min(t + MARGIN, 1.0))):
                asked.append(F.kll_sketch_get_quantile_double(sketch, F.lit(at)).alias(f"{name}{i}"))
        row = values.agg(*asked).first()
        for i, p in enumerate(wide):
            p.bounds = (row[f"x{i}"], row[f"y{i}"])
        counts = []
        for i, p in enumerate(wide):
            x, y = (F.lit(b) for b in p.bounds)
            counts += [F.count_if(c).alias(f"c{i}_{j}") for j, c in enumerate((v < x, v <= x, v < y, v <= y))]
        row = values.agg(*counts).first()
        for i, p in enumerate(wide):
            p.narrow([row[f"c{i}_{j}"] for j in range(4)])
    return {p.rank: p.value for p in places}


def exact_percentiles(df: DataFrame, column: str, points: list[float]) -> list[float | None]:
    """Percentiles (``points`` from 0 to 1) with linear interpolation; nulls and values that are no number do not count.

    The column is written once, every step scans that.  Jobs run at once; the result is plain numbers, None for a
    column without numbers.
    """
    v = F.col(f"`{column}`").try_cast("double")
    values = cut(df.select(v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v")))
    n = values.count()
    if not n:
        return [None] * len(points)
    spots = [p * (n - 1) for p in points]
    ranks = sorted({r for s in spots for r in (int(s), min(int(s) + 1, n - 1))})
    at = _values_at(values, ranks, n)
    discard(values)
    out = []
    for s in spots:
        low, high = at[int(s)], at[min(int(s) + 1, n - 1)]
        out.append(low if low == high else (int(s) + 1 - s) * low + (s - int(s)) * high)
    return out
