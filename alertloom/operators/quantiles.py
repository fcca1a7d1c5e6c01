"""Exact order statistics without sorting the table or gathering it anywhere.

The built-in exact percentile keeps every distinct value of a group in one task.
Here a mergeable summary names three values around each wanted rank, one counting
pass tells on which side of them the rank lies, and the search goes on between
two of them. A pass leaves out the values it counted, so the search always ends;
usually a few passes do, whatever the spread of the values. NaN and the
infinities are counted first and never enter the search; NaN is the greatest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACCURACY = 10_000


@dataclass(frozen=True)
class _Span:
    """Values between two bounds (exclusive, None: open); `below` rows precede them."""

    low: Any
    high: Any
    below: int
    rows: int

    def holds(self, x: Column) -> Column:
        out = F.lit(True)
        if self.low is not None:
            out = out & (x > F.lit(self.low))
        return out if self.high is None else out & (x < F.lit(self.high))


def order_statistics(df: DataFrame, column: str, ranks: list[int]) -> dict[int, Any]:
    """Value at each 0-based rank among the non-null values of `column`."""
    return _find(df, column, lambda n: ranks)[1]


def _around(fraction: float) -> list[float]:
    return [min(1.0, max(0.0, fraction + d / ACCURACY)) for d in (-2, 0, 2)]


def _find(df: DataFrame, column: str, ranks_of: Any, near: list[float] | None = None) -> tuple[int, dict[int, Any]]:
    """Number of non-null values, and the values at the ranks that `ranks_of` asks of it.

    near: shares of the rows that the ranks lie at; the pass that counts the rows then
    names the first values around them, too.
    """
    data = df.select(F.col(column).alias("x")).where(F.col("x").isNotNull())
    x, inf = F.col("x"), float("inf")
    if isinstance(data.schema["x"].dataType, T.FractionalType) and not isinstance(data.schema["x"].dataType, T.DecimalType):
        counts = [F.count_if(x == F.lit(v)) for v in (-inf, inf, float("nan"))]
    else:
        counts = [F.lit(0)] * 3
    first = [F.percentile_approx("x", [v for f in near for v in _around(f)], ACCURACY)] if near else []
    n, least, most, odd, *named = data.agg(F.count("x"), *counts, *first).first()
    pivots = sorted(set(named[0])) if named and n and not least + most + odd else None
    finite = data if not least + most + odd else data.where((x > F.lit(-inf)) & (x < F.lit(inf)))
    inside = n - least - most - odd
    found, open_ranks = {}, []
    for rank in ranks_of(n):
        if not 0 <= rank < n:
            raise ValueError(f"rank {rank} is beyond the {n} values of the column")
        if rank < least:
            found[rank] = -inf
        elif rank < least + inside:
            open_ranks.append(rank)
        else:
            found[rank] = inf if rank < least + inside + most else float("nan")
    found |= {r + least: v for r, v in _narrow(finite, [r - least for r in open_ranks], inside, pivots).items()}
    return n, found


def _narrow(data: DataFrame, ranks: list[int], n: int, first: list | None = None) -> dict[int, Any]:
    spans = dict.fromkeys(ranks, _Span(None, None, 0, n))
    found: dict[int, Any] = {}
    while len(found) < len(spans):
        wanted = [r for r in spans if r not in found]
        x, named = F.col("x"), []
        for k, rank in enumerate(wanted):
            span = spans[rank]
            at = (rank - span.below + 1) / span.rows
            named.append(F.percentile_approx(F.when(span.holds(x), x), _around(at), ACCURACY).alias(f"p{k}"))
        pivots = [first] * len(wanted) if first else [sorted(set(values)) for values in data.agg(*named).first()]
        first = None
        tallies = [F.count_if(spans[rank].holds(x) & test).alias(f"n{k}_{i}_{j}") for k, rank in enumerate(wanted) for i, p in enumerate(pivots[k]) for j, test in enumerate((x < F.lit(p), x == F.lit(p)))]
        counted = data.agg(*tallies).first()
        for k, rank in enumerate(wanted):
            span, before, low = spans[rank], 0, spans[rank].low
            for i, pivot in enumerate(pivots[k]):
                less, equal = counted[f"n{k}_{i}_0"], counted[f"n{k}_{i}_1"]
                if rank < span.below + less:
                    spans[rank] = _Span(low, pivot, span.below + before, less - before)
                    break
                if rank < span.below + less + equal:
                    found[rank] = pivot
                    break
                before, low = less + equal, pivot
            else:
                spans[rank] = _Span(low, span.high, span.below + before, span.rows - before)
    return found


def _ranks(n: int, fractions: list[float]) -> list[int]:
    return sorted({r for f in fractions for r in (math.floor(f * (n - 1)), math.ceil(f * (n - 1)))}) if n else []


def exact_quantiles(df: DataFrame, column: str, fractions: list[float]) -> dict[float, float | None]:
    """Quantiles with linear interpolation between neighbouring values."""
    n, at = _find(df, column, lambda n: _ranks(n, fractions), fractions)
    return _between(n, at, fractions) if n else dict.fromkeys(fractions)


def quantiles_within(df: DataFrame, column: str, fractions: list[float], n: int, pivots: list[float]) -> dict[float, float | None]:
    """Exact quantiles of n finite non-null values, where values are known that lie close
    around them: one counting pass, then a search among the rows between those."""
    data = df.select(F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull())
    return _between(n, _narrow(data, _ranks(n, fractions), n, pivots), fractions)


def _between(n: int, at: dict[int, Any], fractions: list[float]) -> dict[float, float | None]:
    out: dict[float, float | None] = {}
    for f in fractions:
        place = f * (n - 1)
        a, b = float(at[math.floor(place)]), float(at[math.ceil(place)])
        out[f] = a if a == b else a + (b - a) * (place - math.floor(place))
    return out


def kth_smallest(df: DataFrame, column: str, fraction: float) -> Any:
    """Value at rank int(n * fraction), counted from 0."""
    _, found = _find(df, column, lambda n: [min(int(n * fraction), n - 1)] if n else [], [min(1.0, max(0.0, fraction))])
    return next(iter(found.values()), None)


def error_quantiles(df: DataFrame, column: str) -> DataFrame:
    """min, quartiles, 95th percentile and max of a column in one row."""
    names = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}
    values = exact_quantiles(df, column, list(names.values()))
    stats = df.agg(F.min(column).alias("min_value"), F.max(column).alias("max_value"))
    return stats.withColumns({n: F.lit(values[f]).cast("double") for n, f in names.items()})


def approx_quantiles(df: DataFrame, column: str, accuracy: int = 100_000) -> DataFrame:
    """The same figures from mergeable summaries, in one pass."""
    q = F.percentile_approx(column, [0.25, 0.5, 0.75, 0.95], accuracy)
    return df.agg(F.min(column).alias("min_value"), F.max(column).alias("max_value"), q.alias("q")).select(
        "min_value", "max_value", *[F.col("q")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75", "q95"))]
    )
