"""The fixed 'now' of windowed operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_as_of(df: DataFrame, column: str, as_of: object | None = None) -> str:
    """A moment as text: the one given, else the latest value of `column`.

    One single-value aggregate. The answer goes into later plans as a literal,
    so time predicates reach the scan and prune row groups and partitions.
    """
    if as_of is not None:
        return str(as_of)
    latest = df.agg(F.max(column).cast("string")).first()[0]
    return latest if latest is not None else "1970-01-01 00:00:00"


def moment(df: DataFrame, column: str, as_of: str, shift: str | None = None) -> Column:
    """`as_of`, moved by an interval such as '7 DAYS', in the type of `column`."""
    point = F.lit(as_of).cast(df.schema[column].dataType)
    return point - F.expr(f"INTERVAL {shift}") if shift else point


def since(df: DataFrame, column: str, as_of: str, days: int | None = None, hours: int | None = None) -> Column:
    """Predicate: column lies in the window that ends at `as_of`; time of day kept."""
    shift = f"{int(days)} DAYS" if days is not None else f"{int(hours)} HOURS"
    return F.col(column) >= moment(df, column, as_of, shift)
