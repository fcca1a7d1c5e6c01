"""What a registered query is."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from alertloom.sources.views import Views, oracle


@dataclass(frozen=True)
class Query:
    """A query over the alert tables and, where SQL can say it, the SQL to match."""

    run: Callable[[Views], DataFrame]
    sql: str | None = None


def checked(run: Callable[[Views], DataFrame], select: str, ctes: str = "") -> Query:
    return Query(run, oracle(select, ctes))


def unchecked(run: Callable[[Views], DataFrame]) -> Query:
    return Query(run)
