"""All registered queries by key."""

from __future__ import annotations

from alertloom.queries import features, fits, relational, scoring, streams
from alertloom.queries.registry import Query


def all_queries() -> dict[str, Query]:
    return {**relational.queries(), **features.queries(), **scoring.queries(), **fits.queries(), **streams.queries()}
