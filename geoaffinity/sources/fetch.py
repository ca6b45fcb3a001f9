"""Parameterised reads: a statement's market and dates are bound as arguments, never written into it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from geoaffinity.params import Scope


def fetch(statement: str, facts: DataFrame, scope: Scope) -> DataFrame:
    """The rows of ``facts`` that a statement selects.

    The statement reads ``{facts}`` and may name ``:market``, ``:start`` and ``:end``. Spark binds
    them as typed literals after parsing, so they push down like written ones.
    """
    arguments = {"market": scope.market, "start": scope.start, "end": scope.end}
    return facts.sparkSession.sql(statement, args=arguments, facts=facts)


def covering_predicates(column: str, first: dt.date | None, last: dt.date | None, days: int) -> list[str]:
    """Disjoint SQL conditions that together hold for every row, each for so many days.

    first, last: the least and greatest day that the column holds when the read is planned. Rows
    written later fall to the first or the last piece, rows without a day to a piece of their own.
    """
    if days < 1:
        raise ValueError("a piece holds a day at least")
    found = [f"{column} IS NULL"]
    if first is None or last is None:
        return [*found, f"{column} IS NOT NULL"]
    starts = [first + dt.timedelta(n) for n in range(0, (last - first).days + 1, days)]
    for n, start in enumerate(starts):
        ends = [f"{column} >= DATE '{start}'"] if n else []
        if n + 1 < len(starts):
            ends.append(f"{column} < DATE '{starts[n + 1]}'")
        found.append(" AND ".join(ends) or f"{column} IS NOT NULL")
    return found
