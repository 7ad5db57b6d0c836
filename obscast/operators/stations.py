"""Facts of a station: one row for each station, or one row where there is one station only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_facts(rows: DataFrame, facts: DataFrame, keys: list[str] | tuple[str, ...]) -> DataFrame:
    """`rows` with the columns of `facts`, which has a row for each value of `keys`.

    Without keys `facts` is a single row (an aggregate of everything) and goes along as it is.
    """
    return rows.join(facts, [*keys]) if keys else rows.crossJoin(F.broadcast(facts))


def few(table: DataFrame, keys: list[str] | tuple[str, ...]) -> DataFrame:
    """`table` to be broadcast where its size is that of a calendar; with stations Spark decides by size."""
    return table if keys else F.broadcast(table)


def same(a: DataFrame, b: DataFrame, keys: list[str] | tuple[str, ...]) -> Column:
    """Equality of `keys`, nulls equal to nulls."""
    return reduce(Column.__and__, [a[k].eqNullSafe(b[k]) for k in keys], F.lit(True))
