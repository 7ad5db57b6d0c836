"""Expanding walk-forward splits as a small table, and rows by split."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obscast.config import Config
from obscast.operators.asof import require_closed_left

SCHEMA = "split string, train_start date, train_end date, test_start date, test_end date"


def walk_forward_splits(
    spark: SparkSession, history_start: dt.date, test_starts: list[dt.date], test_days: int = 365,
    min_train_days: int = 365, holdout_days: tuple[int, ...] = (), as_of: dt.date | None = None,
) -> DataFrame:
    """One row a split; splits whose training range is too short are left out.

    Holdouts are the last days before `as_of` and need it.
    """
    day, spans = dt.timedelta(days=1), _spans(test_starts, test_days, holdout_days, as_of)
    rows = [(name, history_start, a - day, a, b) for name, a, b in spans if (a - history_start).days >= min_train_days]
    return spark.createDataFrame(rows, SCHEMA)


def _spans(test_starts, test_days: int, holdout_days: tuple[int, ...], as_of: dt.date | None) -> list[tuple[str, dt.date, dt.date]]:
    day = dt.timedelta(days=1)
    if holdout_days and as_of is None:
        raise ValueError("holdouts need as_of")
    spans = [(f"test_{t.isoformat()}", t, t + (test_days - 1) * day) for t in test_starts]
    return spans + [(f"holdout_{n}d", as_of - n * day, as_of - day) for n in holdout_days]


def split_plan(
    labels: DataFrame, test_starts: list[dt.date] | None = None, test_days: int = 365, min_train_days: int = 365,
    holdout_days: tuple[int, ...] = (), as_of: dt.date | None = None, config: Config = Config(),
) -> DataFrame:
    """The splits of every station, a table with the station's columns before those of SCHEMA.

    A station's history starts on its first complete day; a station without one has no split.
    Without `test_starts` each station has its own: `default_test_starts` of that day. Nothing
    is read by the driver.
    """
    st = [*config.station]
    first = labels.where("day_complete").groupBy(*st).agg(F.min("date_local").alias("train_start"))

    def span(name: Column, begin: Column, end: Column) -> Column:
        return F.struct(name.alias("split"), begin.alias("test_start"), end.alias("test_end"))

    fixed = [span(F.lit(n), F.lit(a), F.lit(b)) for n, a, b in _spans(test_starts or [], test_days, holdout_days, as_of)]
    spans = F.array(*fixed) if fixed else F.array().cast("array<struct<split: string, test_start: date, test_end: date>>")
    if test_starts is None:
        begin = F.greatest(F.year("train_start") + 5, F.lit(EARLIEST))
        years = F.when(begin <= LATEST, F.sequence(begin, F.lit(LATEST)))
        start = lambda y: F.make_date(y, F.lit(1), F.lit(1))
        own = F.transform(years, lambda y: span(F.concat(F.lit("test_"), start(y).cast("string")), start(y), F.date_add(start(y), test_days - 1)))
        spans = F.concat(F.coalesce(own, F.array().cast("array<struct<split: string, test_start: date, test_end: date>>")), spans)
    rows = first.where("train_start is not null").select(*st, "train_start", F.inline(spans))
    rows = rows.where(F.datediff("test_start", "train_start") >= min_train_days)
    rows = require_closed_left(rows, "train_start", "test_start")
    return rows.select(*st, "split", "train_start", F.date_sub("test_start", 1).alias("train_end"), "test_start", "test_end")


#: First and last year of the default test years (fixed values).
EARLIEST, LATEST = 2014, 2025


def default_test_starts(first: dt.date, earliest: int = EARLIEST, last: int = LATEST) -> list[dt.date]:
    """Each January 1 from five years after the first day, not before `earliest`."""
    return [dt.date(y, 1, 1) for y in range(max(first.year + 5, earliest), last + 1)]


def in_range(rows: DataFrame, splits: DataFrame, which: str, config: Config = Config()) -> DataFrame:
    """`rows` of each split's `train` or `test` range; one station's handful of splits is broadcast."""
    st = [*config.station]
    span = splits.select(*st, "split", F.col(f"{which}_start").alias("__a"), F.col(f"{which}_end").alias("__b"))
    inside = F.col("date_local").between(F.col("__a"), F.col("__b"))
    found = rows.join(span, st).where(inside) if st else rows.join(F.broadcast(span), inside)
    return found.drop("__a", "__b")
