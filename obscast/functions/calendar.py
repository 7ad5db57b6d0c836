"""Local dates, checkpoints and their instants. The session time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_time(valid: Column, tz: str) -> Column:
    """Wall clock of a UTC instant."""
    return F.from_utc_timestamp(valid, tz)


def local_date(valid: Column, tz: str) -> Column:
    return F.to_date(local_time(valid, tz))


def day_window(day: Column, tz: str) -> tuple[Column, Column]:
    """[start, end) of a local day in UTC: 23, 24 or 25 hours."""
    at = lambda d: F.to_utc_timestamp(d.cast("timestamp"), tz)
    return at(day), at(F.date_add(day, 1))


def cp_to_utc(day: Column, cp: Column, tz: str) -> Column:
    """The instant of a UTC checkpoint (HH:mm) that falls on the local day; an error if none does."""
    minutes = F.substring(cp, 1, 2).cast("int") * 60 + F.substring(cp, 4, 2).cast("int")
    seconds = F.unix_date(day).cast("long") * 86_400 + minutes * 60
    same, before = F.timestamp_seconds(seconds), F.timestamp_seconds(seconds - 86_400)
    wrong = F.raise_error(F.concat(F.lit("no instant of the checkpoint on "), day.cast("string")))
    chosen = F.when(local_date(same, tz) == day, same).when(local_date(before, tz) == day, before)
    return F.when(day.isNotNull(), chosen.otherwise(wrong.cast("timestamp")))


def is_morning(cp: Column, tz: str, ref_date: str) -> Column:
    """Whether the checkpoint's local hour on the reference date is before noon."""
    at = F.to_timestamp(F.concat_ws(" ", F.lit(ref_date), cp), "yyyy-MM-dd HH:mm")
    return F.hour(local_time(at, tz)) < 12


def cp_key(cp: Column) -> Column:
    """Column name of a checkpoint in wide tables: 20:00 gives k_cp__cp_2000."""
    return F.concat(F.lit("k_cp__cp_"), F.replace(cp, F.lit(":"), F.lit("")))


def local_hour_to_utc(day: Column, hour: Column, tz: str) -> Column:
    return F.to_utc_timestamp(F.timestamp_seconds(F.unix_date(day).cast("long") * 86_400 + hour * 3600), tz)


def quartile(hour: Column) -> Column:
    """Six-hour block of the day, 0 to 3."""
    return F.floor(hour / 6).cast("int")
