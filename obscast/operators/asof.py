"""What was known at a checkpoint: causal slices, as-of anchors and the leak guard."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obscast.config import Config
from obscast.functions import calendar


def with_change(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """delta_t_per_h: change since the day's previous report; null at the first or in the same instant."""
    order = Window.partitionBy(*config.day).orderBy("valid", "obs_id")
    micros = F.unix_micros("valid") - F.unix_micros(F.lag("valid").over(order))
    hours = F.floor(micros / 3_600_000_000) if config.whole_hours else micros / 3_600_000_000
    change = (F.col("tmp_c_int") - F.lag("tmp_c_int").over(order)).cast("double")
    return rows.withColumn("delta_t_per_h", F.try_divide(change, hours.cast("double")))


class Part(NamedTuple):
    """An aggregate that is made over some reports and merged over groups of reports."""

    make: Column
    merge: Callable[[str], Column]


def total(x: Column) -> Part:
    return Part(F.sum(x), F.sum)


def count(x: Column) -> Part:
    return Part(F.count(x), F.sum)


def most(x: Column) -> Part:
    return Part(F.max(x), F.max)


def least(x: Column) -> Part:
    return Part(F.min(x), F.min)


def mean(name: str, x: Column) -> dict[str, Part]:
    """Parts of an average, to be divided by `average`."""
    return {f"{name}__s": total(x.cast("double")), f"{name}__n": count(x)}


def average(name: str) -> Column:
    return F.try_divide(F.col(f"{name}__s"), F.col(f"{name}__n"))


def at_instants(obs: DataFrame, parts: dict[str, Column], config: Config = Config()) -> DataFrame:
    """(day, valid, ts_local, hour_local, parts): the reports of an instant in one row.

    Reports of an instant are on the same side of every checkpoint and differ in order by
    `obs_id` alone. So aggregates of plain numbers, made before anything is shuffled, stand for
    them: what comes after grows with the instants that reports share, not with the reports.
    """
    local = [F.max(c).alias(c) for c in ("ts_local", "hour_local")]
    return obs.groupBy(*config.day, "valid").agg(*local, *[c.alias(n) for n, c in parts.items()])


def is_known() -> Column:
    """Whether a report has a temperature, of its own or imputed."""
    return F.col("dq_tmp_c_int") != "missing"


def by_order(pick: Callable[[Column, Column], Column], x: Column | str, which: Column) -> Column:
    """min_by or max_by of `x` in the order of an instant's reports, of those that `which` holds for."""
    return pick(F.col(x) if isinstance(x, str) else x, F.when(which, F.coalesce("obs_id", F.lit(-(2**63)))))


def known_instants(made: DataFrame, config: Config = Config()) -> DataFrame:
    """Instants with a known report (`n`), and delta_t_per_h of the first of each.

    made: `at_instants` with n, t_first and t_last, the temperatures of its first and last known
    report. Later reports of an instant have no change: no time has passed.
    """
    order = Window.partitionBy(*config.day).orderBy("valid")
    micros = F.unix_micros("valid") - F.unix_micros(F.lag("valid").over(order))
    hours = F.floor(micros / 3_600_000_000) if config.whole_hours else micros / 3_600_000_000
    change = (F.col("t_first") - F.lag("t_last").over(order)).cast("double")
    return made.where("n > 0").withColumn("delta_t_per_h", F.try_divide(change, hours.cast("double")))


def checkpoint_instants(config: Config = Config()) -> Column:
    """The checkpoints of `date_local` and their instants, an array of structs (cp, cp_utc)."""
    day = F.col("date_local")
    return F.array(*[F.struct(F.lit(c).alias("cp"), calendar.cp_to_utc(day, F.lit(c), config.tz).alias("cp_utc")) for c in config.cps])


def prefix_slices(rows: DataFrame, parts: dict[str, Part], config: Config = Config()) -> DataFrame:
    """(day, cp, cp_utc, cp_hour, parts) over the rows of a local date before each of its checkpoints.

    rows: reports or instants. A row belongs to one interval between checkpoints, named by the checkpoints it precedes, and
    is aggregated there once. What a checkpoint sees is the merger of the intervals before it: at
    most one row more than there are checkpoints for each of them, however many reports a day has.
    """
    ahead = [F.when(F.col("valid") < calendar.cp_to_utc(F.col("date_local"), F.lit(c), config.tz), 1 << k).otherwise(0) for k, c in enumerate(config.cps)]
    held = rows.withColumn("__ahead", reduce(Column.__add__, ahead)).where("__ahead > 0")
    made = held.groupBy(*config.day, "__ahead").agg(*[p.make.alias(n) for n, p in parts.items()])
    seen = [F.when(F.col("__ahead").bitwiseAND(1 << k) > 0, F.lit(k)) for k in range(len(config.cps))]
    made = made.select(*config.day, *parts, F.explode(F.array_compact(F.array(*seen))).alias("__k"))
    merged = made.groupBy(*config.day, "__k").agg(*[p.merge(n).alias(n) for n, p in parts.items()])
    merged = merged.select("*", F.inline(F.array(F.get(checkpoint_instants(config), F.col("__k"))))).drop("__k")
    return merged.withColumn("cp_hour", F.hour(calendar.local_time(F.col("cp_utc"), config.tz)))


def known(obs: DataFrame, config: Config = Config()) -> DataFrame:
    """Reports with a temperature and the change since the day's previous one, which every slice holds too."""
    return with_change(obs.where(is_known()), config)


def first_parts(columns: tuple[str, ...]) -> dict[str, Column]:
    """The values of an instant's first known report, for `at_instants`."""
    return {f"first__{c}": by_order(F.min_by, c, is_known()) for c in columns}


def anchor_part(anchor: int, columns: tuple[str, ...]) -> Part:
    """The report nearest to an anchor hour, at most 30 whole minutes away, the earliest of equally near ones.

    Made over instants with `first_parts` of the columns.
    """
    seconds = F.unix_seconds("ts_local") - F.unix_seconds(F.col("date_local").cast("timestamp")) - anchor * 3600
    minutes = F.floor(F.abs(seconds) / 60)
    return least(F.when(minutes <= 30, F.struct(minutes.alias("m"), F.unix_micros("valid").alias("at"), F.struct(*[F.col(f"first__{c}").alias(c) for c in columns]).alias("v"))))


def anchor_value(anchor: int, name: str) -> Column:
    """The values of an anchor's report; anchors from the checkpoint's local hour on have none."""
    return F.when(F.lit(anchor) < F.col("cp_hour"), F.col(f"{name}.v"))


def nearest_anchors(obs: DataFrame, columns: tuple[str, ...], config: Config = Config()) -> DataFrame:
    """(day, cp, anchor, columns...) of the anchors that have a report near them."""
    seen = at_instants(obs, {"n": F.count_if(is_known()), **first_parts(columns)}, config).where("n > 0")
    wide = prefix_slices(seen, {f"a{a}": anchor_part(a, columns) for a in config.anchors}, config)
    pairs = F.array(*[F.struct(F.lit(a).alias("anchor"), anchor_value(a, f"a{a}").alias("v")) for a in config.anchors])
    rows = wide.select(*config.day, "cp", F.explode(pairs).alias("x")).where("x.v is not null")
    return rows.select(*config.day, "cp", "x.anchor", "x.v.*")


def require_causal(features: DataFrame, last: str = "feature_max_ts", label: str = "features") -> DataFrame:
    """`features` (with cp_utc) without `last`; the job fails if any row saw its checkpoint or later."""
    leak = F.raise_error(F.concat(F.lit(f"{label}: "), F.col(last).cast("string"), F.lit(" is not before the checkpoint")))
    ok = F.when(F.col(last) >= F.col("cp_utc"), leak.cast("boolean")).otherwise(True)
    return features.where(ok).drop(last)


def require_closed_left(windows: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """`windows`; the job fails if any does not begin before it ends."""
    wrong = F.raise_error(F.concat(F.lit("window does not begin before it ends: "), F.col(start).cast("string")))
    return windows.where(F.when(F.col(start) < F.col(end), True).otherwise(wrong.cast("boolean")))
