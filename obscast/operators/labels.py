"""Daily labels in local time: canonical extremes, completeness, checkpoint maxima.

Everything about a day is aggregated in one pass over the instants that it has reports of,
keyed by local date; the only window, over the same key, is the gap to the previous report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obscast.config import Config
from obscast.functions import calendar
from obscast.functions.parse import f_to_c
from obscast.functions.settle import day_flip_distance
from obscast.operators.asof import at_instants


def observation_gaps(obs: DataFrame, config: Config = Config()) -> DataFrame:
    """Rows with a temperature of their own and the whole minutes since the day's previous one."""
    return _with_gaps(obs, config).where("dq_tmp_c_int = 'ok'")


def _with_gaps(obs: DataFrame, config: Config) -> DataFrame:
    """All rows, with gap_min on those that have a temperature of their own."""
    return _gaps(obs, F.col("dq_tmp_c_int") == "ok", ["valid", "obs_id"], config)


def _gaps(rows: DataFrame, ok: Column, order: list[str], config: Config) -> DataFrame:
    before = Window.partitionBy(*config.day).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(ok, F.unix_micros("valid")), ignorenulls=True).over(before)
    return rows.withColumn("gap_min", F.when(ok, F.floor((F.unix_micros("valid") - last) / 60_000_000).cast("long")))


def own_parts() -> dict[str, Column]:
    """What labels need of an instant's reports, for `at_instants`; of the warmest the first by obs_id."""
    own = F.col("dq_tmp_c_int") == "ok"
    # One number that orders by temperature, then by obs_id, whatever that long is.
    place = F.coalesce("obs_id", F.lit(2**63 - 1)).cast("decimal(19,0)") - F.col("tmp_c_int").cast("decimal(17,0)") * F.lit(str(2 * 10**19)).cast("decimal(20,0)")
    return {
        "own_n": F.count_if(own), "own_imputed": F.count_if(F.col("dq_tmp_c_int") == "imputed"), "own_max": F.max(F.when(own, F.col("tmp_c_int"))),
        "own_min": F.min(F.when(own, F.col("tmp_c_int"))), "own_tmpf": F.min(F.when(own, F.col("tmpf"))), "own_top_tmpf": F.min_by("tmpf", F.when(own, place)),
    }


def daily_labels(obs: DataFrame, config: Config = Config()) -> DataFrame:
    """One row per local date that has an own temperature. Imputed rows are counted only."""
    return labels_of(at_instants(obs, own_parts(), config), config)


def labels_of(made: DataFrame, config: Config = Config()) -> DataFrame:
    """`daily_labels` from the instants of the reports, `at_instants` with `own_parts`."""
    own = F.col("own_n") > 0
    only = lambda c: F.when(own, c if isinstance(c, Column) else F.col(c))
    # The warmest report of the day, the earliest of equals, and its own other values.
    top = F.struct("own_max", -F.unix_micros("valid"))
    row = F.max_by(F.struct(F.col("own_max").alias("tmp_c_int"), "ts_local", "hour_local", F.col("own_top_tmpf").alias("tmpf")), only(top))
    at = [
        F.max(F.when(own & (F.col("valid") < F.get("instants", k)), F.col("own_max"))).alias(f"k_cp__cp_{cp.replace(':', '')}")
        for k, cp in enumerate(config.cps)
    ]
    instants = F.array(*[calendar.cp_to_utc(F.col("date_local"), F.lit(cp), config.tz) for cp in config.cps])
    rows = _gaps(made, own, ["valid"], config).select("*", F.inline(F.array(F.struct(instants.alias("instants")))))
    quarters = [F.bool_or(own & (calendar.quartile(F.col("hour_local")) == q)).cast("int") for q in range(4)]
    days = rows.groupBy(*config.day).agg(
        row.alias("top"), F.min("own_min").alias("tmin_int"), F.min("own_tmpf").alias("tmpf_min"), F.sum("own_n").alias("n_obs"),
        F.max(F.greatest("gap_min", F.when(F.col("own_n") > 1, 0))).alias("max_gap_min"), F.sum("own_imputed").alias("n_imputed"),
        F.min(only("hour_local")).alias("first_hour"), F.max(only("hour_local")).alias("last_hour"),
        reduce(Column.__add__, quarters).alias("quartiles"), *at,
    ).where("n_obs > 0")
    gap = config.max_gap_minutes
    complete = reduce(
        lambda a, b: a & b,
        [
            F.col("n_obs") >= config.min_obs, F.coalesce("max_gap_min", F.lit(0)) <= gap, F.col("first_hour") * 60 <= gap,
            (23 - F.col("last_hour")) * 60 + 60 <= gap, F.col("quartiles") >= config.min_quartiles,
        ],
    )
    hour = F.col("top.hour_local")
    tmax_dec = f_to_c(F.col("top.tmpf"))
    return days.select(
        *config.day, F.col("top.tmp_c_int").alias("tmax_int"), "tmin_int", tmax_dec.alias("tmax_dec"),
        f_to_c(F.col("tmpf_min")).alias("tmin_dec"), "tmpf_min", "n_obs", "max_gap_min", "n_imputed",
        F.lit("ok").alias("tmax_source"), F.col("top.ts_local").alias("tmax_ts"), hour.cast("long").alias("tmax_hour"),
        hour.cast("long").alias("tmax_hour_local"),
        F.concat(F.col("date_local").cast("string"), F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), F.lit(":00:00")).alias("tmax_hour_str"),
        calendar.local_hour_to_utc(F.col("date_local"), hour, config.tz).alias("tmax_hour_utc"),
        ((hour < 6) | (hour > 18)).alias("tmax_atypical_hour"), day_flip_distance(tmax_dec).alias("risco_de_flip"),
        complete.alias("day_complete"), *[F.col(f"k_cp__cp_{cp.replace(':', '')}") for cp in config.cps],
    )


def k_cp_long(labels: DataFrame, config: Config = Config()) -> DataFrame:
    """(date_local, cp, k_cp), dates without an earlier report kept as null."""
    pairs = [F.struct(F.lit(cp).alias("cp"), F.col(f"k_cp__cp_{cp.replace(':', '')}").alias("k_cp")) for cp in config.cps]
    return labels.select(*config.day, F.explode(F.array(*pairs)).alias("x")).select(*config.day, "x.*")


def neighbour_days(labels: DataFrame, back: tuple[int, ...] = (1, 2, 3), config: Config = Config()) -> DataFrame:
    """date_local and the maxima of the calendar days before it, null across gaps."""
    own = labels.select(*config.day)
    shifted = labels.select(
        *config.station, F.explode(F.array(*[F.struct(F.date_add("date_local", n).alias("d"), F.lit(n).alias("n")) for n in back])).alias("s"), "tmax_int"
    )
    wide = shifted.groupBy(*config.station, F.col("s.d").alias("date_local")).agg(
        *[F.max(F.when(F.col("s.n") == n, F.col("tmax_int"))).alias(f"tmax_dminus{n}") for n in back]
    )
    return own.join(wide, [*config.day], "left")
