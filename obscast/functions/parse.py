"""Temperatures out of report texts, with quality tags; column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obscast.config import SKY_WEIGHTS, Config

#: The temperature and dewpoint group of a report (fixed pattern).
GROUP = r"\s(M?\d{1,2})/(M?\d{1,2})(?=\s|$)"


def signed(text: Column) -> Column:
    """M05 gives -5; an empty string gives null."""
    return F.replace(text, F.lit("M"), F.lit("-")).try_cast("int")


def f_to_c(f: Column) -> Column:
    return (f - 32.0) * 5.0 / 9.0


def parse_temperatures(obs: DataFrame, config: Config = Config()) -> DataFrame:
    """`obs` (metar, tmpf) with tmp_c_int, dwp_c_int, dq_tmp_c_int and dwp_implausible.

    ok: the group was read and the temperature is plausible; imputed: there is no report or no
    group, and the Fahrenheit value is rounded half to even; missing: neither, or implausible,
    and then nothing is imputed. An implausible dewpoint is dropped alone.
    """
    # The group is read once a report: rows made by a generator are not computed anew for
    # each use, nor inside filters that are pushed down. A blank report has no group.
    group = F.regexp_extract("metar", GROUP, 0)
    read = F.struct(group.alias("__group"))
    obs = obs.select("*", F.inline(F.array(read)))
    part = lambda k: signed(F.split_part(F.substring("__group", 2, 9), F.lit("/"), F.lit(k))).cast("long")
    numbers = F.struct(part(1).alias("__t"), part(2).alias("__d"))
    obs = obs.select("*", F.inline(F.array(numbers))).drop("__group")
    t, d = F.col("__t"), F.col("__d")
    found = t.isNotNull()
    fits = t.between(*config.tmp_range)
    dew_fits = d.between(*config.dwp_range)
    imputed = F.bround(f_to_c(F.col("tmpf"))).cast("long")
    return obs.withColumns(
        {
            "tmp_c_int": F.when(found, F.when(fits, t)).otherwise(imputed),
            "dwp_c_int": F.when(found & fits & dew_fits, d),
            "dq_tmp_c_int": F.when(found, F.when(fits, "ok").otherwise("missing"))
            .when(F.col("tmpf").isNotNull(), "imputed").otherwise("missing"),
            "implausible": found & ~(fits & dew_fits),
        }
    ).drop("__t", "__d")


def annotate(obs: DataFrame, config: Config = Config()) -> DataFrame:
    """Local time, date and hour, dewpoint depression, its flag, and whole-number cloud bases."""
    obs = obs.select("*", F.inline(F.array(F.struct(F.from_utc_timestamp("valid", config.tz).alias("ts_local")))))
    local = F.col("ts_local")
    bases = {c: F.col(c).try_cast("long") for c in obs.columns if c.startswith("skyl")}
    return obs.withColumns(
        {
            "date_local": F.to_date(local), "hour_local": F.hour(local),
            "dw_depression_c_int": F.col("tmp_c_int") - F.col("dwp_c_int"),
            "dwp_gt_tmp_flag": F.col("dwp_c_int") > F.col("tmp_c_int"), **bases,
        }
    )


def parse_stats(obs: DataFrame) -> DataFrame:
    """Counts by quality, implausible values, fallback and missing rates over all of `obs`."""
    tag = lambda q: F.count_if(F.col("dq_tmp_c_int") == q)
    n = F.count("*")
    return obs.agg(
        tag("ok").alias("n_ok"), tag("imputed").alias("n_imputed"), tag("missing").alias("n_missing"),
        F.count_if("implausible").alias("n_implausible"),
        F.coalesce(F.try_divide(tag("imputed"), tag("ok") + tag("imputed")), F.lit(0.0)).alias("fallback_rate"),
        F.coalesce(F.try_divide(tag("missing"), n), F.lit(0.0)).alias("missing_rate"),
    )


def sky_weight(code: Column) -> Column:
    """Cover weight of a sky code; null for unknown and missing ones."""
    pairs = [F.lit(x) for pair in SKY_WEIGHTS.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), code)


def in_sector(value: Column, start: float, end: float) -> Column:
    """Whether a direction lies in [start, end], around north if start > end."""
    if start <= end:
        return value.between(start, end)
    return (value >= start) | (value <= end)


def ensure_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """`df` with the missing ones of `kinds` as typed nulls."""
    return df.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in df.columns})
