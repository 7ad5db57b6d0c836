"""Slice aggregates, regimes and the feature table, one row per (date_local, cp)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obscast.config import CATALOG, HPA_PER_INHG, Config
from obscast.functions.parse import ensure_columns, in_sector, sky_weight
from obscast.operators import asof
from obscast.operators.asof import Part, average, least, most, total
from obscast.operators.labels import neighbour_days, own_parts

LAYERS = {f"skyc{k}": "string" for k in range(1, 5)} | {f"skyl{k}": "long" for k in range(1, 5)}
ANCHORED = ("tmp_c_int", "dwp_c_int", "alti")


def _sums(parts: dict[str, Column]) -> dict[str, Part]:
    """The same sums over instants."""
    return {name: total(F.col(name)) for name in parts}


def _known(x: Column | str) -> Column:
    return F.when(asof.is_known(), F.col(x) if isinstance(x, str) else x)


def _mean(name: str, x: Column) -> dict[str, Column]:
    return {f"{name}__s": F.sum(_known(x).cast("double")), f"{name}__n": F.count(_known(x))}


def circular_parts(direction: str = "drct") -> dict[str, Column]:
    return {"circular__s": F.sum(_known(F.sin(F.radians(direction)))), "circular__c": F.sum(_known(F.cos(F.radians(direction))))}


def circular_mean() -> Column:
    """Vector mean of directions from `circular_parts`; null without any or when they cancel out."""
    s, c = F.col("circular__s"), F.col("circular__c")
    return F.when((F.abs(s) >= 1e-10) | (F.abs(c) >= 1e-10), F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0)))


def sector_parts(name: str, start: float, end: float, direction: str = "drct") -> dict[str, Column]:
    """Sums of the arithmetic mean of the directions inside a sector."""
    return _mean(name, F.when(in_sector(F.col(direction), start, end), F.col(direction)))


def _cloud(weigh: Callable[[int], Column]) -> Column:
    return F.max(_known(F.array_max(F.array(*[weigh(k) for k in range(1, 5)]))))


def known_parts(anchored: tuple[str, ...] = ()) -> dict[str, Column]:
    """What slices need of an instant's known reports, for `asof.at_instants`."""
    # Mean speed of the reports from 270 to 45 degrees; cloud bases count in full from 8000 ft, none as 0.
    flow = F.when(in_sector(F.col("drct"), 270, 45), F.col("sknt"))
    height = lambda k: F.least(F.lit(1.0), F.coalesce(F.col(f"skyl{k}"), F.lit(0)) / 8000.0)
    return {
        "n": F.count_if(asof.is_known()), "p01i__s": F.sum(_known("p01i")), **_mean("depression", F.col("dw_depression_c_int")),
        "t_min": F.min(_known("tmp_c_int")), "t_max": F.max(_known("tmp_c_int")), "t_first": asof.by_order(F.min_by, "tmp_c_int", asof.is_known()),
        "t_last": asof.by_order(F.max_by, "tmp_c_int", asof.is_known()), **_mean("flow", flow), **_mean("all", F.col("drct")), **circular_parts(),
        "cloud_cover": _cloud(lambda k: sky_weight(F.col(f"skyc{k}"))),
        "cloud_base": _cloud(lambda k: sky_weight(F.col(f"skyc{k}")) * height(k)), "rain": F.max(_known(F.contains("wxcodes", F.lit("RA")))),
        **asof.first_parts(anchored),
    }


def slice_parts() -> dict[str, Part]:
    """Everything that a slice is asked for, in parts that merge, over known instants."""
    hour = F.col("hour_local")
    top = F.struct(F.col("t_max").alias("t"), (-F.unix_micros("valid")).alias("at"), hour.alias("h"))
    directions = {f"{name}__{k}": total(F.when(of, F.col(f"all__{k}"))) for name, of in (("early", hour <= 12), ("late", hour >= 15)) for k in "sn"}
    same = ("p01i__s", "depression__s", "depression__n", "flow__s", "flow__n", "all__s", "all__n", "circular__s", "circular__c")
    return {
        "n_slice": total(F.col("n")), **{c: total(F.col(c)) for c in same}, "tmin_so_far": least(F.col("t_min")), "feature_max_ts": most(F.col("valid")),
        "max_delta": most(F.col("delta_t_per_h")), "top": most(top), **directions, **{c: most(F.col(c)) for c in ("cloud_cover", "cloud_base", "rain")},
    }


def _slice_columns() -> list[Column]:
    """The slice's values from its merged parts."""
    return [
        F.col("n_slice"), F.coalesce("p01i__s", F.lit(0.0)).alias("p01i_sum"), average("depression").alias("depression"), F.col("tmin_so_far"),
        F.col("feature_max_ts"), F.col("max_delta"), F.coalesce(average("flow"), F.lit(0.0)).alias("nw_strength"), F.col("top.h").alias("tmax_hour_so_far"),
        average("early").alias("early_dir"), average("late").alias("late_dir"), circular_mean().alias("circular_dir"), average("all").alias("mean_dir"),
        F.col("cloud_cover"), F.col("cloud_base"), F.coalesce("rain", F.lit(False)).alias("has_rain"),
    ]


def slice_aggregates(obs: DataFrame, config: Config = Config(), anchored: tuple[str, ...] = ()) -> DataFrame:
    """(day, cp, cp_utc, cp_hour, values) of what is known at each checkpoint; anchors a6 to a18 of `anchored` columns."""
    return slices_of(asof.at_instants(ensure_columns(obs, LAYERS), known_parts(anchored), config), config, anchored)


def slices_of(made: DataFrame, config: Config = Config(), anchored: tuple[str, ...] = ()) -> DataFrame:
    """`slice_aggregates` from the instants of the reports, `asof.at_instants` with `known_parts`."""
    rows = asof.known_instants(made, config)
    anchors = {f"a{a}": asof.anchor_part(a, anchored) for a in config.anchors} if anchored else {}
    made = asof.prefix_slices(rows, slice_parts() | anchors, config)
    values = [asof.anchor_value(a, f"a{a}").alias(f"a{a}") for a in config.anchors] if anchored else []
    return made.select(*config.day, "cp", "cp_utc", "cp_hour", *_slice_columns(), *values)


def wind_by_slice(obs: DataFrame, config: Config = Config()) -> DataFrame:
    """(day, cp, circular_dir, south_mean, north_mean) of each slice."""
    parts = circular_parts() | sector_parts("south", 135, 225) | sector_parts("north", 315, 45)
    seen = asof.at_instants(obs, {"n": F.count_if(asof.is_known()), **parts}, config).where("n > 0")
    made = asof.prefix_slices(seen, _sums(parts), config)
    return made.select(*config.day, "cp", circular_mean().alias("circular_dir"), average("south").alias("south_mean"), average("north").alias("north_mean"))


def regime(few: str) -> Column:
    """The regime of slice aggregates; `few` is the label below three reports."""
    foehn = F.col("nw_strength") * F.coalesce("depression", F.lit(0.0))
    change = F.coalesce("max_delta", F.lit(0.0))
    return (
        F.when(F.coalesce("n_slice", F.lit(0)) < 3, few)
        .when((F.col("p01i_sum") > 0.01) | (change < -2.0), "disrupted")
        .when(foehn > 60.0, "foehn_nw").when(F.col("tmax_hour_so_far") >= 18, "late_warming")
        .when(change > 1.0, "transition").otherwise("calm")
    )


def intraday_change() -> Column:
    return F.coalesce(F.abs(F.col("late_dir") - F.col("early_dir")) > 90, F.lit(False))


def regime_by_day(obs: DataFrame, config: Config = Config()) -> DataFrame:
    """The regime of each whole local date from all its reports with a temperature."""
    rows = asof.known_instants(asof.at_instants(ensure_columns(obs, LAYERS), known_parts(), config), config)
    days = rows.groupBy(*config.day).agg(*[p.make.alias(n) for n, p in slice_parts().items()])
    return days.select(*config.day, *_slice_columns()).select(*config.day, regime("calm").alias("regime"), "n_slice")


def _ends(column: str, config: Config) -> tuple[Column, Column, Column]:
    """First and last value of an anchored column over the anchors, and the hours between them."""
    pairs = F.array(*[F.struct(F.lit(a).alias("h"), F.col(f"a{a}.{column}").alias("v")) for a in config.anchors])
    have = F.filter(pairs, lambda x: x["v"].isNotNull())
    first, last = F.get(have, 0), F.try_element_at(have, F.lit(-1))
    return first["v"], last["v"], F.nullif(last["h"] - first["h"], F.lit(0))


def _trend(column: str, config: Config, factor: float = 1.0) -> Column:
    first, last, hours = _ends(column, config)
    return F.try_divide((last - first) * F.lit(factor), hours.cast("double"))


def day_sequence() -> Column:
    a, b, c = F.col("tmax_dminus1"), F.col("tmax_dminus2"), F.col("tmax_dminus3")
    return F.when(
        a.isNotNull() & b.isNotNull() & c.isNotNull(),
        F.when((F.abs(a - b) <= 1) & (F.abs(b - c) <= 1), "flat").when((c < b) & (b < a), "warming")
        .when((c > b) & (b > a), "cooling").when((c < b) & (b > a), "peaked").when((c > b) & (b < a), "troughed")
        .otherwise("flat"),
    )


def build_features(obs: DataFrame, labels: DataFrame, config: Config = Config()) -> DataFrame:
    """The feature table of the labelled dates, every feature from reports before its checkpoint.

    Slice values and anchors are aggregated once for each instant, then for each interval between
    checkpoints, and merged; a date without any earlier report keeps a row of nulls with regime
    `insufficient`.
    """
    return features_of(asof.at_instants(ensure_columns(obs, LAYERS), known_parts(ANCHORED), config), labels, config)


def instants(obs: DataFrame, config: Config = Config()) -> DataFrame:
    """All that labels and the feature table need of the reports, one row an instant, from one pass."""
    return asof.at_instants(ensure_columns(obs, LAYERS), own_parts() | known_parts(ANCHORED), config)


def features_of(made: DataFrame, labels: DataFrame, config: Config = Config()) -> DataFrame:
    """`build_features` from `instants`."""
    got = asof.require_causal(slices_of(made, config, ANCHORED))
    days = neighbour_days(labels, config=config)
    grid = days.withColumn("cp", F.explode(F.array(*[F.lit(c) for c in config.cps])))
    rows = grid.join(got, [*config.day, "cp"], "left")
    some = F.col("n_slice").isNotNull()
    label = regime("insufficient")
    north = F.coalesce(in_sector(F.col("circular_dir"), 315, 45), F.lit(False))
    t6, t9, t12 = (F.col(f"a{h}.tmp_c_int") for h in (6, 9, 12))
    flat = F.coalesce(F.greatest(t6, t9, t12) - F.least(t6, t9, t12) <= 0.5, F.lit(False))
    all3 = t6.isNotNull() & t9.isNotNull() & t12.isNotNull()
    turned = F.abs(F.col("late_dir") - F.col("early_dir"))
    s_to_n = F.col("early_dir").between(135, 225) & in_sector(F.col("late_dir"), 315, 45)
    a0, a1, _ = _ends("alti", config)
    falls = F.coalesce((a0 - a1) * HPA_PER_INHG >= 0.5, F.lit(False))
    flag = lambda c: F.when(some, F.coalesce(c, F.lit(False)).cast("int"))
    flags = F.when(F.col("n_slice") >= 3, F.to_json(F.struct(intraday_change().alias("intraday_regime_change"))))
    return rows.withColumn("regime_label", label).select(
        *config.day, "cp", "regime_label", F.coalesce(flags, F.lit("{}")).alias("regime_flags"),
        _trend("tmp_c_int", config).alias("slope_3h"),
        F.lit(None).cast("double").alias("hours_to_expected_peak"),
        F.col("depression").alias("dewpoint_depression"),
        F.when(some, F.col("tmax_dminus1")).alias("tmax_dminus1"),
        (F.col("tmin_so_far") - F.col("tmax_dminus1")).alias("tmin_delta_tmax"),
        F.when(some, (F.col("n_slice") >= 3) & intraday_change()).alias("intraday_regime_change"),
        F.when(some, F.when(s_to_n, F.least(turned, 360 - turned)).otherwise(0.0)).alias("wind_dir_change_s_to_n"),
        F.when(some, day_sequence()).alias("day_sequence_pattern"),
        flag((F.col("p01i_sum") > 0.01) | F.col("has_rain")).alias("precip_disruption"),
        F.lit(None).cast("double").alias("tmax_hour_by_regime_month"),
        F.col("cloud_cover").alias("cloud_cover_suppression"),
        _trend("alti", config, HPA_PER_INHG).alias("pressure_trend_3h"),
        (F.col("nw_strength") * F.col("depression")).alias("foehn_score"),
        F.lit(None).cast("double").alias("late_warming_anomaly"),
        F.when(some, F.col("regime_label")).alias("regime_score_argmax"),
        ((t9 - t6) / 3.0).alias("warming_rate_06_09"),
        flag(all3 & flat & north & (F.col("cloud_cover") >= 0.75)).alias("nocturnal_plateau_flag"),
        F.lit(None).cast("double").alias("sst_maritime_cap"),
        _trend("dwp_c_int", config).alias("dewpoint_collapse_rate_3h"),
        flag(falls & (F.col("p01i_sum") == 0.0) & north).alias("prefrontal_warming_window"),
        flag((F.col("regime_label") == "foehn_nw") & F.col("circular_dir").between(280, 310)).alias("nw_sector_not_foehn"),
        F.col("cloud_base").alias("cloud_base_transparency"),
    )


def coverage_manifest(features: DataFrame, config: Config = Config(), catalog=CATALOG) -> DataFrame:
    """status, reason and non-null rate of every catalogued feature, from one pass."""
    blocked = dict(config.blocked)
    have = [c for _, c in catalog if c in features.columns]
    counted = features.agg(F.count("*").alias("n_total"), *[F.count(F.col(c)).alias(c) for c in have])
    entries = [
        F.struct(
            F.lit(h).alias("id"), F.lit(c).alias("feature"),
            F.lit("MISSING" if c not in have else "BLOCKED" if c in blocked else "computable").alias("status"),
            F.lit(blocked.get(c) if c in have else None).cast("string").alias("reason"),
            (F.col(c) if c in have else F.lit(0)).cast("long").alias("n_non_null"),
        )
        for h, c in catalog
    ]
    rows = counted.select("n_total", F.explode(F.array(*entries)).alias("e")).select("e.*", "n_total")
    rate = F.round(F.coalesce(F.try_divide(F.col("n_non_null"), F.col("n_total")), F.lit(0.0)), 4)
    return rows.withColumn("non_null_rate", rate)
