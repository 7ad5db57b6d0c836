"""Leaderboard of baselines over a recent window, and features on top of persistence."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obscast.config import Config
from obscast.functions.settle import settle
from obscast.operators import baselines
from obscast.operators.challengers import least_squares, targets
from obscast.operators.inference import gates
from obscast.operators.metrics import safe_corr
from obscast.operators.stations import few


def recent_window(labels: DataFrame, as_of: dt.date, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """Complete days before the window, and of the window [as_of - days, as_of - 1]."""
    done, begin = labels.where("day_complete"), as_of - dt.timedelta(days=days)
    recent = done.where(F.col("date_local").between(F.lit(begin), F.lit(as_of - dt.timedelta(days=1))))
    return done.where(F.col("date_local") < F.lit(begin)), recent


def recent_errors(labels: DataFrame, as_of: dt.date, days: int = 30, config: Config = Config(), with_rps: bool = False) -> DataFrame:
    train, recent = recent_window(labels, as_of, days)
    return baselines.ladder_errors(labels.where("day_complete"), train, recent, config=config, with_rps=with_rps)


def baseline_gates(summary: DataFrame, config: Config = Config()) -> DataFrame:
    """Each baseline against the best one of its station and checkpoint."""
    key = [*config.station, "cp"]
    best = baselines.best_null(summary, config).select(*key, F.col("mae").alias("null_mae"))
    rows = summary.join(few(best, config.station), key).withColumnRenamed("mae", "model_mae")
    rows = rows.withColumns({"corr_diff": F.lit(None).cast("double"), "skill_ci_lo": F.lit(None).cast("double")})
    return gates(rows.withColumn("per_cp_passed", F.col("model_mae") <= F.col("null_mae")), config)


def feature_nulls(
    values: DataFrame, labels: DataFrame, wanted: DataFrame, as_of: dt.date, days: int = 30, config: Config = Config()
) -> DataFrame:
    """Persistence plus one feature over the window: mae, n and correlation gain; five days at least.

    values: long_features; wanted: (station, feature, cp) of a contract.
    """
    begin, pair = as_of - dt.timedelta(days=days), [*config.station, "feature", "cp"]
    rows = values.join(few(wanted.select(*pair).distinct(), config.station), pair)
    rows = rows.join(targets(labels, config), [*config.day, "cp"]).withColumn("y", (F.col("tmax") - F.col("k_cp")).cast("double"))
    fitted = [c.alias(k) for k, c in least_squares("value", "y").items()]
    models = rows.where(F.col("date_local") < F.lit(begin)).groupBy(*pair).agg(F.count("*").alias("n_train"), *fitted)
    test = rows.where(F.col("date_local").between(F.lit(begin), F.lit(as_of - dt.timedelta(days=1))))
    test = test.join(models.where("n_train >= 5"), pair)
    test = test.withColumn("pred", settle(F.col("k_cp") + F.col("intercept") + F.col("slope") * F.col("value")))
    none = F.lit(None).cast("double")
    gain = safe_corr(F.col("pred"), F.col("tmax"), 3, none) - safe_corr(F.col("k_cp"), F.col("tmax"), 3, none)
    found = test.groupBy(*pair).agg(
        F.avg(F.abs(F.col("pred") - F.col("tmax"))).alias("mae"), F.count("*").alias("n"), gain.alias("corr_diff")
    )
    return found.where("n >= 5")


def leaderboard(
    errors: DataFrame, regimes: DataFrame, as_of: dt.date, days: int = 30, features: DataFrame | None = None,
    config: Config = Config(),
) -> DataFrame:
    """One row a station and checkpoint: window, best baseline, entries with gates, segments, feature nulls."""
    key = [*config.station, "cp"]
    summary = baselines.ladder_summary(errors, config)
    gated = baseline_gates(summary, config)
    entry = F.struct("level", "name", F.col("model_mae").alias("mae"), "rmse", "bias", "bracket_match", "fallback_rate", "p50_mode_share", "n", "gates")
    board = gated.groupBy(*key).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    parts = baselines.segment_mae(errors, regimes, config).groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("regime", "level", "name", "mae", "n"))).alias("segments")
    )
    best = baselines.best_null(summary, config).select(*key, F.struct("level", "name", "mae").alias("best_null"))
    out = board.join(best, key).join(parts, key, "left")
    if features is not None:
        nulls = features.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("feature", "mae", "n", "corr_diff"))).alias("feature_nulls"))
        out = out.join(nulls, key, "left")
    start, end = as_of - dt.timedelta(days=days), as_of - dt.timedelta(days=1)
    return out.withColumns({"window_start": F.lit(start), "window_end": F.lit(end)})
