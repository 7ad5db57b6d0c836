"""The pipeline's steps as functions from tables to tables, written under one folder."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from obscast.config import Config
from obscast.functions.parse import annotate, parse_stats, parse_temperatures
from obscast.operators import board, challengers, features, inference, labels, splits
from obscast.sources import io


def ingest(raw: DataFrame, out: str, config: Config = Config(), dealt: bool = False) -> DataFrame:
    """Parsed observations and daily labels as tables, by station and year; returns the parse statistics.

    dealt: `raw` comes in ranges of time, as `io.write_table` has it.
    """
    spark = raw.sparkSession
    io.write_table(annotate(parse_temperatures(raw, config), config), f"{out}/obs", station=config.station, dealt=dealt)
    obs = io.read_table(spark, f"{out}/obs")
    io.write_table(labels.daily_labels(obs, config), f"{out}/labels", station=config.station)
    return parse_stats(obs)


def build_features(spark: SparkSession, out: str, config: Config = Config()) -> DataFrame:
    """The feature table and its coverage manifest (JSON); returns the manifest."""
    obs, days = io.read_table(spark, f"{out}/obs"), io.read_table(spark, f"{out}/labels")
    io.write_table(features.build_features(obs, days, config), f"{out}/features", station=config.station)
    manifest = features.coverage_manifest(io.read_table(spark, f"{out}/features"), config)
    io.write_json(manifest, f"{out}/feature_coverage", "latest")
    return manifest


def validate(
    spark: SparkSession, out: str, test_starts: list[dt.date] | None = None, config: Config = Config(),
    n_boot: int = 1000, n_p: int = 9999, run: str = "latest",
) -> DataFrame:
    """Hypothesis results and the contract (JSON) of every station; returns the results."""
    days, table = io.read_table(spark, f"{out}/labels"), io.read_table(spark, f"{out}/features")
    plan = splits.split_plan(days, test_starts, config=config)
    own = challengers.split_values(table, days, plan, config)
    values = challengers.long_features(table, config=config)
    errors = challengers.challenger_errors(values, challengers.targets(days, config), plan, own, config=config)
    results = inference.validate(errors, dict(table.dtypes), config, n_boot=n_boot, n_p=n_p)
    results.write.mode("overwrite").parquet(f"{out}/results")
    results = spark.read.parquet(f"{out}/results")
    io.write_json(inference.contract(results, config=config), f"{out}/contract", run)
    return results


def leaderboard(spark: SparkSession, out: str, as_of: dt.date, window_days: int = 30, config: Config = Config(), run: str = "latest") -> DataFrame:
    """The leaderboard (JSON) of the days before `as_of`, with the contract's features."""
    days, table = io.read_table(spark, f"{out}/labels"), io.read_table(spark, f"{out}/features")
    wanted = io.read_contract(spark, f"{out}/contract/run={run}", config.station).withColumnRenamed("feature_column", "feature")
    nulls = board.feature_nulls(challengers.long_features(table, config=config), days, wanted, as_of, window_days, config)
    errors = board.recent_errors(days, as_of, window_days, config)
    made = board.leaderboard(errors, table, as_of, window_days, nulls, config)
    io.write_json(made, f"{out}/leaderboard", run)
    return made
