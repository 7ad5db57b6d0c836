"""Univariate least-squares challengers per split, feature and checkpoint, in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obscast.config import HYPOTHESES, Config
from obscast.functions.calendar import cp_to_utc, local_time
from obscast.operators.labels import k_cp_long
from obscast.operators.splits import in_range
from obscast.operators.stations import few, with_facts

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def long_features(features: DataFrame, columns=HYPOTHESES, config: Config = Config()) -> DataFrame:
    """(day, cp, regime_label, feature, value) of the numeric features that are not null."""
    kinds = dict(features.dtypes)
    names = [c for c in columns if kinds.get(c) in NUMERIC]
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in names])
    rows = features.select(*config.day, "cp", "regime_label", F.explode(pairs).alias("f"))
    return rows.select(*config.day, "cp", "regime_label", "f.*").where("value is not null")


def targets(labels: DataFrame, config: Config = Config()) -> DataFrame:
    """(date_local, cp, tmax, k_cp) of the complete days that have both."""
    done = labels.where("day_complete and tmax_int is not null")
    rows = k_cp_long(done, config).join(done.select(*config.day, F.col("tmax_int").alias("tmax")), [*config.day])
    return rows.where("k_cp is not null")


def least_squares(x: str, y: str) -> dict[str, Column]:
    """Aggregates slope and intercept; of a constant x the solution of least norm."""
    constant = F.min(x) == F.max(x)
    norm = 1 + F.avg(x) * F.avg(x)
    slope = F.try_divide(F.covar_pop(x, y), F.var_pop(x))
    return {
        "slope": F.when(constant, F.avg(x) * F.avg(y) / norm).otherwise(slope),
        "intercept": F.when(constant, F.avg(y) / norm).otherwise(F.avg(y) - slope * F.avg(x)),
    }


def fit_models(
    values: DataFrame, target: DataFrame, splits: DataFrame, own: DataFrame | None = None, min_values: int = 30, min_rows: int = 5,
    config: Config = Config(),
) -> DataFrame:
    """(station, split, feature, cp, slope, intercept, n_train) of remaining warming on each feature.

    Least squares needs sums only: they are taken once for each span between two borders of a
    station's training ranges, and a split adds up its spans, so no row is repeated for a
    split. own: `split_values`, features whose values depend on the split.
    """
    st = [*config.station]
    aim = target.select(*config.day, "cp", (F.col("tmax") - F.col("k_cp")).cast("double").alias("y"))
    # A station's borders are an array, two for each of its splits at most.
    border = F.explode(F.array("train_start", F.date_add("train_end", 1)))
    borders = splits.select(*st, border.alias("b")).groupBy(*st).agg(F.collect_set("b").alias("borders"))
    begin = F.array_max(F.filter("borders", lambda b: b <= F.col("date_local")))
    fit = F.col("y").isNotNull()
    x = F.when(fit, F.col("value"))
    sums = [
        F.count("value").alias("n_values"), F.count("y").alias("n"), F.sum(x).alias("sx"), F.sum("y").alias("sy"), F.sum(x * x).alias("sxx"),
        F.sum(x * F.col("y")).alias("sxy"), F.min(x).alias("lo"), F.max(x).alias("hi"),
    ]
    rows = with_facts(values.join(aim, [*config.day, "cp"], "left"), borders, st).withColumn("begin", begin)
    parts = rows.where("begin is not null").groupBy(*st, "feature", "cp", F.col("begin").alias("date_local")).agg(*sums)
    parts = in_range(parts, splits, "train", config).drop("date_local")
    key = [*st, "split", "feature", "cp"]
    if own is not None:
        train = own.where("part = 'train'").join(aim, [*config.day, "cp"], "left")
        parts = parts.unionByName(train.groupBy(*key).agg(*sums))
    total = parts.groupBy(*key).agg(
        *[F.sum(c).alias(c) for c in ("n_values", "n", "sx", "sy", "sxx", "sxy")], F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    n = F.col("n")
    mx, my = F.try_divide("sx", n), F.try_divide("sy", n)
    slope = F.try_divide(F.try_divide("sxy", n) - mx * my, F.try_divide("sxx", n) - mx * mx)
    constant, norm = F.col("lo") == F.col("hi"), 1 + mx * mx
    models = total.select(
        *key, "n_values", n.alias("n_train"),
        F.when(constant, mx * my / norm).otherwise(slope).alias("slope"), F.when(constant, my / norm).otherwise(my - slope * mx).alias("intercept"),
    )
    return models.where((F.col("n_values") >= min_values) & (F.col("n_train") >= min_rows)).drop("n_values")


def challenger_errors(
    values: DataFrame, target: DataFrame, splits: DataFrame, own: DataFrame | None = None, min_test_days: int = 30, config: Config = Config()
) -> DataFrame:
    """Per station and test day: errors of persistence and of the challenger, with the day's regime."""
    st, day = [*config.station], [*config.day]
    models = fit_models(values, target, splits, own, config=config)
    days = in_range(target.select(*day).distinct(), splits, "test", config).groupBy(*st, "split").agg(F.count("*").alias("d"))
    tested = in_range(values, splits, "test", config)
    if own is not None:
        tested = tested.unionByName(own.where("part = 'test'").drop("part"))
    tested = tested.join(few(days.where(F.col("d") >= min_test_days).select(*st, "split"), st), [*st, "split"])
    rows = tested.join(target, [*day, "cp"]).join(models, [*st, "split", "feature", "cp"])
    pred = F.col("k_cp") + F.col("intercept") + F.col("slope") * F.col("value")
    return rows.select(
        *st, "split", "date_local", "feature", "cp", F.col("regime_label").alias("regime"), "tmax",
        F.col("k_cp").cast("double").alias("base_pred"), pred.alias("pred"),
        F.abs(F.col("k_cp") - F.col("tmax")).cast("double").alias("base_error"), F.abs(pred - F.col("tmax")).alias("error"),
    )


#: Features that need statistics of a split's training days (fixed names).
FROM_TRAINING = ("hours_to_expected_peak", "tmax_hour_by_regime_month", "late_warming_anomaly")


def _trained(features: DataFrame, labels: DataFrame, splits: DataFrame, config: Config) -> DataFrame:
    """Training and test rows (part) of each split with the three features.

    Expected peak hour by regime and month minus the checkpoint's local hour, that hour, and
    how far the maximum so far lies from its training mean in its regime, in deviations.
    """
    st, day = [*config.station], [*config.day]
    rows = features.select(*day, "cp", "regime_label").withColumn("month", F.month("date_local"))
    rows = rows.join(targets(labels, config), [*day, "cp"])
    rows = rows.join(labels.select(*day, "tmax_hour"), day)
    train, test = (in_range(rows, splits, part, config).withColumn("part", F.lit(part)) for part in ("train", "test"))
    kind = [*st, "split", "cp", "regime_label"]
    hours = train.groupBy(*kind, "month").agg(F.avg("tmax_hour").alias("peak"))
    so_far = train.groupBy(*kind).agg(F.avg("k_cp").alias("m"), F.stddev_pop("k_cp").alias("s"))
    both = train.union(test).join(few(hours, st), [*kind, "month"], "left").join(few(so_far, st), kind, "left")
    hour = F.hour(local_time(cp_to_utc(F.col("date_local"), F.col("cp"), config.tz), config.tz))
    return both.select(
        *st, "split", "part", "date_local", "cp", "regime_label", (F.col("peak") - hour).alias("hours_to_expected_peak"),
        F.col("peak").alias("tmax_hour_by_regime_month"),
        ((F.col("k_cp") - F.col("m")) / F.greatest(F.col("s"), F.lit(1.0))).alias("late_warming_anomaly"),
    )


def train_stats(features: DataFrame, labels: DataFrame, splits: DataFrame, config: Config = Config()) -> DataFrame:
    """The three features that need training statistics, for the test rows of each split."""
    return _trained(features, labels, splits, config).where("part = 'test'").drop("part", "regime_label")


def split_values(features: DataFrame, labels: DataFrame, splits: DataFrame, config: Config = Config()) -> DataFrame:
    """(split, part, date_local, cp, regime_label, feature, value) of those three that are not null."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in FROM_TRAINING])
    rows = _trained(features, labels, splits, config)
    return rows.select(*config.station, "split", "part", "date_local", "cp", "regime_label", F.inline(pairs)).where("value is not null")
