"""Baseline forecasts fitted on training days only, and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obscast.config import Config
from obscast.functions.parse import ensure_columns
from obscast.functions.settle import settle
from obscast.operators.labels import k_cp_long
from obscast.operators.metrics import rps
from obscast.operators.stations import few, with_facts

#: Stand-ins for a month without training days (fixed values).
EMPTY_MONTH = {"mean": 15.0, "p10": 10.0, "p50": 15.0, "p90": 20.0}


def climatology_doy(train: DataFrame, window_days: int = 31, config: Config = Config()) -> DataFrame:
    """(station, doy, tmax_dec) for 1 to 366: day means, gaps interpolated, then a circular moving mean.

    Gaps at the ends take the nearest mean; the ring has 367 slots, slot 0 repeats slot 366. A
    station's ring is one array, filled and smoothed in place. Stations without a day have none;
    without stations an empty history has a ring of nulls.
    """
    st = [*config.station]
    means = train.groupBy(*st, F.dayofyear("date_local").alias("doy")).agg(F.avg("tmax_int").alias("mean")).where("mean is not null")
    known = means.groupBy(*st).agg(F.array_sort(F.collect_list(F.struct("doy", "mean"))).alias("known"))
    first, last = F.get("known", 0), F.try_element_at("known", F.lit(-1))

    def between(a: Column, b: Column) -> Column:
        slope = (b["mean"] - a["mean"]) / (b["doy"] - a["doy"]).cast("double")
        return F.transform(F.sequence(a["doy"], b["doy"] - 1), lambda d: a["mean"] + slope * (d - a["doy"]))

    n = F.size("known")
    gaps = F.zip_with(F.slice("known", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("known", F.lit(2), F.greatest(n - 1, F.lit(0))), between)
    filled = F.concat(F.array_repeat(first["mean"], first["doy"] - 1), F.flatten(gaps), F.array_repeat(last["mean"], F.lit(367) - last["doy"]))
    rings = known.select(*st, filled.alias("v")).select(*st, F.concat(F.array(F.try_element_at("v", F.lit(366))), F.col("v")).alias("ring"))
    half = window_days // 2
    offsets = F.sequence(F.lit(-half), F.lit(half))

    def smooth(d: Column) -> Column:
        around = F.transform(offsets, lambda o: F.get("ring", F.pmod(d + o, F.lit(367))))
        return F.aggregate(around, F.lit(0.0), lambda x, y: x + y) / (2 * half + 1)

    slots = F.transform(F.sequence(F.lit(1), F.lit(366)), lambda d: F.struct(d.alias("doy"), smooth(d).alias("tmax_dec")))
    return rings.select(*st, F.inline(slots))


def climatology_month(train: DataFrame, config: Config = Config()) -> DataFrame:
    """(station, month, mean, p10, p50, p90) for all twelve months of each station."""
    st = [*config.station]
    q = F.percentile("tmax_int", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    found = train.groupBy(*st, F.month("date_local").alias("month")).agg(F.avg("tmax_int").alias("mean"), q.alias("q"))
    one = train.select(*st).distinct() if st else train.sparkSession.range(1)
    months = one.select(*st, F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    rows = months.join(few(found, st), [*st, "month"], "left").select(
        *st, "month", "mean", F.get("q", 0).alias("p10"), F.get("q", 1).alias("p50"), F.get("q", 2).alias("p90")
    )
    return rows.fillna(EMPTY_MONTH)


def fit_climatology(train: DataFrame, min_days: int = 365, window_days: int = 31, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """Both climatologies. One station needs `min_days` days, else it is an error; of several
    stations those with fewer are left out."""
    if config.station:
        st = [*config.station]
        long = train.groupBy(*st).agg(F.count("*").alias("__n")).where(F.col("__n") >= min_days).select(*st)
        train = train.join(long, st, "left_semi")
    elif (n := train.count()) < min_days:
        raise ValueError(f"{min_days} training days are needed, there are {n}")
    return climatology_doy(train, window_days, config), climatology_month(train, config)


def climatology_for(days: DataFrame, doy: DataFrame, month: DataFrame, config: Config = Config()) -> DataFrame:
    """`days` with tmax_dec (the month's mean where a day of the year has none), p10 and p90."""
    st = [*config.station]
    named = month.select(*st, F.col("month").alias("__m"), F.col("mean").alias("__mean"), "p10", "p90")
    out = days.withColumns({"__d": F.dayofyear("date_local"), "__m": F.month("date_local")})
    out = out.join(few(doy.withColumnRenamed("doy", "__d"), st), [*st, "__d"], "left").join(few(named, st), [*st, "__m"], "left")
    return out.withColumn("tmax_dec", F.coalesce("tmax_dec", "__mean")).drop("__d", "__m", "__mean")


def empirical_counts(train: DataFrame, config: Config = Config()) -> DataFrame:
    """(station, month, cp, k_cp, tmax_int, n); rows with a null k_cp count all values of it."""
    st = [*config.station]
    rows = train.select(*config.day, "tmax_int").join(k_cp_long(train, config).where("k_cp is not null"), [*config.day])
    rows = rows.select(*st, F.month("date_local").alias("month"), "cp", "k_cp", "tmax_int")
    return rows.groupingSets(
        [[*st, "month", "cp", "k_cp", "tmax_int"], [*st, "month", "cp", "tmax_int"]], *st, "month", "cp", "k_cp", "tmax_int"
    ).agg(F.count("*").alias("n"))


def empirical_dist(
    keys: DataFrame, counts: DataFrame, support: DataFrame, min_bucket: int = 30, alpha: float = 1.0, config: Config = Config()
) -> DataFrame:
    """(station, month, cp, k_cp, k, prob, source) for each distinct key and each k of its station's support.

    Buckets of `min_bucket` days serve themselves, others their month and checkpoint, and
    without those all k are equally likely. keys: station, month, cp, k_cp; support: station
    and k, whole degrees. A station's support is one sorted array that joins its keys.
    """
    st = [*config.station]
    month, bucket = [*st, "month", "cp"], [*st, "month", "cp", "k_cp"]
    keys = keys.select(*bucket).distinct()
    own = counts.where("k_cp is not null")
    every = counts.where("k_cp is null").drop("k_cp")
    own_n = own.groupBy(*bucket).agg(F.sum("n").alias("own_n"))
    every_n = every.groupBy(*month).agg(F.sum("n").alias("every_n"))
    keyed = keys.join(own_n, bucket, "left").join(few(every_n, st), month, "left")
    enough = F.coalesce(F.col("own_n") >= min_bucket, F.lit(False))
    source = F.when(enough, "conditional").when(F.col("every_n").isNotNull(), "fallback_marginal").otherwise("uniform")
    ks = support.groupBy(*st).agg(F.array_sort(F.collect_set(F.col("k").cast("long"))).alias("ks"))
    keyed = with_facts(keyed.withColumn("source", source), ks, st)
    rows = keyed.select("*", F.size("ks").alias("ways"), F.explode("ks").alias("k")).drop("ks")
    rows = rows.join(own.select(*bucket, F.col("tmax_int").alias("k"), F.col("n").alias("own")), [*bucket, "k"], "left")
    rows = rows.join(every.select(*month, F.col("tmax_int").alias("k"), F.col("n").alias("every")), [*month, "k"], "left")
    size = alpha * F.col("ways")
    p = (
        F.when(F.col("source") == "conditional", (F.coalesce("own", F.lit(0)) + alpha) / (F.col("own_n") + size))
        .when(F.col("source") == "fallback_marginal", (F.coalesce("every", F.lit(0)) + alpha) / (F.col("every_n") + size))
        .otherwise(F.lit(1.0) / F.col("ways"))
    )
    rows = rows.withColumn("p", p)
    total = F.sum("p").over(Window.partitionBy(*bucket))
    return rows.select(*bucket, "k", (F.col("p") / total).alias("prob"), "source")


def empirical_points(dist: DataFrame, config: Config = Config()) -> DataFrame:
    """(station, month, cp, k_cp, source, mode, p50) of each distribution; the lowest of equal modes."""
    bucket = [*config.station, "month", "cp", "k_cp"]
    order = Window.partitionBy(*bucket).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = dist.withColumn("cdf", F.sum("prob").over(order))
    return rows.groupBy(*bucket, "source").agg(
        F.max_by("k", F.struct("prob", -F.col("k"))).alias("mode"),
        F.min(F.when(F.col("cdf") >= 0.5 - 1e-12, F.col("k"))).alias("p50"),
    )


def _forecast(level: str, name: str, pred: Column, fallback: Column | None = None) -> Column:
    fell = F.lit(None) if fallback is None else fallback
    return F.struct(
        F.lit(level).alias("level"), F.lit(name).alias("name"), pred.cast("double").alias("pred"), fell.cast("double").alias("fallback")
    )


def score(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """Rows (level, name, day, cp, truth, pred, fallback) with their errors; an rps column is kept."""
    error = F.col("pred") - F.col("truth")
    return rows.select(
        *config.station, "level", "name", "date_local", "cp", "truth", "pred", error.alias("error"), F.abs(error).alias("abs_error"),
        (error * error).alias("sq_error"), (settle(F.col("pred")) == F.col("truth")).cast("double").alias("bracket_match"), "fallback",
        *[c for c in ("rps",) if c in rows.columns],
    )


def ladder_errors(
    labels: DataFrame, train: DataFrame, recent: DataFrame, support: DataFrame | None = None, config: Config = Config(), with_rps: bool = False
) -> DataFrame:
    """One row per day, checkpoint and baseline: L0 persistence, L1 previous day, L2 climatology, L4 empirical.

    labels: all complete days, for the previous day's maximum; the support comes from `train`.
    with_rps: the ranked probability score of L4's distribution, null for the others.
    """
    st, day = [*config.station], [*config.day]
    bucket = [*st, "month", "cp", "k_cp"]
    doy, month = fit_climatology(train, config=config)
    rows = recent.select(*day, F.col("tmax_int").alias("truth"))
    rows = rows.join(k_cp_long(recent, config).where("k_cp is not null"), day)
    before = labels.select(*st, F.date_add("date_local", 1).alias("date_local"), F.col("tmax_int").alias("before"))
    rows = rows.join(before, day, "left")
    rows = climatology_for(rows, doy, month, config).withColumn("month", F.month("date_local"))
    support = train.select(*st, F.col("tmax_int").alias("k")) if support is None else support
    dist = empirical_dist(rows, empirical_counts(train, config), support, config=config)
    rows = rows.join(empirical_points(dist, config).drop("p50"), bucket, "left")
    fell = F.when(F.col("source") == "conditional", 0.0).otherwise(1.0)
    # All baselines come from one row of a day and checkpoint.
    made = F.array(
        _forecast("L0", "persistence", F.col("k_cp")), _forecast("L1", "dminus1", F.col("before")),
        _forecast("L2", "climatology_doy", settle(F.col("tmax_dec"))),
        _forecast("L4", "empirical_conditional", F.col("mode"), fell),
    )
    out = rows
    if with_rps:
        # One score for each bucket and truth that occurs, not for each day.
        asked = rows.select(*bucket, "truth").distinct().join(dist, bucket)
        out = out.join(rps(asked, [*bucket, "truth"], "k", "prob", "truth"), [*bucket, "truth"], "left")
    out = out.select(*day, "cp", "truth", *(["rps"] if with_rps else []), F.explode(made).alias("f")).where("f.pred is not null").select("*", "f.*")
    if with_rps:
        out = out.withColumn("rps", F.when(F.col("level") == "L4", F.col("rps")))
    return score(out, config)


def missing_previous_days(labels: DataFrame, recent: DataFrame, config: Config = Config()) -> DataFrame:
    """(station, cp, n, n_missing): days with a value so far, and those of them whose previous day L1 lacks."""
    st = [*config.station]
    rows = k_cp_long(recent, config).where("k_cp is not null")
    before = labels.select(*st, F.date_add("date_local", 1).alias("date_local"), F.col("tmax_int").alias("before"))
    counts = [F.count("*").alias("n"), F.count_if(F.col("before").isNull()).alias("n_missing")]
    return rows.join(before, [*config.day], "left").groupBy(*st, "cp").agg(*counts)


def ladder_summary(errors: DataFrame, config: Config = Config()) -> DataFrame:
    """Scores by (station, level, name, cp), with the share of the most common prediction.

    rps averages the scores other than zero, 0 without any; corr_diff is a group's first one.
    Both columns are optional in `errors`: point baselines have neither.
    """
    errors = ensure_columns(errors, {"rps": "double", "corr_diff": "double"})
    keys = [*config.station, "level", "name", "cp"]
    modes = errors.groupBy(*keys, F.bround("pred").alias("p")).agg(F.count("*").alias("c"))
    share = modes.groupBy(*keys).agg((F.max("c") / F.sum("c")).alias("p50_mode_share"))
    found = errors.groupBy(*keys).agg(
        F.avg("abs_error").alias("mae"), F.sqrt(F.avg("sq_error")).alias("rmse"), F.avg("error").alias("bias"),
        F.avg("bracket_match").alias("bracket_match"), F.avg("fallback").alias("fallback_rate"), F.count("*").alias("n"),
        F.coalesce(F.avg(F.when(F.col("rps") != 0, F.col("rps"))), F.lit(0.0)).alias("rps"),
        F.min_by("corr_diff", F.when(F.col("corr_diff").isNotNull(), F.col("date_local"))).alias("corr_diff"),
    )
    return found.join(share, keys)


def best_null(summary: DataFrame, config: Config = Config()) -> DataFrame:
    """The baseline of least error at each station's checkpoint, the lower level of equals."""
    best = F.min_by(F.struct("level", "name", "mae"), F.struct("mae", "level"))
    key = [*config.station, "cp"]
    return summary.where("level <> 'feature'").groupBy(*key).agg(best.alias("b")).select(*key, "b.*")


def segment_mae(errors: DataFrame, regimes: DataFrame, config: Config = Config()) -> DataFrame:
    """Error by (station, regime, level, name, cp); days without a regime are `unknown`."""
    key = [*config.day, "cp"]
    rows = errors.join(regimes.select(*key, F.col("regime_label").alias("regime")), key, "left")
    rows = rows.withColumn("regime", F.coalesce("regime", F.lit("unknown")))
    return rows.groupBy(*config.station, "regime", "level", "name", "cp").agg(F.avg("abs_error").alias("mae"), F.count("*").alias("n"))


def segments(results: DataFrame, by: list[str]) -> DataFrame:
    """`results` with a segment key, the values of `by` joined by underscores."""
    return results.withColumn("segment", F.concat_ws("_", *[F.col(c).cast("string") for c in by]))
