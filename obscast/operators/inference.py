"""Bootstrap intervals and p-values, gates, false-discovery control and the contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obscast.config import CATALOG, Config
from obscast.functions.calendar import is_morning
from obscast.operators.bootstrap import intervals, replicates
from obscast.operators.metrics import safe_corr
from obscast.operators.ranks import value_ranks
from obscast.operators.stations import few, with_facts
from obscast.sources.shared import stored as cut

MIN_DAYS = 30


def bootstrap_ci(
    rows: DataFrame, keys: list[str], value: str, unit: list[str], n_boot: int = 1000, confidence: float = 0.95,
    seed: int = 42, statistic: Callable[[str], Column] | None = None,
) -> DataFrame:
    """(keys, point, lo, hi): percentile interval of a statistic, the mean if none is given."""
    point = rows.groupBy(*keys).agg((statistic or F.avg)(value).alias("point"))
    if statistic is None:
        found = intervals(rows, keys, value, unit, n_boot, 0, confidence, seed).drop("p_value")
    else:
        tail = (1 - confidence) / 2
        q = F.percentile("stat", F.array(F.lit(tail), F.lit(1 - tail)))
        found = replicates(rows, keys, value, unit, n_boot, seed, statistic).groupBy(*keys).agg(q.alias("q"))
        found = found.select(*keys, F.get("q", 0).alias("lo"), F.get("q", 1).alias("hi"))
    return with_facts(point, found, keys).select(*keys, "point", "lo", "hi")


def bootstrap_ci_diff(
    rows: DataFrame, keys: list[str], a: str, b: str, unit: list[str], n_boot: int = 1000, confidence: float = 0.95, seed: int = 42
) -> DataFrame:
    """(keys, point, lo, hi) of the mean of a - b over pairs; the job fails if one of a pair is missing."""
    wrong = F.raise_error(F.lit(f"{a} and {b} have not as many values")).cast("double")
    paired = F.when(F.col(a).isNull() != F.col(b).isNull(), wrong).otherwise(F.col(a) - F.col(b))
    return bootstrap_ci(rows.withColumn("__diff", paired).where("__diff is not null"), keys, "__diff", unit, n_boot, confidence, seed)


def bootstrap_p(rows: DataFrame, keys: list[str], value: str, unit: list[str], n_boot: int = 9999, seed: int = 42) -> DataFrame:
    """(keys, p_value) of the mean being above zero: (resamples not above + 1) / (resamples + 1)."""
    return intervals(rows, keys, value, unit, 1, n_boot, seed=seed).select(*keys, "p_value")


def _gate(name: str, passed: Column, bad: str, detail: Column) -> Column:
    passed = F.coalesce(passed, F.lit(False))
    return F.struct(
        F.lit(name).alias("gate"), passed.alias("passed"), F.when(passed, "OK").otherwise(bad).alias("status"), detail.alias("detail")
    )


def gates(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """`rows` with the five frozen gates and all_passed.

    Reads model_mae, null_mae, cp, fallback_rate, p50_mode_share, corr_diff, skill_ci_lo and,
    if there, corr_diff_lo (the evening gate's interval) and per_cp_passed.
    """
    c = F.col
    shown = lambda x: F.coalesce(F.format_number(c(x), 4), F.lit("none"))
    evening = c("corr_diff") >= 0.05
    if "corr_diff_lo" in rows.columns:
        evening = evening & (c("corr_diff_lo").isNull() | (c("corr_diff_lo") > 0))
    ahead = F.when(is_morning(c("cp"), config.tz, config.ref_date), c("skill_ci_lo") > 0.0).otherwise(evening)
    per_cp = c("per_cp_passed") if "per_cp_passed" in rows.columns else c("model_mae") < c("null_mae")
    out = F.array(
        _gate("G1", c("model_mae") < c("null_mae"), "KILL", F.concat_ws(" ", F.lit("mae"), shown("model_mae"), F.lit("null"), shown("null_mae"))),
        _gate("G2", F.coalesce("fallback_rate", F.lit(0.0)) <= 0.5, "NOT_OPERATIONAL", shown("fallback_rate")),
        _gate("G3", F.coalesce("p50_mode_share", F.lit(0.0)) <= 0.5, "COLLAPSE_ALERT", shown("p50_mode_share")),
        _gate("G4", ahead, "NOWCAST_SUSPECT", F.concat_ws(" ", F.lit("skill"), shown("skill_ci_lo"), F.lit("corr"), shown("corr_diff"))),
        _gate("G5", per_cp, "STAY_OUT", c("cp")),
    )
    return rows.withColumn("gates", out).withColumn("all_passed", F.forall("gates", lambda g: g["passed"]))


def statistics(days: DataFrame, keys: list[str], n_boot: int = 1000, n_p: int = 9999, seed: int = 42) -> DataFrame:
    """Effect, interval, p-value, errors, correlation gain and mode share by `keys`; groups of 30 days or more."""
    rows = days.withColumn("gain", F.col("base_error") - F.col("error"))
    found = rows.groupBy(*keys).agg(
        F.count("*").alias("n_days"), F.avg("gain").alias("effect_size"), F.avg("base_error").alias("null_mae"),
        F.avg("error").alias("model_mae"),
        (safe_corr(F.col("pred"), F.col("tmax"), 3, F.lit(0.0)) - safe_corr(F.col("base_pred"), F.col("tmax"), 3, F.lit(0.0))).alias("corr_diff"),
    ).where(F.col("n_days") >= MIN_DAYS)
    modes = rows.groupBy(*keys, F.bround("pred").alias("p")).agg(F.count("*").alias("c"))
    found = found.join(modes.groupBy(*keys).agg((F.max("c") / F.sum("c")).alias("p50_mode_share")), keys)
    # One set of replicates serves both: the first n_boot the interval, the first n_p the p-value.
    tested = rows.join(found.select(*keys), keys, "left_semi")
    drawn = intervals(tested, keys, "gain", ["date_local", "split"], n_boot, n_p, seed=seed)
    return found.join(drawn.withColumnsRenamed({"lo": "ci_lo", "hi": "ci_hi"}), keys)


def benjamini_hochberg(results: DataFrame, alpha: float = 0.05, compat: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """`results` with fdr_adjusted: p-values up to the largest that is below its rank's line.

    by: columns that tell families apart, one family if none. compat counts results without a
    p-value too and stops at the first failure. Ranks come from counts of different p-values,
    so a family may have any number of results.
    """
    by = [*by]
    p = F.col("p_value")
    ranks = value_ranks(results, by, "p_value")
    if compat:
        ranks = with_facts(ranks, results.groupBy(*by).agg(F.count("*").alias("m")), by)
        # Of equal p-values the first rank fails if any does.
        edge = F.min(F.when(p > (F.col("before") + 1) / F.col("m").cast("double") * alpha, p))
    else:
        edge = F.max(F.when(p <= (F.col("before") + F.col("n")) / F.col("total").cast("double") * alpha, p))
    lines = ranks.groupBy(*by).agg(edge.alias("__edge"))
    lines = results.select(*by).distinct().join(lines, by, "left") if by else lines
    passed = p.isNotNull() & F.coalesce(p < F.col("__edge"), F.lit(True)) if compat else F.coalesce(p <= F.col("__edge"), F.lit(False))
    return with_facts(results, lines, by).withColumn("fdr_adjusted", passed).drop("__edge")


def validate(
    days: DataFrame, kinds: dict[str, str], config: Config = Config(), alpha: float = 0.05, n_boot: int = 1000,
    n_p: int = 9999, catalog=CATALOG, null_mae: DataFrame | None = None,
) -> DataFrame:
    """One row per station, hypothesis, checkpoint and regime with its statistics, gates and status.

    days: challenger_errors; kinds: types of the feature table's columns; null_mae: (cp,
    null_mae) of the best baseline, persistence on the same days if not given. Regimes are
    tested for what passes over all days; then the false-discovery rate is held over both, for
    each station by itself.
    """
    spark, st = days.sparkSession, [*config.station]
    blocked = dict(config.blocked)
    reason = lambda c: "absent" if c not in kinds else None if kinds[c] != "string" and kinds[c] != "boolean" else "unsupported_type"
    rows = [(h, c, cp, blocked.get(c), reason(c)) for h, c in catalog for cp in config.cps]
    grid = spark.createDataFrame(rows, "id string, feature string, cp string, blocked_reason string, reason string")
    days = cut(days)
    if st:
        grid = days.select(*st).distinct().crossJoin(F.broadcast(grid))  # the catalogue, once a station
    pair = [*st, "feature", "cp"]
    open_days = days.where(~F.col("feature").isin(*blocked)) if blocked else days

    def judged(found: DataFrame) -> DataFrame:
        if null_mae is not None:
            found = found.drop("null_mae").join(few(null_mae, st), [*st, "cp"])
        found = found.withColumn("skill_ci_lo", F.col("ci_lo")).withColumn("fallback_rate", F.lit(0.0))
        return gates(found.withColumn("per_cp_passed", F.col("model_mae") < F.col("null_mae")), config)

    # Each step's few result rows took many resamples and a deep plan: written and read again.
    all_days = cut(judged(statistics(open_days.withColumn("regime", F.lit("all")), [*pair, "regime"], n_boot, n_p, config.seed)))
    good = all_days.where("ci_lo > 0 and all_passed").select(*pair)
    parts = open_days.where("regime not in ('all', 'unknown', '')").join(few(good, st), pair, "left_semi")
    by_regime = cut(judged(statistics(parts, [*pair, "regime"], n_boot, n_p, config.seed)))
    tested = all_days.unionByName(by_regime).join(few(grid.drop("blocked_reason", "reason").distinct(), st), pair)
    missing = grid.join(all_days.select(*pair), pair, "left_anti")
    results = tested.unionByName(missing.withColumn("regime", F.lit("all")).withColumn("n_days", F.lit(0)), allowMissingColumns=True)
    results = benjamini_hochberg(results, alpha, by=config.station)
    passed = (F.col("ci_lo") > 0) & F.col("fdr_adjusted") & F.col("all_passed")
    status = F.when(F.col("blocked_reason").isNotNull(), "BLOCKED").when(passed, "validated").otherwise("rejected")
    return results.withColumn("passes", F.coalesce(F.col("ci_lo") > 0, F.lit(False))).withColumn("status", status)


def contract(results: DataFrame, alpha: float = 0.05, config: Config = Config()) -> DataFrame:
    """One row a station: validated features, blocked ones, and counts; values to six decimals."""
    six = [F.round(c, 6).alias(c) for c in ("effect_size", "ci_lo", "ci_hi", "p_value")]
    keep = F.struct("id", F.col("feature").alias("feature_column"), "cp", "regime", *six)
    hold = F.struct("id", F.col("feature").alias("feature_column"), "cp", F.col("blocked_reason").alias("reason"))
    is_ = lambda s: F.col("status") == s
    return results.groupBy(*config.station).agg(
        F.sort_array(F.collect_list(F.when(is_("validated"), keep))).alias("validated_features"),
        F.sort_array(F.collect_list(F.when(is_("BLOCKED"), hold))).alias("blocked"),
        F.lit(alpha).alias("alpha"), F.count_if(~is_("BLOCKED")).alias("n_hypotheses_tested"),
        F.count_if(is_("validated")).alias("n_validated"), F.count_if(is_("rejected")).alias("n_rejected"),
    )
