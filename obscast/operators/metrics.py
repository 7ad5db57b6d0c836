"""Forecast scores as grouped aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obscast.functions.settle import settle
from obscast.operators.ranks import value_ranks


def safe_corr(x: Column, y: Column, least: int, otherwise: Column) -> Column:
    """Pearson correlation of the complete pairs; `otherwise` below `least` pairs, null without variance."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    r = F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))
    return F.when(F.count(x) < least, otherwise).when(varies, r)


def sql_corr(x: Column, y: Column) -> Column:
    """Pearson correlation as SQL's corr has it: of any pair on, NaN where one side does not vary, null without a pair."""
    some, r = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)) > 0, safe_corr(x, y, 1, F.lit(None).cast("double"))
    return F.when(some, F.coalesce(r, F.lit(float("nan"))))


def _quotient(x: Column, y: Column) -> Column:
    """x / y of squares as IEEE has it: by zero an infinity, or NaN of two zeros."""
    return F.when(y != 0, F.try_divide(x, y)).when(x.isNotNull() & y.isNotNull(), F.when(x > 0, float("inf")).otherwise(float("nan")))


def point_metrics(rows: DataFrame, keys: list[str], pred: str, truth: str, base: str | None = None, ieee: bool = False) -> DataFrame:
    """mae, rmse, bias, corr, bracket_match and n of `pred`; skill against `base` if given.

    Where nothing varies there is no corr (nor below three pairs), and skill against an exact
    base is 0. ieee: both are as SQL's corr and division of doubles have them.
    """
    p, t = F.col(pred).cast("double"), F.col(truth).cast("double")
    error = p - t
    out = [
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(error).alias("bias"),
        (sql_corr(p, t) if ieee else safe_corr(p, t, 3, F.lit(None).cast("double"))).alias("corr"),
        F.avg((settle(p) == settle(t)).cast("double")).alias("bracket_match"), F.count(error).alias("n"),
    ]
    if base is not None:
        off = F.col(base).cast("double") - t
        own, other = F.avg(error * error), F.avg(off * off)
        skill = 1 - _quotient(own, other) if ieee else F.when(other == 0, 0.0).otherwise(1 - F.try_divide(own, other))
        out.append(skill.alias("skill"))
    return rows.groupBy(*keys).agg(*out)


def rps(dist: DataFrame, keys: list[str], k: str, prob: str, truth: str) -> DataFrame:
    """Ranked probability score: mean squared distance of the CDF from the step at the truth."""
    order = Window.partitionBy(*keys).orderBy(k).rowsBetween(Window.unboundedPreceding, 0)
    step = F.sum(prob).over(order) - (F.col(k) >= F.col(truth)).cast("double")
    return dist.withColumn("__d", step).groupBy(*keys).agg(F.avg(F.col("__d") * F.col("__d")).alias("rps"))


def crps(members: DataFrame, keys: list[str], value: str, truth: str) -> DataFrame:
    """CRPS of an ensemble by ranks, for ensembles of any size: no task sorts a whole one.

    Members without a value are left out; `truth` is the ensemble's.
    """
    apart = F.sum(F.abs(F.col(value) - F.col(truth))).alias("apart")
    ranked = value_ranks(members, keys, value, apart)
    n, total = F.col("n"), F.col("total").cast("double")
    # n equal values take the ranks from before + 1 on; their factors 2 i - total - 1 add up to this.
    spread = F.sum(F.col(value) * (n * (2 * F.col("before") + n - F.col("total"))) / (total * total))
    return ranked.groupBy(*keys).agg((F.sum("apart") / F.max(total) - spread).alias("crps"))
