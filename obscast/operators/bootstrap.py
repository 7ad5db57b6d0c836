"""Bootstrap whose replicates are sums: mergeable over tasks, no row meets a replicate.

A unit (a day) occurs in a replicate as often as a hash of seed, unit and replicate says: sixteen
16-bit numbers of one sha256 become Poisson counts of mean one. The statistic of a replicate is the
weighted mean, so a task adds up one vector of sums and one of weights for its part of a group,
and parts are added up in turn. Any engine that has sha256 draws the same.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A 16-bit number gives as many occurrences as bounds that it reaches: Poisson with mean one.
BOUNDS = tuple(int(65536 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(8))
#: Draws of one digest, rows of a group in one part, parts added up at once, units expanded at once.
DRAWS, PART, TOGETHER, UNITS = 16, 100_000, 64, 256


@lru_cache(maxsize=4096)
def occurrences(unit: str, n: int, seed: int) -> np.ndarray:
    """How often a unit occurs in each of the first n replicates."""
    digests = b"".join(hashlib.sha256(f"{seed}|{unit}|{b}".encode()).digest() for b in range(-(-n // DRAWS)))
    return np.searchsorted(BOUNDS, np.frombuffer(digests, ">u2")[:n], side="right").astype(np.uint8)


def occurrence(unit: Column, rep: Column, seed: int) -> Column:
    """The same as an expression, for one replicate."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), unit, F.floor(rep / DRAWS).cast("string")), 256)
    number = F.conv(F.substring(digest, (rep % DRAWS).cast("int") * 4 + 1, F.lit(4)), 16, 10).cast("int")
    return reduce(Column.__add__, [(number >= b).cast("int") for b in BOUNDS])


def _part_sums(n_boot: int, seed: int):
    def sums(rows: pd.DataFrame) -> pd.DataFrame:
        total, weight = np.zeros(n_boot), np.zeros(n_boot)
        units = rows.groupby("unit", sort=True)["v"].agg(["sum", "count"])
        for k in range(0, len(units), UNITS):
            some = units.iloc[k : k + UNITS]
            times = np.stack([occurrences(u, n_boot, seed) for u in some.index]).astype(np.float64)
            total += some["sum"].to_numpy(np.float64) @ times
            weight += some["count"].to_numpy(np.float64) @ times
        return pd.DataFrame([{"name": rows["name"].iloc[0], "part": int(rows["part"].iloc[0]), "total": total.tobytes(), "weight": weight.tobytes()}])

    return sums


def _added(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = rows.sort_values("part")
    return tuple(np.sum([np.frombuffer(b) for b in rows[c]], axis=0) for c in ("total", "weight"))


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    total, weight = _added(rows)
    return pd.DataFrame([{"name": rows["name"].iloc[0], "part": int(rows["part"].min()), "total": total.tobytes(), "weight": weight.tobytes()}])


def _statistics(rows: pd.DataFrame) -> np.ndarray:
    total, weight = _added(rows)
    return np.divide(total, weight, out=np.full(len(total), np.nan), where=weight > 0)


def _parts(rows: DataFrame, keys: list[str], value: str, unit: list[str], n_boot: int, seed: int) -> tuple[DataFrame, Column]:
    """Sums and weights of each part of a group, few for each group, and the keys from its name."""
    named = rows.where(F.col(value).isNotNull()).select(
        F.to_json(F.struct(*keys)).alias("name") if keys else F.lit("{}").alias("name"), F.concat_ws("|", *[F.col(u).cast("string") for u in unit]).alias("unit"),
        F.col(value).cast("double").alias("v"),
    )
    sizes = named.groupBy("name").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("unit"), F.ceil(F.col("n") / PART))
    # A number of tasks of its own: the work of a row is that of its replicates, not of its bytes.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = named.join(sizes, "name").select("name", part.alias("part"), "unit", "v").repartition(tasks, "name", "part")
    schema = "name string, part long, total binary, weight binary"
    parts = dealt.groupBy("name", "part").applyInPandas(_part_sums(n_boot, seed), schema)
    parts = parts.groupBy("name", F.floor(F.col("part") / TOGETHER).alias("next")).applyInPandas(_merge, schema)
    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.select(*keys).dtypes)
    return parts, F.from_json("name", kinds) if keys else None


def replicates(
    rows: DataFrame, keys: list[str], value: str, unit: list[str], n_boot: int, seed: int = 42,
    statistic: Callable[[str], Column] | None = None,
) -> DataFrame:
    """(keys, rep, stat): a statistic of each resample, the mean if none is given.

    Rows without a value are left out; a resample that draws no row has no mean, and no row
    under another statistic. Equal units of a group are drawn together.
    """
    if statistic is not None:
        number = F.concat_ws("|", *[F.col(u).cast("string") for u in unit])
        rows = rows.where(F.col(value).isNotNull()).select(*keys, number.alias("__unit"), F.col(value).alias("__v"))
        each = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("rep"))
        drawn = F.explode(F.array_repeat("__v", occurrence(F.col("__unit"), F.col("rep"), seed)))
        return each.select(*keys, "rep", drawn.alias("__x")).groupBy(*keys, "rep").agg(statistic("__x").alias("stat"))
    parts, named = _parts(rows, keys, value, unit, n_boot, seed)

    def spread(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"name": group["name"].iloc[0], "stats": _statistics(group)}])

    made = parts.groupBy("name").applyInPandas(spread, "name string, stats array<double>")
    made = made.select(*([named.alias("k")] if keys else []), F.posexplode("stats").alias("rep", "stat"))
    return made.select(*[f"k.{c}" for c in keys], "rep", F.nanvl("stat", F.lit(None).cast("double")).alias("stat"))


def intervals(
    rows: DataFrame, keys: list[str], value: str, unit: list[str], n_boot: int = 1000, n_p: int = 0, confidence: float = 0.95, seed: int = 42
) -> DataFrame:
    """(keys, lo, hi, p_value) of the mean: the first n_boot replicates give the interval, the first n_p the p-value.

    The p-value is (replicates not above zero + 1) / (n_p + 1), null with n_p = 0.
    """
    parts, named = _parts(rows, keys, value, unit, max(n_boot, n_p), seed)
    tails = [(1 - confidence) / 2, (1 + confidence) / 2]

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        stats = _statistics(group)
        first = stats[:n_boot][~np.isnan(stats[:n_boot])]
        lo, hi = np.quantile(first, tails) if len(first) else (None, None)
        p = ((stats[:n_p] <= 0).sum() + 1) / (n_p + 1) if n_p else None
        return pd.DataFrame([{"name": group["name"].iloc[0], "lo": lo, "hi": hi, "p_value": p}])

    made = parts.groupBy("name").applyInPandas(judge, "name string, lo double, hi double, p_value double")
    made = made.select(*([named.alias("k")] if keys else []), "lo", "hi", "p_value")
    return made.select(*[f"k.{c}" for c in keys], "lo", "hi", "p_value")
