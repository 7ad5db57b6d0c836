"""Sources and sinks: observation CSV, Parquet tables, JSON artifacts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Observation columns and their types (fixed names).
RAW_OBS = {
    "valid": "timestamp", "metar": "string", "tmpf": "double", "dwpf": "double", "sknt": "double", "drct": "double",
    "alti": "double", "p01i": "double", "skyc1": "string", "skyc2": "string", "skyc3": "string", "skyc4": "string",
    "skyl1": "string", "skyl2": "string", "skyl3": "string", "skyl4": "string", "wxcodes": "string",
}
#: Tokens that stand for no value (fixed).
NULL_TOKENS = ("", "M", "MM")


def read_observations_csv(spark: SparkSession, path: str, kinds: dict[str, str] | None = None) -> DataFrame:
    """Observations of one or many CSV files: `#` comments, header, null tokens, lenient types.

    Files are split by the reader; values that do not parse become null.
    """
    kinds = kinds or RAW_OBS
    raw = spark.read.option("header", True).option("comment", "#").option("enforceSchema", False).csv(
        path, schema=", ".join(f"`{c}` string" for c in kinds)
    )

    def typed(c: str, kind: str) -> Column:
        value = F.when(~F.col(c).isin(*NULL_TOKENS), F.col(c))
        if kind == "timestamp":
            return F.try_to_timestamp(value, F.lit("yyyy-MM-dd HH:mm")).alias(c)
        return (value if kind == "string" else value.try_cast(kind)).alias(c)

    return raw.select(*[typed(c, kind) for c, kind in kinds.items()])


def _within(column: str, kind: str, start: str, end: str) -> Column:
    """`start` <= the column's date <= `end`, as bounds that a Parquet reader can use."""
    after = dt.date.fromisoformat(end) + dt.timedelta(days=1)
    return (F.col(column) >= F.lit(start).cast(kind)) & (F.col(column) < F.lit(after.isoformat()).cast(kind))


def between_dates(obs: DataFrame, start: str, end: str, station: str | None = None) -> DataFrame:
    """Rows from `start` to `end`, both included, of a station if the table has several."""
    out = obs.where(_within("valid", dict(obs.dtypes)["valid"], start, end))
    return out.where(F.col("station") == station) if station is not None else out


def _folder(column: str) -> str:
    return f"part_{column}"


def write_table(df: DataFrame, path: str, date: str = "date_local", mode: str = "overwrite", station: tuple[str, ...] = (), dealt: bool = False) -> None:
    """A Parquet table in folders by `station` columns and the year of `date`, which `read_table` prunes by.

    Folders are filled by rebalanced tasks: a large one is split, small ones are not cut up by
    every task. Station values stay in the files; the folder's name has a prefix, so that it is
    never taken for a number. dealt: rows come in ranges of time, so that a task fills few folders
    as it is, and texts are not shuffled.
    """
    folders = {_folder(c): F.concat(F.lit("="), F.col(c).cast("string")) for c in station}
    rows = df.withColumns({**folders, "year": F.year(date)})
    names = [*folders, "year"]
    rows = rows if dealt else rows.hint("rebalance", *[F.col(c) for c in names])
    rows.write.mode(mode).partitionBy(*names).parquet(path)


def read_table(
    spark: SparkSession, path: str, start: str | None = None, end: str | None = None, date: str = "date_local", **stations: str
) -> DataFrame:
    """A table of `write_table`; with dates or stations only the folders that can hold such rows are read.

    start, end: first and last date of `date`, a date or an instant; folders go by the date
    that the table was written by, which is taken to lie a day away from an instant's at most.
    stations: values of station columns by name.
    """
    rows = spark.read.parquet(path)
    inner = [c for c in rows.columns if c == "year" or c.startswith("part_")]
    kind = dict(rows.dtypes).get(date)
    apart = dt.timedelta(days=0 if kind == "date" else 1)
    low, high = start or "0001-01-02", end or "9999-12-30"
    if start or end:
        years = [(dt.date.fromisoformat(x) + sign * apart).year for x, sign in ((low, -1), (high, 1))]
        rows = rows.where(F.col("year").between(*years) & _within(date, kind, low, high))
    for c, value in stations.items():
        rows = rows.where(F.col(c) == value)
        if _folder(c) in inner:
            rows = rows.where(F.col(_folder(c)) == "=" + value)
    return rows.drop(*inner)


def write_json(df: DataFrame, path: str, run: str, mode: str = "overwrite") -> str:
    """JSON lines under a folder named for the run; returns its path."""
    where = f"{path.rstrip('/')}/run={run}"
    df.write.mode(mode).json(where)
    return where


def read_contract(spark: SparkSession, path: str, station: tuple[str, ...] = ()) -> DataFrame:
    """The validated features of all regimes together, from contract JSON, with their station."""
    kinds = "id string, feature_column string, cp string, regime string, effect_size double, ci_lo double, ci_hi double, p_value double"
    own = "".join(f"`{c}` string, " for c in station)
    found = spark.read.schema(f"{own}validated_features array<struct<{kinds.replace(' string', ': string').replace(' double', ': double')}>>").json(path)
    return found.select(*station, F.explode("validated_features").alias("f")).select(*station, "f.*").where(F.coalesce("regime", F.lit("all")) == "all")
