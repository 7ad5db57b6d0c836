"""Adapters from general tables to observation tables, in plain expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The instant of a report, a minute of the line item's day.
_VALID = "cast(l_shipdate as timestamp) + make_dt_interval(0, 0, cast((l_orderkey * 37 + l_linenumber * 211 + l_partkey * 13) % 1440 as int), 0) as valid"
_GROUP = "case when {x} < 0 then 'M' else '' end || lpad(cast(abs({x}) as string), 2, '0')"


def _line_items(spark: SparkSession, sf_dir: str, by_instant: bool = False, by_time: bool = False) -> DataFrame:
    """Line items with their instant, dealt out to all cores before texts are made and parsed where the file has few parts.

    by_instant: reports of an instant come to one task, whatever the file's parts, so that they
    are aggregated where they are parsed, and numbers are dealt rather than texts. by_time: in
    ranges of time, small enough to be sorted in memory, for tables in folders by year.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    columns = (
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_shipdate"
    )
    cores = spark.sparkContext.defaultParallelism
    rows = rows.selectExpr(*columns, _VALID)
    if by_time:
        return rows.repartitionByRange(max(cores, 16 * rows.rdd.getNumPartitions()), "valid")
    if by_instant:
        return rows.repartition(max(cores, rows.rdd.getNumPartitions()), "valid")
    return rows.repartition(cores, "l_orderkey", "l_linenumber") if rows.rdd.getNumPartitions() < cores else rows


def lineitem_observations(spark: SparkSession, sf_dir: str, by_instant: bool = False, by_time: bool = False) -> DataFrame:
    """Seven years of reports derived from line items; `obs_id` breaks ties in time."""
    rows = _line_items(spark, sf_dir, by_instant, by_time)
    rows = rows.selectExpr(
        "*", "cast(l_quantity as int) as t", "cast(l_quantity as int) - 2 - cast(l_partkey % 9 as int) as d",
    )
    return rows.selectExpr(*_report("'NZWN'", ""))


#: Stations of `station_observations`.
STATIONS = ("NZWN", "NZCH")


def station_observations(spark: SparkSession, sf_dir: str, by_instant: bool = False, by_time: bool = False) -> DataFrame:
    """Reports of two stations, with an effect to be found at the first and none at the second.

    Afternoons are warmer than mornings by twice a number of the day. At the first station all
    of the day's dewpoint depressions tell that number, at the second they tell another one.
    """
    rows = _line_items(spark, sf_dir, by_instant, by_time)
    rows = rows.selectExpr("*", f"explode(array{STATIONS}) as station", "from_utc_timestamp(valid, 'Pacific/Auckland') as ts")
    rows = rows.where(f"station = '{STATIONS[0]}' or l_suppkey % 5 <> 0").selectExpr("*", "datediff(ts, date'1970-01-01') as n")
    rows = rows.selectExpr("*", "(n * 7 + n div 5) % 10 as told", f"case when station = '{STATIONS[0]}' then (n * 7 + n div 5) % 10 else (n * 3 + n div 7) % 10 end as warm")
    rows = rows.selectExpr("*", "cast(10 + cast(l_quantity as int) % 5 + case when hour(ts) >= 13 then 2 * warm else 0 end as int) as t")
    return rows.selectExpr("*", "t - 2 - cast(told as int) as d").selectExpr("station", *_report("station", ", station"))


def _report(station: str, more: str) -> list[str]:
    """The columns of a report with temperature t and dewpoint d."""
    report = (
        f"{station} || ' ' || date_format(valid, 'ddHHmm') || 'Z AUTO 36005KT 9999 ' || "
        f"{_GROUP.format(x='t')} || '/' || {_GROUP.format(x='d')} || ' Q1020'"
    )
    return [
        # Sixty bits of a digest of what names a line item, so that no key is too large for it.
        f"cast(conv(substring(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, t{more})), 1, 15), 16, 10) as bigint) as obs_id",
        "valid",
        f"case when l_partkey % 50 = 0 then null when l_partkey % 50 = 1 then {station} || ' AUTO NIL' else {report} end as metar",
        "case when l_suppkey % 40 = 0 then null else t * 9D / 5D + 32D + ((l_orderkey % 10) - 5) / 20D end as tmpf",
        "round(l_discount * 100) * 36 as drct",
        "round(l_tax * 100) * 3 as sknt",
        "29.50D + (l_partkey % 100) / 100D as alti",
        "case when l_returnflag = 'R' and l_linenumber = 1 then 0.05D else 0D end as p01i",
        "element_at(array('FEW', 'SCT', 'BKN', 'OVC', 'CLR', 'VV', null), cast(l_linenumber as int)) as skyc1",
        "cast(l_suppkey * 100 as string) as skyl1",
        "case when l_returnflag = 'R' and l_linenumber = 2 then '-RA' end as wxcodes",
    ]


def event_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month of dense readings derived from events."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.selectExpr("event_id as obs_id", "cast(ts as timestamp) as valid", "value", "event_type")
