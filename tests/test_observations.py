"""Parsing, calendars, settlement and labels on hand values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from obscast.config import Config
from obscast.functions import calendar, settle
from obscast.functions.parse import annotate, parse_stats, parse_temperatures
from obscast.operators import asof, features, labels
from obscast.sources import io

RAW = (
    "obs_id long, valid timestamp, metar string, tmpf double, drct double, sknt double, alti double, p01i double,"
    " skyc1 string, skyl1 string, wxcodes string"
)
CONFIG = Config(min_obs=3, max_gap_minutes=1440)


def row(spark, k, valid, metar="NZWN 18/12 Q", tmpf=None, drct=None, sknt=None, alti=None, p01i=0.0, skyc1=None, skyl1=None, wx=None):
    return (k, dt.datetime.fromisoformat(valid), metar, tmpf, drct, sknt, alti, p01i, skyc1, skyl1, wx)


def table(spark, rows):
    return annotate(parse_temperatures(spark.createDataFrame(rows, RAW), CONFIG), CONFIG)


def test_temperature_groups(spark):
    cases = [
        ("X 18/12 Q", None, 18, 12, "ok", False), ("X M02/M05", None, -2, -5, "ok", False), ("X NIL", 68.0, 20, None, "imputed", False),
        (None, None, None, None, "missing", False), ("X 55/12 Q", 60.0, None, None, "missing", True), ("M", 32.9, 0, None, "imputed", False),
        ("X 18/M55 Q", None, 18, None, "ok", True), ("X 7/3 20/10", None, 7, 3, "ok", False), ("X118/12 Q", 41.0, 5, None, "imputed", False),
        (None, 32.9, 0, None, "imputed", False), (None, 36.5, 2, None, "imputed", False),
    ]
    rows = [(k, c[0], c[1]) for k, c in enumerate(cases)]
    got = parse_temperatures(spark.createDataFrame(rows, "k int, metar string, tmpf double")).orderBy("k").collect()
    assert [(r.tmp_c_int, r.dwp_c_int, r.dq_tmp_c_int, r.implausible) for r in got] == [c[2:] for c in cases]
    found = parse_stats(spark.createDataFrame([], "metar string, tmpf double").transform(parse_temperatures)).first()
    assert (found.n_ok, found.fallback_rate, found.missing_rate) == (0, 0.0, 0.0)


def test_settlement_is_half_up(spark):
    xs = [14.5, -2.5, 14.2, 14.0, 13.8]
    r = spark.createDataFrame([(x,) for x in xs], "x double").select("x", settle.settle(F.col("x")).alias("s"), settle.flip_risk(F.col("x")).alias("r")).collect()
    assert [x.s for x in r] == [15, -2, 14, 14, 14]
    assert [x.r.direction for x in r] == ["stable", "stable", "up", "either", "down"]
    assert [round(x.r.boundary_distance, 6) for x in r] == [0.0, 0.0, 0.3, 0.5, 0.3]


def test_checkpoints_fall_on_the_local_day(spark):
    days = spark.createDataFrame([(dt.date(2025, 6, 15),), (dt.date(2025, 1, 15),), (dt.date(2025, 4, 6),), (dt.date(2025, 9, 28),)], "d date")
    start, end = calendar.day_window(F.col("d"), CONFIG.tz)
    got = days.select(calendar.cp_to_utc(F.col("d"), F.lit("23:00"), CONFIG.tz).alias("at"), ((F.unix_seconds(end) - F.unix_seconds(start)) / 3600).alias("h")).collect()
    assert [r.at.isoformat()[:13] for r in got][:2] == ["2025-06-14T23", "2025-01-14T23"]
    assert [r.h for r in got] == [24, 24, 25, 23]
    morning = spark.range(1).select(*[calendar.is_morning(F.lit(c), CONFIG.tz, CONFIG.ref_date) for c in CONFIG.cps]).first()
    assert list(morning) == [True, True, True, True]


def test_labels_are_per_date_and_from_one_report(spark):
    obs = table(spark, [
        row(spark, 1, "2025-06-14 20:00:00", "X 10/5", 50.1), row(spark, 2, "2025-06-14 23:30:00", "X 16/5", 61.0),
        row(spark, 3, "2025-06-15 01:00:00", "X 16/9", 60.4), row(spark, 4, "2025-06-15 02:00:00", "X NIL", 90.0),
        row(spark, 5, "2025-06-15 20:00:00", "X 08/5", 46.0), row(spark, 6, "2025-06-16 05:00:00", "X 09/5", 48.0),
    ])
    got = {str(r.date_local): r for r in labels.daily_labels(obs, CONFIG).collect()}
    first, second = got["2025-06-15"], got["2025-06-16"]
    assert (first.tmax_int, first.tmin_int, first.tmax_hour, first.n_obs, first.n_imputed) == (16, 10, 11, 3, 1)
    assert round(first.tmax_dec, 4) == round((61.0 - 32) * 5 / 9, 4) and first.max_gap_min == 210
    assert (first.k_cp__cp_2000, first.k_cp__cp_2100, first.k_cp__cp_2300) == (None, 10, 10)
    assert (second.tmax_int, second.day_complete, first.day_complete) == (9, False, True)
    long = {(str(r.date_local), r.cp): r.k_cp for r in labels.k_cp_long(labels.daily_labels(obs, CONFIG), CONFIG).collect()}
    assert long["2025-06-15", "22:00"] == 10 and len(long) == 8


@pytest.fixture(scope="module")
def morning(spark):
    rows = [
        row(spark, 1, "2025-06-14 18:05:00", "X 10/08", 50.0, 360.0, 20.0, 30.00, skyc1="OVC", skyl1="2500"),
        row(spark, 2, "2025-06-14 20:50:00", "X 16/08", 60.8, 350.0, 20.0, 29.94, skyc1="VV", skyl1="x"),
        row(spark, 3, "2025-06-14 22:00:00", "X 17/09", 62.6, 10.0, 20.0, 29.90, wx="-RA"),
        row(spark, 4, "2025-06-15 03:00:00", "X 19/09", 66.2, 180.0, 5.0, 29.80),
    ]
    return rows


def test_features_by_hand_and_no_leak(spark, morning):
    def build(rows):
        obs = table(spark, rows)
        days = labels.daily_labels(table(spark, morning), CONFIG)
        return {r.cp: r for r in features.build_features(obs, days, CONFIG).collect()}

    got = build(morning)
    assert got["20:00"].slope_3h is None and got["22:00"].slope_3h == 2.0 and got["23:00"].slope_3h == 2.0
    assert got["22:00"].warming_rate_06_09 == 2.0 and got["22:00"].precip_disruption == 0 and got["23:00"].precip_disruption == 1
    assert got["23:00"].cloud_cover_suppression == 1.0 and got["23:00"].cloud_base_transparency == 0.3125
    assert abs(got["22:00"].pressure_trend_3h + 0.06 * 33.8639 / 3) < 1e-9
    assert got["22:00"].tmax_dminus1 is None and got["22:00"].regime_label == "insufficient"
    leaked = [*morning, row(spark, 9, "2025-06-14 23:00:00", "X 39/09", 99.0, 90.0, 99.0, 20.0)]
    assert build(leaked) == got


def test_firewall_and_windows_fail_the_job(spark):
    bad = spark.sql("select timestamp'2025-01-01 10:00:00' as feature_max_ts, timestamp'2025-01-01 10:00:00' as cp_utc")
    with pytest.raises(Exception, match="not before the checkpoint"):
        asof.require_causal(bad).count()
    with pytest.raises(Exception, match="does not begin before"):
        asof.require_closed_left(spark.sql("select 2 as start, 2 as end")).count()


def test_csv_tokens_and_parquet_round_trip(spark, tmp_path):
    path = tmp_path / "o.csv"
    path.write_text("# a comment\nvalid,metar,tmpf,skyl1\n2025-06-14 20:00,X 10/5,50.5,0500\nbad,M,MM,\n")
    got = io.read_observations_csv(spark, str(path), {"valid": "timestamp", "metar": "string", "tmpf": "double", "skyl1": "string"}).collect()
    assert (got[0].valid, got[0].tmpf, got[0].skyl1) == (dt.datetime(2025, 6, 14, 20), 50.5, "0500")
    assert list(got[1]) == [None] * 4
    days = spark.createDataFrame([(dt.date(2024, 1, 1), 1), (dt.date(2025, 1, 1), 2)], "date_local date, x int")
    io.write_table(days, str(tmp_path / "t"))
    assert sorted(r.x for r in io.read_table(spark, str(tmp_path / "t")).collect()) == [1, 2]


def test_partitioning_does_not_change_results(spark, morning):
    obs = table(spark, morning)
    days = labels.daily_labels(obs, CONFIG)
    a = features.build_features(obs, days, CONFIG).collect()
    b = features.build_features(obs.repartition(7), days.repartition(3), CONFIG).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_two_stations_in_one_table_are_those_of_each_alone(spark, morning):
    both = Config(min_obs=3, max_gap_minutes=1440, station=("station",))
    warm = [(*r[:2], "X 25/11", *r[3:]) for r in morning[1:]]
    a, b = (table(spark, rows).withColumn("station", F.lit(s)) for s, rows in (("A", morning), ("B", warm)))
    obs = a.unionByName(b)
    days = labels.daily_labels(obs, both)
    for name, own in (("A", a), ("B", b)):
        alone = labels.daily_labels(own, CONFIG)
        assert days.where(F.col("station") == name).drop("station").collect() == alone.collect()
        made = features.build_features(own, alone, CONFIG).orderBy("cp").collect()
        found = features.build_features(obs, days, both).where(F.col("station") == name).drop("station").orderBy("cp")
        assert found.collect() == made
        gaps = labels.observation_gaps(obs, both).where(F.col("station") == name).select("obs_id", "gap_min")
        assert sorted(gaps.collect()) == sorted(labels.observation_gaps(own).select("obs_id", "gap_min").collect())
    assert labels.k_cp_long(days, both).columns == ["station", "date_local", "cp", "k_cp"]


def test_a_report_is_parsed_once_in_the_plan(spark, morning):
    rows = table(spark, morning).where("dq_tmp_c_int <> 'missing' and tmp_c_int > 3")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 1
