"""Reports that share instants, and scores of days that are all alike."""

import datetime as dt
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obscast.config import Config
from obscast.functions.parse import annotate, parse_temperatures
from obscast.operators import asof, features, labels, metrics
from obscast.sources import fixtures, io

RAW = (
    "obs_id long, valid timestamp, metar string, tmpf double, drct double, sknt double, alti double, p01i double,"
    " skyc1 string, skyl1 string, wxcodes string"
)
CONFIG = Config(min_obs=3, max_gap_minutes=1440)


def test_scores_without_variance_are_those_of_sql(spark):
    rows = [("same", 40.0, 40.0, 40.0), ("same", 40.0, 40.0, 40.0), ("off", 39.0, 40.0, 40.0), ("off", 40.0, 40.0, 40.0), ("two", 1.0, 2.0, 3.0), ("two", 2.0, 4.0, 3.0)]
    table = spark.createDataFrame([*rows, ("none", None, 1.0, 1.0)], "g string, p double, t double, b double")
    got = {r.g: r for r in metrics.point_metrics(table, ["g"], "p", "t", "b", ieee=True).collect()}
    assert math.isnan(got["same"]["corr"]) and math.isnan(got["same"].skill)
    assert math.isnan(got["off"]["corr"]) and got["off"].skill == -math.inf
    assert (round(got["two"]["corr"], 9), got["two"].skill) == (1.0, 1 - 2.5 / 1.0)
    assert (got["none"]["corr"], got["none"].skill) == (None, None)


def test_reports_of_an_instant_are_one_row_before_any_window(spark):
    at = dt.datetime(2025, 6, 14, 18, 5)
    rows = []
    for k in range(400):
        text = None if k % 7 == 0 else f"X {k % 23:02d}/{k % 9:02d} Q"
        valid = at + dt.timedelta(minutes=30 * (k % 10))
        rows.append((k * 7919 % 401 - 200, valid, text, 32.0 + k % 60, 36.0 * (k % 11), float(k % 30), 29.5 + k / 1000, 0.05 * (k % 2), ["OVC", "FEW", None][k % 3], "900", None))
    obs = annotate(parse_temperatures(spark.createDataFrame(rows, RAW), CONFIG), CONFIG).repartition(5)
    made = features.instants(obs, CONFIG)
    assert made.count() == 10
    days = labels.daily_labels(obs, CONFIG)
    assert labels.labels_of(made, CONFIG).collect() == days.collect()
    table = features.build_features(obs, days, CONFIG).orderBy("cp").collect()
    assert features.features_of(made, days, CONFIG).orderBy("cp").collect() == table
    # By hand: the order is instant, then obs_id.
    seen = sorted((r.asDict() for r in asof.known(obs, CONFIG).collect()), key=lambda r: (r["valid"], r["obs_id"]))
    own = [r for r in seen if r["dq_tmp_c_int"] == "ok"]
    top = min(own, key=lambda r: (-r["tmp_c_int"], r["valid"], r["obs_id"]))
    day = days.first()
    assert (day.n_obs, day.n_imputed, day.tmax_int, day.tmax_ts) == (len(own), len(seen) - len(own), top["tmp_c_int"], top["ts_local"])
    assert abs(day.tmax_dec - (top["tmpf"] - 32) * 5 / 9) < 1e-9
    got = {r.cp: r for r in features.slice_aggregates(obs, CONFIG, ("tmp_c_int",)).collect()}
    for cp, hour in (("20:00", 20), ("22:00", 22)):
        before = [r for r in seen if r["valid"] < dt.datetime(2025, 6, 14, hour)]
        changes = [(b["tmp_c_int"] - a["tmp_c_int"]) / ((b["valid"] - a["valid"]).seconds / 3600) for a, b in zip(before, before[1:]) if a["valid"] < b["valid"]]
        assert (got[cp].n_slice, got[cp].max_delta) == (len(before), max(changes))
        assert got[cp].a6.tmp_c_int == before[0]["tmp_c_int"]


def test_one_instant_with_two_reports_has_no_gap(spark):
    rows = [(k, dt.datetime(2025, 6, 14, 18, 5), "X 10/08 Q", 50.0, None, None, None, None, None, None, None) for k in (1, 2)]
    obs = annotate(parse_temperatures(spark.createDataFrame(rows, RAW), CONFIG), CONFIG)
    assert labels.daily_labels(obs, CONFIG).first().max_gap_min == 0


def test_rows_dealt_by_time_are_written_without_another_shuffle(spark, tmp_path, monkeypatch):
    asked = []
    monkeypatch.setattr(DataFrame, "hint", lambda df, *a: asked.append(a) or df)
    obs = annotate(parse_temperatures(fixtures.station_observations(spark, "/root/testdata/sf0.001", by_time=True), CONFIG), CONFIG)
    io.write_table(obs, str(tmp_path / "obs"), station=("station",), dealt=True)
    assert asked == [] and io.read_table(spark, str(tmp_path / "obs")).count() == obs.count()
    plan = obs._jdf.queryExecution().optimizedPlan().toString()
    # Numbers are shuffled: the report's text is made above the exchange.
    assert "metar" in plan.split("RepartitionByExpression")[0] and "metar" not in plan.split("RepartitionByExpression")[1]
