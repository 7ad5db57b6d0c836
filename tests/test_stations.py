"""Pruned tables, several stations in one table, and plans that hold for any number of them."""

import datetime as dt
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from obscast.config import Config
from obscast.functions.parse import annotate, parse_temperatures
from obscast.operators import asof, baselines, board, challengers, features, inference, labels, splits
from obscast.plans import jobs, queries
from obscast.sources import fixtures, io
from obscast.sources.shared import stored

ONE = Config(min_obs=8, max_gap_minutes=360)
BOTH = Config(min_obs=8, max_gap_minutes=360, station=("station",))
SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shown(df):
    return sorted((tuple(r) for r in queries.shown(df).collect()), key=repr)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rows = [(f"0{s}", dt.datetime(y, m, 1, h), dt.date(y, m, 1), 10 * y + m) for s in (1, 12) for y in (2022, 2023, 2024) for m in (1, 6, 12) for h in (0, 23)]
    rows.append((None, dt.datetime(2023, 6, 2), dt.date(2023, 6, 2), 0))
    path = str(tmp_path_factory.mktemp("table") / "obs")
    frame = spark.createDataFrame(rows, "station string, valid timestamp, date_local date, x int")
    io.write_table(frame, path, station=("station",))
    return path, rows


def test_a_range_of_a_station_reads_its_folders_only(spark, table):
    path, rows = table
    found = io.read_table(spark, path, "2023-01-01", "2023-12-31", station="01")
    plan = plan_of(found)
    filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "year" in filters and "part_station" in filters and "PushedFilters: [" in plan
    assert sorted(r.x for r in found.collect()) == sorted(x for s, _, d, x in rows if s == "01" and d.year == 2023)
    assert found.columns == ["station", "valid", "date_local", "x"]
    assert sorted(tuple(r) for r in io.read_table(spark, path).where("station is not null").collect()) == sorted(r for r in rows if r[0])
    assert io.read_table(spark, path, "2023-06-02", "2023-06-02").count() == 1


def test_files_outside_the_range_are_never_opened(spark, table, tmp_path):
    import shutil

    path = str(tmp_path / "copy")
    shutil.copytree(table[0], path)
    for f in [*Path(path).glob("part_station==12/**/*.parquet"), *Path(path).glob("**/year=2024/*.parquet")]:
        f.write_bytes(b"no parquet file")
        f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    # The schema comes from one readable file, as a catalogue would give it.
    kinds = "station string, valid timestamp, date_local date, x int, part_station string, year int"
    reader = spark.read.schema(kinds).parquet
    with pytest.raises(Exception):  # noqa: B017
        reader(path).collect()
    import unittest.mock as mock

    with mock.patch.object(type(spark.read), "parquet", lambda self, p: reader(p)):
        found = io.read_table(spark, path, "2022-06-01", "2023-05-31", station="01").collect()
        assert sorted({r.date_local for r in found}) == [dt.date(2022, 6, 1), dt.date(2022, 12, 1), dt.date(2023, 1, 1)]


def test_bounds_of_instants_are_whole_days(spark, table):
    rows = io.read_table(spark, table[0], "2023-12-01", "2023-12-01", date="valid")
    assert sorted(r.valid.hour for r in rows.where("station = '01'").collect()) == [0, 23]
    got = io.between_dates(io.read_table(spark, table[0]), "2023-12-01", "2023-12-01", "012")
    assert got.count() == 2
    for column in ("date_local", "valid"):
        plan = plan_of(io.read_table(spark, table[0], "2023-12-01", "2023-12-01", date=column))
        assert f"GreaterThanOrEqual({column}" in plan and f"LessThan({column}" in plan


@pytest.fixture(scope="module")
def stations(spark):
    """Labels, features and targets of two stations together and of each alone, three years of days."""
    rng = random.Random(11)
    rows = []
    for name, shift, first in (("A", 0, 0), ("B", 6, 200)):
        for n in range(first, 3 * 365):
            if rng.random() < 0.05:
                continue
            k = round(15 + shift + 8 * np.sin(n / 58)) + rng.randint(-2, 2)
            rows.append((name, dt.date(2019, 1, 1) + dt.timedelta(days=n), k + rng.randint(-1, 3), True, k, k, k, k, rng.randint(11, 16)))
    kinds = "station string, date_local date, tmax_int long, day_complete boolean, k_cp__cp_2000 long, k_cp__cp_2100 long, k_cp__cp_2200 long, k_cp__cp_2300 long, tmax_hour long"
    days = spark.createDataFrame(rows, kinds).cache()
    made = days.select(
        "station", "date_local", F.explode(F.array(*[F.lit(c) for c in ONE.cps])).alias("cp"),
        F.when(F.pmod(F.xxhash64("date_local", "station"), F.lit(3)) == 0, "calm").otherwise("transition").alias("regime_label"),
        ((F.col("tmax_int") - F.col("k_cp__cp_2000")) * F.when(F.col("station") == "A", 1.0).otherwise(0.0) + F.pmod(F.xxhash64("date_local"), F.lit(100)) / 90.0).alias("slope_3h"),
        F.pmod(F.xxhash64("date_local", "cp"), F.lit(17)).cast("double").alias("foehn_score"),
    ).cache()
    return days, made


def alone(df, name):
    return df.where(F.col("station") == name).drop("station")


def test_each_station_has_the_results_that_it_has_alone(spark, stations):
    days, made = stations
    starts = [dt.date(2020, 6, 1), dt.date(2021, 1, 1)]
    as_of = dt.date(2021, 10, 1)

    def steps(days, made, config):
        plan = splits.split_plan(days, starts, test_days=200, holdout_days=(60,), as_of=as_of, config=config)
        own = stored(challengers.split_values(made, days, plan, config))
        values = challengers.long_features(made, config=config)
        errors = stored(challengers.challenger_errors(values, challengers.targets(days, config), plan, own, config=config))
        results = inference.validate(errors, dict(made.dtypes), config, n_boot=60, n_p=80)
        train, recent = board.recent_window(days, as_of, 60)
        ladder = stored(board.recent_errors(days, as_of, 60, config, with_rps=True))
        wanted = values.select(*config.station, "feature", "cp")
        nulls = board.feature_nulls(values, days, wanted, as_of, 60, config)
        return {
            "plan": plan, "models": challengers.fit_models(values, challengers.targets(days, config), plan, own, config=config), "errors": errors,
            "stats": challengers.train_stats(made, days, plan, config), "results": results, "contract": inference.contract(results, config=config),
            "doy": baselines.fit_climatology(train, config=config)[0], "month": baselines.climatology_month(train, config), "ladder": ladder,
            "summary": baselines.ladder_summary(ladder, config), "missing": baselines.missing_previous_days(days, recent, config), "nulls": nulls,
            "board": board.leaderboard(ladder, made, as_of, 60, nulls, config).select(
                *config.station, "cp", "window_start", F.col("best_null.level").alias("best"), F.size("segments").alias("s"), F.size("feature_nulls").alias("f"), F.inline("entries")
            ).drop("gates"),
        }

    together = steps(days, made, BOTH)
    for name in ("A", "B"):
        single = steps(alone(days, name), alone(made, name), ONE)
        for step, frame in together.items():
            own = shown(alone(frame, name).select(*single[step].columns))
            assert own == shown(single[step]) and own, (name, step)
    status = {(r.station, r.feature, r.status) for r in together["results"].where("regime = 'all'").collect()}
    assert ("A", "slope_3h", "validated") in status and ("B", "slope_3h", "rejected") in status
    assert together["results"].where("regime <> 'all' and station = 'A'").count() > 0
    assert together["summary"].where("level = 'L4' and rps > 0").count() == 8


def test_default_test_years_of_each_station(spark):
    rows = [("old", dt.date(2005, 3, 1), True), ("old", dt.date(2001, 3, 1), False), ("new", dt.date(2018, 7, 1), True), ("late", dt.date(2022, 1, 1), True), ("none", dt.date(2020, 1, 1), False)]
    days = spark.createDataFrame(rows, "station string, date_local date, day_complete boolean")
    got = {}
    for r in splits.split_plan(days, config=BOTH).collect():
        got.setdefault(r.station, []).append(r.test_start)
    first = {"old": dt.date(2005, 3, 1), "new": dt.date(2018, 7, 1)}
    assert {s: sorted(v) for s, v in got.items()} == {s: splits.default_test_starts(d) for s, d in first.items()}


def test_plans_have_no_window_without_a_key_and_no_copied_report(spark, stations):
    days, _ = stations
    plan = plan_of(baselines.climatology_doy(days, config=BOTH))
    assert "Window" not in plan and "SinglePartition" not in plan
    assert "Window" not in plan_of(baselines.climatology_doy(days))
    obs = annotate(parse_temperatures(fixtures.lineitem_observations(spark, SF), ONE), ONE)
    rows = features.slice_aggregates(obs, ONE, features.ANCHORED)
    tree = rows._jdf.queryExecution().optimizedPlan().toString().split("\n")
    # From the top: merger of intervals, intervals by checkpoint, intervals of reports.
    steps = [line for line in tree if "Aggregate" in line or "Generate explode" in line or "Window" in line]
    kinds = ["Generate" if "Generate" in s else "Window" if "Window" in s else "Aggregate" for s in steps]
    assert kinds[:4] == ["Aggregate", "Generate", "Aggregate", "Window"]


def test_slices_are_those_of_the_reports_before_the_checkpoint(spark):
    obs = annotate(parse_temperatures(fixtures.lineitem_observations(spark, SF), ONE), ONE).cache()
    got = {(r.date_local, r.cp): r for r in features.slice_aggregates(obs, ONE).collect()}
    instants = {(r.date_local, r.cp): r.cp_utc for r in obs.select("date_local", F.inline(asof.checkpoint_instants(ONE))).distinct().collect()}
    held = {}
    for r in asof.known(obs, ONE).collect():
        for cp in ONE.cps:
            if r.valid < instants[r.date_local, cp]:
                held.setdefault((r.date_local, cp), []).append(r)
    assert set(got) == set(held) and len(got) > 1000
    for key, rows in held.items():
        r, winds = got[key], [x.drct for x in rows if x.drct is not None]
        assert (r.n_slice, r.tmin_so_far, r.feature_max_ts) == (len(rows), min(x.tmp_c_int for x in rows), max(x.valid for x in rows))
        assert abs(r.p01i_sum - sum(x.p01i for x in rows)) < 1e-9 and abs(r.mean_dir - np.mean(winds)) < 1e-9
        assert r.tmax_hour_so_far == max(rows, key=lambda x: (x.tmp_c_int, -x.valid.timestamp(), -x.obs_id)).hour_local


def test_report_ids_are_unique_at_any_scale(spark, tmp_path):
    rows = spark.range(200).selectExpr(
        "id * 30000000000 as l_orderkey", "cast(id % 7 + 1 as int) as l_linenumber", "id * 200000000 as l_partkey", "id * 10000000 as l_suppkey",
        "cast(id % 50 as double) as l_quantity", "0.05D as l_discount", "0.02D as l_tax", "'R' as l_returnflag", "timestamp_ntz'1995-05-01 00:00:00' as l_shipdate",
    )
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    for made, n in ((fixtures.lineitem_observations, 200), (fixtures.station_observations, 200)):
        ids = [r.obs_id for r in made(spark, str(tmp_path)).select("obs_id").collect()]
        assert len(ids) == len(set(ids)) >= n and all(0 <= i < 1 << 60 for i in ids)


def test_jobs_over_two_stations_end_in_the_planted_contract(spark, tmp_path):
    out = str(tmp_path / "job")
    jobs.ingest(fixtures.station_observations(spark, "/root/testdata/sf0.01"), out, BOTH)
    jobs.build_features(spark, out, BOTH)
    results = jobs.validate(spark, out, queries.TEST_STARTS, BOTH, 100, 200)
    good = {(r.station, r.feature) for r in results.where("status = 'validated' and regime = 'all'").collect()}
    assert ("NZWN", "dewpoint_depression") in good and ("NZCH", "dewpoint_depression") not in good
    assert results.where("regime <> 'all' and station = 'NZWN' and feature = 'dewpoint_depression' and status = 'validated'").count() > 0
    read = io.read_contract(spark, f"{out}/contract/run=latest", BOTH.station)
    assert {(r.station, r.feature_column) for r in read.collect()} == good
    found = jobs.leaderboard(spark, out, queries.AS_OF, 90, BOTH)
    nulls = {r.station for r in found.where("size(feature_nulls) > 0").collect()}
    assert "NZWN" in nulls and found.count() == 8
