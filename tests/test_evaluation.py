"""Baselines, metrics, backtest and inference on small tables."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from obscast.config import CATALOG, Config
from obscast.operators import baselines, challengers, inference, metrics, splits

CONFIG = Config()


def day(n):
    return dt.date(2019, 1, 1) + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def history(spark):
    rng = random.Random(3)
    rows = []
    for n in range(3 * 365):
        base = round(15 + 8 * np.sin(n / 58))
        k = base + rng.randint(-2, 2)
        rows.append((day(n), k + rng.randint(-2, 2), True, k, k, k, k, 14))
    kinds = "date_local date, tmax_int long, day_complete boolean, k_cp__cp_2000 long, k_cp__cp_2100 long, k_cp__cp_2200 long, k_cp__cp_2300 long, tmax_hour long"
    return spark.createDataFrame(rows, kinds).cache()


def test_splits(spark):
    got = splits.walk_forward_splits(spark, day(0), [day(100), day(400)], holdout_days=(30,), as_of=day(900)).collect()
    assert [r.split for r in got] == [f"test_{day(400)}", "holdout_30d"]
    assert (got[0].train_end, got[0].test_end, got[1].test_start, got[1].test_end) == (day(399), day(764), day(870), day(899))
    with pytest.raises(ValueError):
        splits.walk_forward_splits(spark, day(0), [], holdout_days=(30,))
    assert splits.default_test_starts(dt.date(2012, 5, 1))[0] == dt.date(2017, 1, 1)


def test_climatology_is_the_ring_of_367(spark, history):
    got = {r.doy: r.tmax_dec for r in baselines.climatology_doy(history.where("dayofyear(date_local) not between 40 and 60")).collect()}
    raw = np.full(367, np.nan)
    by = {}
    for r in history.collect():
        if not 40 <= r.date_local.timetuple().tm_yday <= 60:
            by.setdefault(r.date_local.timetuple().tm_yday, []).append(r.tmax_int)
    for d, v in by.items():
        raw[d] = np.mean(v)
    x = np.arange(1, 367)
    ok = ~np.isnan(raw[1:])
    raw[1:] = np.interp(x, x[ok], raw[1:][ok])
    raw[0] = raw[366]
    want = [np.mean([raw[(d + o) % 367] for o in range(-15, 16)]) for d in x]
    assert np.allclose([got[d] for d in x], want)
    with pytest.raises(ValueError):
        baselines.fit_climatology(history.limit(100))


def test_empirical_falls_back_in_three_tiers(spark, history):
    counts = baselines.empirical_counts(history, CONFIG)
    keys = spark.createDataFrame([(1, "20:00", 99), (1, "99:00", 5)], "month int, cp string, k_cp long")
    common = counts.where("k_cp is not null").groupBy("month", "cp", "k_cp").agg(F.sum("n").alias("s")).orderBy(F.desc("s")).first()
    keys = keys.union(spark.createDataFrame([(common.month, common.cp, common.k_cp)], keys.schema))
    dist = baselines.empirical_dist(keys, counts, history.select(F.col("tmax_int").alias("k")), min_bucket=common.s)
    total = {(r.cp, r.k_cp, r.source): r.t for r in dist.groupBy("cp", "k_cp", "source").agg(F.sum("prob").alias("t")).collect()}
    assert {k[2] for k in total} == {"conditional", "fallback_marginal", "uniform"} and all(abs(t - 1) < 1e-9 for t in total.values())


def test_ladder_scores(spark, history):
    train, recent = history.where(F.col("date_local") < F.lit(day(1000))), history.where(F.col("date_local") >= F.lit(day(1000)))
    errors = baselines.ladder_errors(history, train, recent).cache()
    summary = {(r.level, r.cp): r for r in baselines.ladder_summary(errors).collect()}
    pairs = [(r.k_cp__cp_2000, r.tmax_int) for r in recent.collect()]
    l0 = summary["L0", "20:00"]
    assert abs(l0.mae - np.mean([abs(a - b) for a, b in pairs])) < 1e-9 and l0.n == len(pairs) and l0.fallback_rate is None
    assert abs(l0.rmse - np.sqrt(np.mean([(a - b) ** 2 for a, b in pairs]))) < 1e-9
    best = {r.cp: r.mae for r in baselines.best_null(baselines.ladder_summary(errors)).collect()}
    assert all(best[cp] == min(r.mae for (_, c), r in summary.items() if c == cp) for cp in best)


def test_metrics(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0, 3.0), ("a", 2.0, 2.0, 1.0), ("a", 4.0, 3.0, 3.0), ("a", None, 1.0, 1.0), ("b", 1.0, 1.0, 1.0)], "g string, p double, t double, b double")
    got = {r.g: r for r in metrics.point_metrics(rows, ["g"], "p", "t", "b").collect()}
    assert (round(got["a"].mae, 6), got["a"].n, got["b"].corr, got["b"].skill) == (round(2 / 3, 6), 3, None, 0.0)
    values = [3.0, 9.0, 4.5, 4.5, 1.0]
    want = np.mean([abs(v - 5) for v in values]) - sum(abs(a - b) for a in values for b in values) / (2 * 25)
    ensemble = spark.createDataFrame([(0, v, 5.0) for v in values], "g int, v double, t double")
    assert abs(metrics.crps(ensemble, ["g"], "v", "t").first().crps - want) < 1e-9
    dist = spark.createDataFrame([(0, 1, 0.5, 2), (0, 2, 0.25, 2), (0, 3, 0.25, 2)], "g int, k int, p double, t int")
    assert abs(metrics.rps(dist, ["g"], "k", "p", "t").first().rps - (0.25 + 0.0625) / 3) < 1e-9


def test_least_squares_of_constants_is_least_norm(spark):
    rows = spark.createDataFrame([(1, 2.0, 3.0), (1, 2.0, 5.0), (2, 1.0, 3.0), (2, 2.0, 5.0)], "g int, x double, y double")
    got = {r.g: r for r in rows.groupBy("g").agg(*[c.alias(k) for k, c in challengers.least_squares("x", "y").items()]).collect()}
    slope, intercept = np.linalg.lstsq(np.array([[2.0, 1.0], [2.0, 1.0]]), np.array([3.0, 5.0]), rcond=None)[0]
    assert np.allclose([got[1].slope, got[1].intercept, got[2].slope, got[2].intercept], [slope, intercept, 2.0, 1.0])


def test_gates(spark):
    kinds = "model_mae double, null_mae double, cp string, fallback_rate double, p50_mode_share double, corr_diff double, skill_ci_lo double"
    rows = [(1.0, 2.0, "20:00", 0.0, 0.2, None, 0.1), (2.0, 2.0, "20:00", 0.6, 0.6, None, None), (1.0, 2.0, "03:00", 0.0, 0.2, 0.05, None)]
    got = inference.gates(spark.createDataFrame(rows, kinds)).collect()
    assert [[g.passed for g in r.gates] for r in got] == [[True] * 5, [False] * 5, [True] * 5]
    assert [g.status for g in got[1].gates] == ["KILL", "NOT_OPERATIONAL", "COLLAPSE_ALERT", "NOWCAST_SUSPECT", "STAY_OUT"]


def test_step_up_control(spark):
    ps = [0.001, 0.012, 0.03, 0.2, 0.039, None]
    rows = spark.createDataFrame([(f"H{k}", "c", "all", p) for k, p in enumerate(ps)], "id string, cp string, regime string, p_value double")
    good = {r.id for r in inference.benjamini_hochberg(rows).where("fdr_adjusted").collect()}
    assert good == {"H0", "H1", "H2", "H4"}
    assert {r.id for r in inference.benjamini_hochberg(rows, compat=True).where("fdr_adjusted").collect()} == {"H0", "H1"}


def brute_replicates(values, n, seed=42):
    """Weighted means of (unit, value) pairs: a unit occurs as often as its sixteen bits reach the bounds."""
    import hashlib
    import math

    bounds = [int(65536 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(8)]
    out = []
    for rep in range(n):
        hexes = [hashlib.sha256(f"{seed}|{u}|{rep // 16}".encode()).hexdigest() for u, _ in values]
        times = [sum(int(h[4 * (rep % 16) : 4 * (rep % 16) + 4], 16) >= b for b in bounds) for h in hexes]
        drawn = [v for (_, v), t in zip(values, times, strict=True) for _ in range(t)]
        out.append((np.mean(drawn) if drawn else None, max(drawn, default=None)))
    return out


def test_bootstrap_draws_follow_the_rule(spark, monkeypatch):
    from obscast.operators import bootstrap

    monkeypatch.setattr(bootstrap, "PART", 3)  # several parts of a group, in two levels
    monkeypatch.setattr(bootstrap, "TOGETHER", 2)
    values = {"a": [(str(k), v) for k, v in enumerate([1.0, 4.0, 2.5, 9.0, -3.0, 0.5, 7.0, 1.5])], "b": [("0", 2.0), ("0", 4.0), ("3", -1.0)], None: [("9", 1.0)]}
    rows = [(g, u, v) for g, own in values.items() for u, v in own] + [("a", "77", None)]
    frame = spark.createDataFrame(rows, "g string, d string, v double")
    want = {g: brute_replicates(own, 40) for g, own in values.items()}
    got = {(r.g, r.rep): r.stat for r in inference.replicates(frame, ["g"], "v", ["d"], 40).collect()}
    assert len(got) == 120
    for (g, rep), stat in got.items():
        assert stat is None and want[g][rep][0] is None or abs(stat - want[g][rep][0]) < 1e-12
    tops = {(r.g, r.rep): r.stat for r in inference.replicates(frame, ["g"], "v", ["d"], 40, statistic=F.max).collect()}
    assert tops == {(g, rep): top for g, own in want.items() for rep, (_, top) in enumerate(own) if top is not None}
    r = {x.g: x for x in bootstrap.intervals(frame, ["g"], "v", ["d"], 30, 40).collect()}
    for g, own in want.items():
        means = [m for m, _ in own[:30] if m is not None]
        assert np.allclose([r[g].lo, r[g].hi], np.quantile(means, [0.025, 0.975]))
        assert abs(r[g].p_value - (sum(m is not None and m <= 0 for m, _ in own) + 1) / 41) < 1e-12
    ci = inference.bootstrap_ci(frame.where("g = 'a'"), [], "v", ["d"], 50, statistic=F.max).first()
    assert ci.point == 9.0 and ci.lo <= ci.hi <= 9.0
    plan = bootstrap.intervals(frame, ["g"], "v", ["d"], 30, 40)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Window" not in plan


def test_poisson_counts_have_mean_and_variance_one():
    from obscast.operators import bootstrap

    times = np.concatenate([bootstrap.occurrences(f"u{k}", 9999, 42) for k in range(20)])
    assert abs(times.mean() - 1) < 0.01 and abs(times.var() - 1) < 0.02


def test_value_ranks_and_crps_of_a_group_over_many_ranges(spark):
    from obscast.operators.ranks import value_ranks

    rng = np.random.default_rng(4)
    values = np.round(rng.normal(size=4000) ** 3, 2)
    rows = [("big", float(v), 0.5) for v in values] + [("one", 2.0, 5.0), (None, 1.0, 0.0), (None, 1.0, 0.0), (None, 3.0, 0.0), ("big", None, 0.5)]
    frame = spark.createDataFrame(rows, "g string, v double, t double").repartition(6)
    got = {(r.g, r.v): (r.n, r.before, r.total) for r in value_ranks(frame, ["g"], "v").collect()}
    for v in set(values.tolist()):
        assert got["big", v] == ((values == v).sum(), (values < v).sum(), 4000)
    assert got[None, 1.0] == (2, 0, 3) and got[None, 3.0] == (1, 2, 3) and got["one", 2.0] == (1, 0, 1)
    want = np.abs(values - 0.5).mean() - np.abs(values[:, None] - values[None, :]).sum() / (2 * 4000**2)
    found = {r.g: r.crps for r in metrics.crps(frame, ["g"], "v", "t").collect()}
    assert abs(found["big"] - want) < 1e-9 and abs(found["one"] - 3.0) < 1e-12
    # No task sorts the large group: its different values lie in several ranges.
    made = spark.range(200_000).selectExpr("'k' as g", "cast(id as double) as v")
    laid = value_ranks(made, ["g"], "v").select("v", "before").where("v <> before")
    assert laid.isEmpty()


def test_step_up_control_of_random_values_is_that_of_the_sorted_ones(spark):
    rng = random.Random(6)
    families = {f: [rng.choice([rng.random(), rng.random() ** 4, 0.01, 0.05, None]) for _ in range(n)] for f, n in (("x", 400), ("y", 30), ("z", 1), (None, 50))}
    rows = [(f, f"H{k}", "c", "all", p) for f, ps in families.items() for k, p in enumerate(ps)]
    frame = spark.createDataFrame(rows, "station string, id string, cp string, regime string, p_value double").where("station is not null")
    for compat in (False, True):
        got = {(r.station, r.id): r.fdr_adjusted for r in inference.benjamini_hochberg(frame, 0.1, compat, ("station",)).collect()}
        for f in ("x", "y", "z"):
            ps, m = families[f], 0
            order = sorted(k for k, p in enumerate(ps) if p is not None)
            order.sort(key=lambda k: (ps[k], f"H{k}"))
            m = len(ps) if compat else len(order)
            passed = [ps[k] <= (i + 1) / m * 0.1 for i, k in enumerate(order)]
            last = passed.index(False) if compat and False in passed else len(passed) if compat else max((i + 1 for i, ok in enumerate(passed) if ok), default=0)
            # Equal p-values have equal decisions, so ranks inside a tie do not matter.
            assert {k for k in range(len(ps)) if got[f, f"H{k}"]} == set(order[:last]), (f, compat)


def test_signal_validates_and_noise_does_not(spark, history):
    rng = random.Random(1)
    rows = []
    for r in history.collect():
        for cp in CONFIG.cps:
            gap = r.tmax_int - r.k_cp__cp_2000
            rows.append((r.date_local, cp, "calm", gap + rng.gauss(0, 0.3), rng.gauss(0, 1), None, None))
    made = spark.createDataFrame(rows, "date_local date, cp string, regime_label string, signal double, noise double, empty double, sst_maritime_cap double")
    catalog = (("S", "signal"), ("N", "noise"), ("E", "empty"), ("B", "sst_maritime_cap"), ("X", "absent"), ("R", "regime_label"))
    values = challengers.long_features(made, [c for _, c in catalog])
    spans = splits.walk_forward_splits(spark, day(0), [day(500)])
    errors = challengers.challenger_errors(values, challengers.targets(history, CONFIG), spans)
    got = inference.validate(errors, dict(made.dtypes), CONFIG, n_boot=100, n_p=200, catalog=catalog).cache()
    status = {}
    for r in got.where("regime = 'all'").collect():
        status.setdefault(r.feature, set()).add(r.status)
    assert status == {"signal": {"validated"}, "noise": {"rejected"}, "empty": {"rejected"}, "sst_maritime_cap": {"BLOCKED"}, "absent": {"rejected"}, "regime_label": {"rejected"}}
    assert got.where("regime = 'calm' and feature = 'signal'").count() == 4
    found = inference.contract(got).first()
    assert found.n_validated == 8 and len(found.blocked) == 4 and len(CATALOG) == 23


def test_registered_results_accept_a_single_real_effect(spark, monkeypatch):
    from obscast.plans import queries

    rng = random.Random(5)
    names = [c for _, c in CATALOG]
    real, rows = next(c for c in names if c not in dict(CONFIG.blocked)), []
    for c in names:
        for cp in CONFIG.cps:
            for n in range(40):
                tmax, good = 10 + n % 9, c == real and cp == "20:00"
                base, error = rng.uniform(2, 3), rng.uniform(0, 1) if good else rng.uniform(3, 4)
                rows.append(("s", day(n), c, cp, "all", tmax, tmax + base, tmax + error, base, error))
    kinds = "split string, date_local date, feature string, cp string, regime string, tmax long, base_pred double, pred double, base_error double, error double"
    gains = spark.createDataFrame(rows, kinds)
    made = spark.createDataFrame([], ", ".join(f"{c} double" for c in names))
    monkeypatch.setattr(queries, "_gains", lambda spark, sf_dir: (gains, dict(made.dtypes)))
    got = queries.hypothesis_results(spark, "").collect()
    assert [(r.feature, r.cp, r.p_value) for r in got if r.status == "validated"] == [(real, "20:00", 0.0001)]
    found = queries.feature_contract(spark, "").where("kind = 'validated'").collect()
    assert [(r.n_validated, r.feature_column, r.cp) for r in found] == [(1, real, "20:00")]


def test_fits_from_sums_are_those_of_numpy_for_each_split(spark, history):
    rng = random.Random(9)
    days = history.collect()
    rows = [(r.date_local, "20:00", "calm", "f", rng.gauss(3, 2) if k % 7 else None) for k, r in enumerate(days)] + [(r.date_local, "20:00", "calm", "g", 4.0) for r in days]
    values = spark.createDataFrame(rows, "date_local date, cp string, regime_label string, feature string, value double").where("value is not null")
    plan = splits.walk_forward_splits(spark, day(0), [day(400), day(530), day(800)], test_days=120)
    own = values.where("feature = 'f'").withColumns({"split": F.lit(f"test_{day(530)}"), "part": F.lit("train"), "feature": F.lit("own")}).where(F.col("date_local") < F.lit(day(500)))
    own = own.select("split", "part", "date_local", "cp", "regime_label", "feature", "value")
    got = {(r.split, r.feature): r for r in challengers.fit_models(values, challengers.targets(history), plan, own).collect()}
    aim = {r.date_local: r.tmax_int - r.k_cp__cp_2000 for r in days}
    for name, feature, end in [(f"test_{day(n)}", f, n) for n in (400, 530, 800) for f in "fg"] + [(f"test_{day(530)}", "own", 500)]:
        pairs = [(v, aim[d]) for d, _, _, f, v in rows if f == ("f" if feature == "own" else feature) and v is not None and d < day(end)]
        x, y = (np.array(c, float) for c in zip(*pairs, strict=True))
        want = np.linalg.lstsq(np.c_[x, np.ones(len(x))], y, rcond=None)[0]
        r = got[name, feature]
        assert r.n_train == len(x) and np.allclose([r.slope, r.intercept], want)
    assert len(got) == 7


def test_paired_interval_and_its_length_error(spark):
    rows = [(k, "c", float(k % 5), float(k % 5) - 1.0) for k in range(50)]
    pairs = spark.createDataFrame(rows, "date_local int, cp string, a double, b double")
    r = inference.bootstrap_ci_diff(pairs, ["cp"], "a", "b", ["date_local"], 50).first()
    assert (r.point, r.lo, r.hi) == (1.0, 1.0, 1.0)
    short = pairs.withColumn("b", F.when(F.col("date_local") > 3, F.col("b")))
    with pytest.raises(Exception, match="have not as many values"):
        inference.bootstrap_ci_diff(short, ["cp"], "a", "b", ["date_local"], 50).collect()


def test_roll_up_of_optional_scores_and_missing_previous_days(spark, history):
    errors = [("L0", "x", day(k), "20:00", 5.0, 1.0, 1.0, 1.0, 1.0, None, r, c) for k, (r, c) in enumerate([(0.0, None), (0.2, 0.5), (0.4, 0.7)])]
    kinds = "level string, name string, date_local date, cp string, pred double, error double, abs_error double, sq_error double, bracket_match double, fallback double, rps double, corr_diff double"
    r = baselines.ladder_summary(spark.createDataFrame(errors, kinds)).first()
    assert abs(r.rps - 0.3) < 1e-12 and r.corr_diff == 0.5
    recent = history.where(F.col("date_local").between(F.lit(day(10)), F.lit(day(19))))
    before = history.where(F.col("date_local") != F.lit(day(14)))
    assert {(r.cp, r.n, r.n_missing) for r in baselines.missing_previous_days(before, recent).collect()} == {(c, 10, 1) for c in CONFIG.cps}
