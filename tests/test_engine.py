import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsewarden.functions import farrington, features
from pulsewarden.operators import calibrate, detectors, ensemble, forest, metrics, ocsvm, search, slices
from pulsewarden.sources import panels

ALARMS = "signal int, sim string, t int, a double, y int"


def alarms(spark, o, a, sim="sig1_sim0"):
    return spark.createDataFrame([(1, sim, t, float(x), y) for t, (y, x) in enumerate(zip(o, a))], ALARMS)


def test_metric_fixtures(spark):
    o = [0, 0, 1, 1, 1, 1, 0]
    row = metrics.per_sim(alarms(spark, o, [0, 1, 0, 1, 0, 0, 0])).head()
    assert (row.tp, row.fn, row.fp, row.tn, row.first, row.last, row.hit) == (1, 3, 1, 2, 2, 5, 3)
    each = metrics.each_sim(alarms(spark, o, [0, 1, 0, 1, 0, 0, 0])).head()
    assert (each.sens, round(each.spec, 6), each.pod, each.timeliness) == (0.25, 0.666667, 1.0, 0.25)
    each = metrics.each_sim(alarms(spark, o, [0] * 7)).head()
    assert (each.sens, each.spec, each.pod, each.timeliness) == (0.0, 1.0, 0.0, 1.0)
    quiet = alarms(spark, [0] * 7, [0] * 7)
    assert metrics.each_sim(quiet).head().timeliness is None and metrics.each_sim(quiet, no_outbreak=1.0).head().timeliness == 1.0
    assert metrics.original(quiet).head().sensitivity is None and metrics.original(quiet, undefined=0.0).head().sensitivity == 0.0
    odd = metrics.tail_only(alarms(spark, [0, 0], [1e-300, 0])).head()
    assert odd.specificity == 0.5 and odd.fpr == 0.0


def series(spark, values, y=None):
    return spark.createDataFrame([(1, "sig1_sim0", t, float(x), int(y[t]) if y else 0) for t, x in enumerate(values)], "signal int, sim string, t int, x double, y int")


def test_features_of_a_constant_and_warm_up(spark):
    rows = features.features20(series(spark, [3] * 20), 7).orderBy("t").collect()
    assert rows[0].t == 6 and len(rows) == 14
    r = rows[0]
    assert (r.robust_z, r.z, r.minmax, r.rankw, r.diff7, r.diff14) == (0, 0, 0, 1, 0, 0)


def test_features_against_numpy(spark):
    x = np.random.default_rng(1).poisson(4, 60).astype(float)
    for r in features.features20(series(spark, x), 14).collect():
        w = x[r.t - 13 : r.t + 1]
        mad = np.median(np.abs(w - np.median(w))) or 1e-6
        assert np.isclose(r.meanw, w.mean()) and np.isclose(r.stdw, w.std()) and np.isclose(r.rankw, (w <= x[r.t]).mean())
        assert np.isclose(r.rank7, (w[-7:] <= x[r.t]).mean()) and np.isclose(r.robust_z, 0.6745 * (x[r.t] - np.median(w)) / mad)


def test_sequences_and_weeks(spark):
    s = series(spark, range(20))
    got = features.sequences(s, 14, 3).orderBy("t").collect()
    assert [r.t for r in got] == [13, 16, 19] and list(got[0].seq) == list(range(14))
    weeks = features.weekly(series(spark, [1] * 14), 14).orderBy("week").collect()
    assert [(r.week, r.cases) for r in weeks] == [(1, 7.0), (2, 7.0)]
    weeks = features.trim_leading_zeros(features.weekly(series(spark, [1] * 2209), 2209)).orderBy("week").collect()
    assert len(weeks) == 316 and weeks[0].cases is None and weeks[0].first_week == 2


@pytest.mark.parametrize("n,sizes", [(10, (6, 2, 2)), (2, (1, 1, 0)), (1, (0, 1, 0))])
def test_split_sizes(spark, n, sizes):
    sims = spark.createDataFrame([(1, f"sig1_sim{k}") for k in range(n)], "signal int, sim string")
    got = {r.split: r["count"] for r in slices.split_sims(sims).groupBy("split").count().collect()}
    assert tuple(got.get(k, 0) for k in ("train", "val", "test")) == sizes
    if n == 1:
        assert {r.split for r in slices.split_sims(sims, reuse_single=True).collect()} == {"val", "test"}


def test_split_tables(spark):
    val = spark.createDataFrame([(1, "a")], "signal int, sim string")
    test = spark.createDataFrame([(1, "b", "TEST"), (1, "c", "Train")], "signal int, sim string, split string")
    got = {(r.sim, r.split) for r in slices.read_splits(val, test).collect()}
    assert got == {("a", "val"), ("b", "test"), ("c", "train")}
    with pytest.raises(ValueError):
        slices.read_splits(val.drop("sim"), test)


def test_percentile_and_ties(spark):
    scores = spark.createDataFrame([(1, "s", t, float(t + 1), int(t == 4)) for t in range(5)], "signal int, sim string, t int, score double, y int")
    cells = {r.percent: r for r in calibrate.grid(scores, [50.0, 90.0]).collect()}
    assert cells[50.0].thr == 3 and np.isclose(cells[90.0].thr, 4.6) and cells[90.0].spec == 1.0
    tied = spark.createDataFrame([(1, 0, 0.5, 0.9), (1, 1, 0.5, 0.9)], "signal int, config int, sens double, spec double")
    assert calibrate.choose_config(tied, 0.97).head().config == 0


def test_tuners_against_loops(spark):
    rng = np.random.default_rng(3)
    y = (rng.random(400) < 0.2).astype(int)
    score = np.round(rng.normal(size=400) + 1.2 * y, 2)
    frame = spark.createDataFrame([(1, "s", t, float(v), int(l)) for t, (v, l) in enumerate(zip(score, y))], "signal int, sim string, t int, score double, y int")

    def at(thr):
        a = score >= thr
        return a[y == 1].mean(), (~a)[y == 0].mean()

    best = None
    for p in calibrate.STAGE_1:
        thr = np.percentile(score, p)
        s, sp = at(thr)
        if sp >= 0.9 and (best is None or 2 * s + 3 * sp > best[0] + 1e-12):
            best = (2 * s + 3 * sp, thr)
    assert np.isclose(calibrate.two_stage(frame, 0.9).head().thr, best[1])
    none = calibrate.two_stage(frame.withColumn("y", F.lit(0)), 0.9).head()
    assert none.stage == "last"
    assert calibrate.negative_tail(frame, 2.0).head().meets is False


def test_vote_and_choice(spark):
    rows = []
    for d, flags in enumerate(zip((1, 1, 0), (1, 0, 0), (0, 0, 0), (1, 1, 1))):
        rows += [(1, "s", k, d, a, 0) for k, a in enumerate(flags)]
    got = ensemble.vote(spark.createDataFrame(rows, "signal int, sim string, t int, detector int, a int, y int")).orderBy("t").collect()
    assert [r.a for r in got] == [1, 0, 0, 1]
    c = spark.createDataFrame([(1, 0, False, 0.9, 0.5, 0.1), (1, 1, True, 0.2, 0.98, 0.1), (2, 0, False, 0.9, 0.5, 0.1), (2, 1, False, 0.2, 0.96, 0.1)], "signal int, candidate int, meets boolean, sens double, spec double, f_beta double")
    assert {r.signal: r.candidate for r in ensemble.choose(c).collect()} == {1: 1, 2: 0}
    assert {r.signal: r.candidate for r in ensemble.choose(c, "closest_spec").collect()} == {1: 1, 2: 1}


def test_wide_files(spark, tmp_path):
    path = str(tmp_path / "totals.csv")
    pd.DataFrame({"Date": ["d0", "d1"], "a": [1, 2], "b": ["x", 4]}).to_csv(path, index=False)
    wide = panels.read_wide(spark, path).withColumn("t", F.monotonically_increasing_id().cast("int"))
    got = {(r.t, r.sim_col, r.sim_idx, r.x) for r in panels.to_long(wide, "t").collect()}
    assert got == {(0, "a", 0, 1.0), (1, "a", 0, 2.0), (0, "b", 1, None), (1, "b", 1, 4.0)}
    assert panels.read_wide(spark, path + "x", "skip") is None
    with pytest.raises(FileNotFoundError):
        panels.read_wide(spark, path + "x")
    with pytest.raises(ValueError):
        panels.check_shapes({"a": wide, "b": wide.drop("b")})
    out = str(tmp_path / "out")
    long = spark.createDataFrame([(t, s, t) for t in range(3) for s in ("s1", "s2")], "t int, sim string, a int")
    panels.write_wide(long, out, ["s2", "s1"])
    assert spark.read.option("header", True).csv(out).columns == ["s2", "s1"]


def test_farrington_groups_weights_and_quantiles():
    groups = [g for _, g in farrington.group_table()]
    assert len(groups) == 238 and [groups.count(g) for g in range(1, 11)] == [36, 21, 20, 20, 20, 21, 25, 25, 25, 25]
    assert farrington.quantile(3.0, 1.0, 0.99) == 8 and farrington.quantile(3.0, 2.0, 0.99) >= 9
    rng = np.random.default_rng(0)
    y = rng.poisson(20, (2, 266)).astype(float)
    used = np.zeros((2, 266), bool)
    used[:, 28:] = True
    mu, phi, leverage, b, _ = farrington.fit(y, farrington.lag_groups(265), -np.arange(266.0), used, np.ones_like(y))
    assert np.isclose(mu[:, 28:].sum(axis=1), y[:, 28:].sum(axis=1)).all() and np.isclose(leverage.sum(axis=1), 11, atol=1e-6).all()
    assert np.isclose(farrington.down_weights(y, mu, phi, leverage, used).sum(axis=1), 238).all()


def _dense_fit(y, groups, x, w, sloped):
    """Iteratively reweighted least squares on the whole design matrix: coefficients, dispersion, leverage."""
    design = (groups[:, None] == np.unique(groups)[None, :]).astype(float)
    design = np.column_stack([design, x]) if sloped else design
    mu = y + 0.1
    for _ in range(60):
        z = np.log(mu) + (y - mu) / mu
        root = np.sqrt(w * mu)
        beta = np.linalg.lstsq(design * root[:, None], z * root, rcond=None)[0]
        mu = np.exp(design @ beta)
    q = np.linalg.qr(design * np.sqrt(w * mu)[:, None])[0]
    return beta, mu, max((w * (y - mu) ** 2 / mu).sum() / (len(y) - design.shape[1]), 1.0), (q**2).sum(axis=1)


@pytest.mark.parametrize("sloped", [True, False])
def test_farrington_fit_against_dense_regression(sloped):
    rng = np.random.default_rng(3)
    lags = np.arange(28, 266)
    groups = farrington.lag_groups(265)
    y = np.zeros((1, 266))
    y[0, 28:] = rng.negative_binomial(4, 0.2, len(lags))
    w = np.ones_like(y)
    w[0, 28:] = rng.uniform(0.1, 1.5, len(lags))
    used = np.zeros(y.shape, bool)
    used[:, 28:] = True
    mu, phi, leverage, b, base = farrington.fit(y, groups, -np.arange(266.0), used, w, np.array([sloped]))
    beta, dense, dispersion, hat = _dense_fit(y[0, 28:], groups[28:], -lags.astype(float), w[0, 28:], sloped)
    assert np.allclose(mu[0, 28:], dense) and np.isclose(phi[0], dispersion) and np.allclose(leverage[0, 28:], hat)
    assert np.isclose(base[0], beta[0]) and (np.isclose(b[0], beta[-1]) if sloped else np.isnan(b[0]))


def _plainly_settles(y, design, w):
    """The same rule by one least squares problem a step."""
    loss = lambda mu: 2 * (w * (np.where(y > 0, y * np.log(np.maximum(y, 1) / mu), 0) - y + mu)).sum()
    mu = y + 0.1
    eta, old = np.log(mu), loss(mu)
    for _ in range(25):
        root = np.sqrt(w * mu)
        eta = design @ np.linalg.lstsq(design * root[:, None], root * (eta + (y - mu) / mu), rcond=1e-13)[0]
        mu = np.maximum(np.exp(eta), np.finfo(float).eps)
        new = loss(mu)
        if abs(new - old) / (abs(new) + 0.1) < 1e-8:
            return True
        old = new
    return False


def test_farrington_settling_against_least_squares(monkeypatch):
    rng = np.random.default_rng(8)
    groups, lags = farrington.lag_groups(265), np.arange(266)
    y = rng.poisson(rng.choice([0.01, 0.05, 3.0], 12)[:, None], (12, 266)).astype(float)
    y[:2] = 0
    y[0, [40, 250]] = 5
    y[[1, 2, 4], 28:] = 0
    y[1, [118, 217, 260, 262]] = y[2, [118, 217, 260, 262]] = [16, 3164, 3114548, 1570437]
    y[4, [100, 115, 127, 142, 149, 198, 239]] = [102912746, 3346, 223203, 1099, 406147, 110, 788]
    used = np.tile(lags >= 28, (12, 1))
    w = rng.uniform(0.2, 1.4, y.shape)
    sloped = np.arange(12) % 2 == 0
    want = []
    for k in range(12):
        design = np.column_stack([(groups[28:, None] == np.arange(1, 11)).astype(float), *([-lags[28:] / 100.0] if sloped[k] else [])])
        want.append(_plainly_settles(y[k, 28:], design, w[k, 28:]))
    assert want[1] and not want[2] and not want[4]
    assert farrington.settles(y, groups, -lags.astype(float), used, w, sloped).tolist() == want
    x = rng.poisson(3, 2500).astype(float)
    monkeypatch.setattr(farrington, "settles", lambda y, g, x, used, w, sloped: ~sloped)
    flat = farrington.one_series(x, 50)
    assert (flat["trend"] == 0).all() and np.isnan(flat["slope"]).all() and not np.isnan(flat["mu"]).any()
    monkeypatch.setattr(farrington, "settles", lambda y, *rest: np.zeros(len(y), bool))
    none = farrington.one_series(x, 50)
    assert set(none["status"]) == {"unfit"} and all(np.isnan(none[c]).all() for c in ("mu", "upper", "alarm", "alarmall", "trend", "slope"))


def test_farrington_variants():
    zero = np.zeros(1200)
    a, b = (farrington.one_series(zero, 1200, variant=v) for v in "ab")
    assert set(a["status"]) == {"short"}
    for t, status in zip(b["t"].tolist(), b["status"].tolist()):
        assert (status == "short") == (round((t + 1) / 7) - 1 < 108) and status in ("short", "few"), t
    assert np.isinf(b["alarm"][-1]) and b["alarm"][0] == 1e300
    x = np.random.default_rng(1).poisson(np.linspace(2, 6, 2500)).astype(float)
    fits = {(v, trend): farrington.one_series(x, 60, trend=trend, variant=v) for v in "ab" for trend in (True, False)}
    assert (fits["a", True]["mu"] == fits["b", True]["mu"]).all() and (fits["b", False]["mu"] == fits["b", True]["mu"]).all()
    assert (fits["a", False]["mu"] < fits["a", True]["mu"]).all() and np.isnan(fits["a", False]["slope"]).all()
    assert (fits["b", False]["trend"] == 0).all() and (fits["b", True]["trend"] == 1).all()
    with pytest.raises(ValueError):
        farrington.one_series(x, variant="c")


def test_farrington_quantiles_by_summing():
    def slow(mu, phi, p):
        k, total, term = 0, 0.0, np.exp(-mu) if phi == 1 else phi ** (-mu / (phi - 1))
        while True:
            total += term
            if total >= p - 1e-12:
                return k
            k += 1
            term *= mu / k if phi == 1 else (mu / (phi - 1) + k - 1) / k * (1 - 1 / phi)

    cells = [(m, f) for m in (1e-6, 0.3, 3.0, 40.0, 300.0) for f in (1.0, 1.5, 4.0, 60.0)]
    got = farrington.quantile(np.array([m for m, _ in cells]), np.array([f for _, f in cells]), 0.99)
    assert got.tolist() == [slow(m, f, 0.99) for m, f in cells]


def test_farrington_trend_flag():
    rng = np.random.default_rng(5)
    x = rng.poisson(2, 2500).astype(float)
    got = farrington.one_series(x)
    assert (got["trend"] == 1).all() and not np.isnan(got["slope"]).any()
    burst = np.zeros(2500)
    burst[1000] = 3
    burst[1200:1300] = rng.poisson(3, 100)
    got = farrington.one_series(burst, 100)
    assert set(got["status"]) == {"low"} and (got["trend"] == 0).all() and np.isnan(got["slope"]).all()
    assert (farrington.one_series(np.zeros(2500))["trend"] == 1e300).all()


def test_farrington_alarms_and_sentinels(spark):
    rng = np.random.default_rng(4)
    x = rng.poisson(6, 2500).astype(float)
    x[2450:2464] += 25
    got = farrington.one_series(x)
    day = {int(t): k for k, t in enumerate(got["t"])}
    assert got["alarmall"][day[2460]] == 1 and got["alarmall"][: day[2440]].mean() < 0.05
    zero = farrington.one_series(np.zeros(2500))
    assert (zero["status"] == "short").all() and (zero["alarm"] == 1e300).all()
    late = np.zeros(2500)
    late[[10, 2499]] = 1
    assert np.isinf(farrington.one_series(late)["alarm"]).all()
    rows = farrington.detect(series(spark, x)).collect()
    assert len(rows) == 343 and {r.status for r in rows} <= {"ok", "low"}


@pytest.mark.parametrize("name", ["iforest", "ocsvm"])
def test_detectors_find_planted_days(spark, name):
    rng = np.random.default_rng(7)
    rows = [(1, "s", t, rng.normal(size=4).tolist()) for t in range(500)]
    odd = [(1, "s", 1000 + t, (8 + rng.normal(size=4)).tolist()) for t in range(10)]
    schema = "signal int, sim string, t int, features array<double>"
    train, test = spark.createDataFrame(rows, schema), spark.createDataFrame(rows[:200] + odd, schema)
    model = detectors.REGISTRY[name]().fit(train)
    top = model.score(test).orderBy(F.desc("score")).limit(10).collect()
    assert sum(r.t >= 1000 for r in top) >= 9


def test_search_tunes_on_validation_series_only(spark):
    rng = np.random.default_rng(9)
    rows = []
    for sim in ("train", "val", "test"):
        odd = range(20) if sim != "train" else ()
        rows += [(1, sim, t, (rng.normal(size=3) + (9 if t in odd else 0)).tolist(), int(t in odd)) for t in range(200)]
    table = spark.createDataFrame(rows, "signal int, sim string, t int, features array<double>, y int")
    blind = table.withColumn("features", F.array(F.lit(0.5), F.rand(1), F.lit(0.5)))
    splits = spark.createDataFrame([(1, s, s) for s in ("train", "val", "test")], "signal int, sim string, split string")
    both = blind.withColumn("config", F.lit(0)).unionByName(table.withColumn("config", F.lit(1))).drop("y")
    for detector in (ocsvm.OneClassSVM([0.05, 0.05]), forest.IsolationForest([forest.Config(60)] * 2)):
        found = search.search(detector, slices.restrict(both, splits, "train"), both, table, splits, calibrate.two_stage, 0.97, [("blind",), ("plain",)])
        got = found.alarms.collect()
        assert len(got) == 200 and {r.sim for r in got} == {"test"} and {r.config for r in got} == {1}
        assert sum(r.a for r in got if r.y) >= 18 and sum(r.a for r in got if not r.y) <= 20
        manifest = found.manifest.collect()
        assert [r.settings for r in manifest] == ['["blind"]', '["plain"]'] and spark.read.parquet(manifest[0].scores).count() == 1200


def test_features_of_several_windows_are_those_of_each(spark):
    x = np.random.default_rng(4).poisson(5, 60).astype(float)
    s = series(spark, x)
    for names, build in ((features.NAMES20, features.features20), (features.NAMES4, features.features4)):
        got = {(r.window, r.t): r.features for r in features.by_windows(s, (7, 14, 21), names).collect()}
        want = {(w, r.t): [r[c] for c in names] for w in (7, 14, 21) for r in build(s, w).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    rows = features.by_windows(s, (7, 14), features.NAMES4)
    scaled = np.array([r.features for r in features.standardise_arrays(rows, rows, ["signal", "window"]).where("window = 7").collect()])
    assert np.allclose(scaled.mean(axis=0), 0, atol=1e-9) and np.allclose(scaled.std(axis=0), 1)


def test_subsample_default_mix_and_common_span(spark):
    rows = spark.createDataFrame([(1, t) for t in range(50)], "signal int, t int")
    taken = {r.t for r in slices.subsample(rows, ["signal", "t"], 10).collect()}
    assert len(taken) == 10 and taken == {r.t for r in slices.subsample(rows.repartition(7), ["signal", "t"], 10).collect()}
    assert slices.subsample(rows, ["signal", "t"], 99).count() == 50
    tuned = spark.createDataFrame([(1, 0, "first", 90.0, 2.0, 0.5, 0.99)], "signal int, mix int, stage string, percent double, thr double, sens double, spec double")
    errors = spark.createDataFrame([(s, float(v)) for s in (1, 2) for v in range(101)], "signal int, mse double")
    got = {r.signal: r for r in calibrate.with_default(tuned, errors, 3).collect()}
    assert got[1].stage == "first" and (got[2].stage, got[2].mix, got[2].thr, got[2].sens) == ("default", 3, 95.0, None)
    span = ensemble.common_span(spark.createDataFrame([(1, "a")] * 5 + [(1, "b")] * 3, "signal int, detector string"), {"a": 7, "b": 14}).head()
    assert (span.length, span.window) == (3, 14)
    report = metrics.positives(alarms(spark, [0, 1, 0, 0], [0] * 4)).head()
    assert (report.n, report.positives, report.rate) == (4, 1, 25.0)


def test_sequence_reconstruction(spark):
    rng = np.random.default_rng(8)
    wave = lambda: (10 + 3 * np.sin(np.arange(14) / 2 + rng.random() * 6)).tolist()
    rows = [(1, "s", t, wave()) for t in range(200)]
    odd = [(1, "s", 999, rng.normal(10, 5, 14).tolist())]
    schema = "signal int, sim string, t int, seq array<double>"
    model = detectors.SequenceReconstructor().fit(spark.createDataFrame(rows, schema))
    assert model.score(spark.createDataFrame(rows[:50] + odd, schema)).orderBy(F.desc("score")).head().t == 999


def test_history_counts_whole_weeks_from_the_first_cases():
    """Held against plain loops over weeks counted back from each day; days are 1-based there."""
    def weeks_with_history(x, k):
        count = int(np.round(k / 7))
        sums = [sum(x[k - 7 * w - 7 : k - 7 * w]) if k - 7 * w - 6 > 0 else 0 for w in range(count)]
        with_cases = [w for w, s in enumerate(sums) if s]
        return max(with_cases, default=0)

    sparse = np.zeros(2000)
    sparse[[2, 9, 700, 701, 1500, 1990]] = 5
    for x in (np.full(2000, 5.0), sparse):
        got = farrington.one_series(x, 2000)
        for t, status in zip(got["t"].tolist(), got["status"].tolist()):
            assert (status == "short") == (weeks_with_history(x, t + 1) < 108), t
    fives = farrington.one_series(np.full(2000, 5.0), 2000)
    assert set(fives["status"][756:762]) == {"short"} and fives["status"][762] == "ok"


def test_rows_to_score_reach_back_and_outbreaks_are_no_train_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(1, f"sig1_sim{k}", t, float(v), int(t % 50 < 5)) for k in range(3) for t, v in enumerate(rng.poisson(4, 300))]
    p = spark.createDataFrame(rows, "signal int, sim string, t int, x double, y int")
    splits = spark.createDataFrame([(1, "sig1_sim0", "train"), (1, "sig1_sim1", "val"), (1, "sig1_sim2", "test"), (1, "sig1_sim2", "val")], "signal int, sim string, split string")
    days = lambda df: {(r.sim, r.config): (r.n, r.first) for r in df.groupBy("sim", "config").agg(F.count("*").alias("n"), F.min("t").alias("first")).collect()}
    train, last = search.inputs(p, splits, [7, 14, 7], features.NAMES4, 200, 60)
    assert days(train) == {("sig1_sim0", 0): (194, 6), ("sig1_sim0", 1): (187, 13), ("sig1_sim0", 2): (194, 6)}
    assert days(last) == {(f"sig1_sim{k}", c): (60 - w + 1, 240 + w - 1) for k in (1, 2) for c, w in enumerate((7, 14, 7))}
    train, last = search.inputs(p, splits, [7, 14, 7], features.NAMES4, 200, 60, tail_context=True, train_exclude_outbreaks=True)
    assert days(train) == {("sig1_sim0", 0): (194 - 15, 6), ("sig1_sim0", 1): (187 - 15, 13), ("sig1_sim0", 2): (194 - 15, 6)}
    assert days(last) == {(f"sig1_sim{k}", c): (60, 240) for k in (1, 2) for c in range(3)}


def test_weeks_of_all_anchors_are_those_of_each(spark):
    x = np.random.default_rng(3).poisson(2, 80).astype(float)
    got = {r.t: r.weeks for r in features.anchored_weeks(series(spark, x), 6).collect()}
    assert got == {t: [x[e - 6 : e + 1].sum() for e in range(t, 5, -7)][:6] for t in range(6, 80)}


def test_table_function_gives_the_rows_of_detect(spark):
    rng = np.random.default_rng(2)
    rows = [(s, f"sig{s}_sim{k}", t, float(v)) for s, k in ((1, 0), (1, 1), (2, 0)) for t, v in enumerate(rng.poisson(3, 2400 if k == 0 else 300))]
    table = spark.createDataFrame(rows, "signal int, sim string, t int, x double").orderBy(F.rand(1))
    farrington.register(spark)
    table.createOrReplaceTempView("rows_to_trace")
    got = spark.sql("SELECT * FROM farrington_trace(TABLE(rows_to_trace) PARTITION BY (signal, sim) ORDER BY t)")
    want = farrington.detect(table)
    assert got.schema == want.schema and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 986
