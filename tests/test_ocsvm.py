import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsewarden.operators import ocsvm

KIND = "signal int, config int, sim string, t int, features array<double>"


def dense(x, nu, rounds=60_000):
    """Optimum of the dual on all rows by steps on the worst pair: -a.K.a / 2, which is that of the problem itself."""
    gamma = 1.0 / (x.shape[1] * x.var())
    k = ocsvm.kernel(x, x, gamma)
    n = len(x)
    top = 1.0 / (nu * n)
    a = np.zeros(n)
    a[: int(nu * n)] = top
    a[int(nu * n)] += 1.0 - a.sum()
    g = k @ a
    for _ in range(rounds):
        i = int(np.where(a < top - 1e-15, g, np.inf).argmin())
        j = int(np.where(a > 1e-15, g, -np.inf).argmax())
        if g[j] - g[i] < 1e-7:
            break
        step = min((g[j] - g[i]) / max(2 - 2 * k[i, j], 1e-12), top - a[i], a[j])
        a[i] += step
        a[j] -= step
        g += step * (k[:, i] - k[:, j])
    return -0.5 * a @ k @ a


def test_objective_is_that_of_a_dense_solver(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(1500, 4)), rng.normal(3, 0.5, size=(500, 4))])
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    rows = spark.createDataFrame([(1, c, "s", t, v.tolist()) for c in range(2) for t, v in enumerate(x)], KIND).repartition(4)
    model = ocsvm.OneClassSVM([0.05, 0.2]).fit(rows)
    for config, nu in enumerate(model.nus):
        best = dense(x, nu)
        assert abs(model.objective[1, config] - best) <= 0.01 * abs(best)
        outside = model.score(rows).where((F.col("config") == config) & (F.col("score") > 0)).count()
        assert abs(outside / 2000 - nu) < 0.02


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    f, state = rng.normal(size=(50, 3)), ocsvm.State(np.array([0.3, -0.2, 0.5, 0.4]), 0.7, 1.0)
    got = ocsvm._slopes(f, state)
    for k in range(4):
        step = np.eye(4)[k] * 1e-6
        up, down = (ocsvm._slopes(f, state._replace(v=state.v + s * step)) for s in (1, -1))
        assert np.isclose((up[0] - down[0]) / 2e-6, got[1 + k], atol=1e-4)


def test_planted_rows_and_odd_tables(spark):
    rng = np.random.default_rng(7)
    schema = "signal int, sim string, t int, features array<double>"
    train = [(1, "s", t, rng.normal(size=4).tolist()) for t in range(500)] + [(2, "s", t, [1.0, 1.0]) for t in range(20)] + [(3, "s", 0, [5.0])]
    odd = [(1, "s", 1000 + t, (8 + rng.normal(size=4)).tolist()) for t in range(10)] + [(5, "s", 0, [0.0] * 4)]
    model = ocsvm.OneClassSVM(landmarks=60).fit(spark.createDataFrame(train, schema))
    scored = model.score(spark.createDataFrame(train[:200] + odd, schema))
    assert all(r.t >= 1000 for r in scored.orderBy(F.desc("score")).limit(10).collect()) and scored.where("signal = 5").count() == 0
    constant = model.score(spark.createDataFrame(train[500:], schema)).collect()
    assert len(constant) == 21 and all(np.isfinite(r.score) for r in constant)
    none = spark.createDataFrame([], schema)
    assert ocsvm.OneClassSVM().fit(none).score(none).count() == 0


def test_rows_are_bounded(spark):
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(1, 0, "s", t, rng.normal(size=2).tolist()) for t in range(2000)], KIND)
    model = ocsvm.OneClassSVM(most=300, landmarks=40).fit(rows)
    assert 220 < 1 / (model.states[1, 0].weight * 0.05) < 380 and model.score(rows).count() == 2000


def test_all_rows_are_fitted(spark):
    """Also those of a key with more rows than 50,000."""
    rows = spark.range(60_000).select(F.lit(1).alias("signal"), F.lit(0).alias("config"), F.lit("s").alias("sim"), F.col("id").cast("int").alias("t"), F.array(F.sin("id"), F.cos(F.col("id") * 7)).alias("features"))
    model = ocsvm.OneClassSVM(rounds=1).fit(rows)
    assert round(1 / (model.states[1, 0].weight * 0.05)) == 60_000


def test_kernel_features_hold_for_all_rows(spark):
    """Few rows far from all others count too; landmarks do not depend on how rows are dealt out."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(5000, 2)), 9 + rng.normal(size=(3, 2)), [[-12.0, 14.0]]])
    rows = spark.createDataFrame([(1, 0, "s", t, v.tolist()) for t, v in enumerate(x)], KIND)
    maps = [ocsvm.OneClassSVM(rounds=1).fit(rows.repartition(n)).maps[1, 0] for n in (1, 7)]
    assert np.array_equal(maps[0].landmarks, maps[1].landmarks) and len(maps[0].landmarks) < 500
    f = maps[0](x)
    assert (1 - (f**2).sum(axis=1)).max() < 0.0101
    some = np.r_[:100, 4990:5004]
    assert np.abs(f @ f[some].T - ocsvm.kernel(x, x[some], maps[0].gamma)).max() < 0.0101


@pytest.mark.parametrize("width", [0.0, 0.3])
def test_rounded_hinge(width):
    u = np.array([-1.0, 0.0, 0.1, 0.3, 2.0])
    assert np.allclose(ocsvm.hinge(u, width), np.maximum(u, 0) if not width else [0, 0, 0.01 / 0.6, 0.15, 1.85])
