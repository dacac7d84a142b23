import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsewarden.operators import calibrate
from pulsewarden.operators.order import Ordered


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(2)
    rows = [(s, float(v), int(y)) for s, n in ((1, 900), (2, 7), (3, 1)) for v, y in zip(np.round(rng.normal(size=n), 1), rng.random(n) < 0.2)]
    rows += [(4, 2.5, 1), (4, 2.5, 1), (4, 3.5, 1), (5, None, 0), (1, None, 1)]
    return spark.createDataFrame(rows, "signal int, score double, y int")


SHARES = [0.0, 0.005, 0.31, 0.5, 0.985, 1.0]


@pytest.mark.parametrize("partitions", [1, 7, 40])
@pytest.mark.parametrize("over", ["all", "negatives"])
def test_percentiles_and_counts(scores, partitions, over):
    """One signal lies over many partitions; values are those of NumPy, counts those of plain loops."""
    ordered = Ordered(scores, partitions)
    got = ordered.reached(ordered.percentiles(SHARES, over)).collect()
    pandas = scores.dropna().toPandas()
    assert sorted((r.signal, r.pos) for r in got) == [(s, k) for s in (1, 2, 3, 4) for k in range(len(SHARES))]
    for r in got:
        own = pandas[pandas.signal == r.signal]
        base = own[own.y == 0] if over == "negatives" and (own.y == 0).any() else own
        assert np.isclose(r.thr, np.percentile(base.score, 100 * SHARES[r.pos]))
        reach = own.score >= r.thr
        assert (r.tp, r.fp, r.positives, r.negatives) == ((reach & (own.y == 1)).sum(), (reach & (own.y == 0)).sum(), (own.y == 1).sum(), (own.y == 0).sum())


def test_several_partitions_hold_a_signal_and_no_buffer_does(scores):
    ordered = Ordered(scores, 40)
    assert ordered.rows.where("signal = 1").select("part").distinct().count() > 5
    plan = calibrate.two_stage(scores.withColumn("sim", F.lit("s")).withColumn("t", F.lit(0)))._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan.lower()


def test_thresholds_beyond_all_scores(spark, scores):
    ordered = Ordered(scores, 3)
    asked = spark.createDataFrame([(1, 0, 99.0, 5, 5), (4, 0, -99.0, 3, 0)], "signal int, pos int, thr double, positives long, negatives long")
    assert {(r.signal, r.tp, r.fp) for r in ordered.reached(asked).collect()} == {(1, 0, 0), (4, 3, 0)}
    assert Ordered(scores.limit(0)).percentiles([0.5]).count() == 0
