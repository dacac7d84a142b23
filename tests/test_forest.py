import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsewarden.functions import trees
from pulsewarden.operators import forest

KIND = "signal int, config int, sim string, t int, features array<double>"


def plain(plan, tree, values, node=1):
    """A tree by recursion: {node: (feature, cut, n)}."""
    low, high = values.min(axis=0), values.max(axis=0)
    feature, cut = (x[0] for x in trees.choose(plan, tree, np.array([node]), low[None], high[None], np.array([len(values)])))
    out = {node: (int(feature), float(cut), len(values))}
    if feature >= 0:
        right = values[:, feature] >= cut
        assert 0 < right.sum() < len(values)
        out |= plain(plan, tree, values[~right], 2 * node) | plain(plan, tree, values[right], 2 * node + 1)
    return out


def test_levels_grow_the_trees_of_recursion():
    values = np.round(np.random.default_rng(1).normal(size=(200, 5)), 1)
    values[:, 3] = 7.0
    plan = trees.Plan(9, 8, 0.7, 5, 0.8, 200)
    for tree in range(8):
        mine = values[plan.member(np.arange(200), tree)]
        assert 100 < len(mine) < 180 and len(plan.allowed(tree)) == 4
        node, feature, cut, n = trees.grow(plan, tree, mine)
        assert dict(zip(node.tolist(), zip(feature.tolist(), cut.tolist(), n.tolist()))) == plain(plan, tree, mine)
        assert 3 not in feature and set(feature) - {-1} <= set(plan.allowed(tree).tolist())
        packed = trees.packed(node, feature, cut, n)
        for row, path in zip(mine, packed.paths(mine)):
            at = 1
            while (f := plain(plan, tree, mine)[at][0]) >= 0:
                at = 2 * at + int(row[f] >= plain(plan, tree, mine)[at][1])
            assert np.isclose(path, at.bit_length() - 1 + trees.expected(plain(plan, tree, mine)[at][2]))
            break


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    made = [(signal, config, "s", t, (rng.normal(size=4) * signal).tolist()) for signal, config, n in ((1, 0, 400), (1, 1, 150), (2, 0, 90)) for t in range(n)]
    return spark.createDataFrame(made, KIND).repartition(5)


CONFIGS = [forest.Config(6, 0.9, 0.8), forest.Config(5, 0.7, 1.0)]


def test_sums_over_partitions_grow_the_same_trees(rows):
    whole = forest.IsolationForest(CONFIGS, block=4).fit(rows)
    apart = forest.IsolationForest(CONFIGS, bound=20).fit(rows)
    both = [sorted(tuple(r) for r in f.model.collect()) for f in (whole, apart)]
    assert len(both[0]) == 6 + 5 + 6 and both[0] == both[1]
    scored = [sorted(tuple(r) for r in f.score(rows).collect()) for f in (whole, apart)]
    assert len(scored[0]) == 640 and scored[0] == scored[1]


def test_chunks_do_not_change_scores(rows):
    model = forest.IsolationForest(CONFIGS, chunk=37).fit(rows)
    parts = sorted(tuple(r) for r in model.score(rows).collect())
    model.chunk = 10_000
    assert parts == sorted(tuple(r) for r in model.score(rows).collect())


def test_planted_rows_and_keys_without_model(spark):
    rng = np.random.default_rng(7)
    train = [(1, "s", t, rng.normal(size=4).tolist()) for t in range(500)]
    odd = [(1, "s", 1000 + t, (8 + rng.normal(size=4)).tolist()) for t in range(10)] + [(5, "s", 0, [0.0] * 4)]
    schema = "signal int, sim string, t int, features array<double>"
    model = forest.IsolationForest([forest.Config(100)]).fit(spark.createDataFrame(train, schema))
    scored = model.score(spark.createDataFrame(train[:200] + odd, schema))
    assert all(r.t >= 1000 for r in scored.orderBy(F.desc("score")).limit(10).collect()) and scored.where("signal = 5").count() == 0
    none = spark.createDataFrame([], schema)
    assert forest.IsolationForest().fit(none).score(none).count() == 0


def test_constant_rows(spark):
    same = spark.createDataFrame([(1, "s", t, [1.0, 2.0]) for t in range(30)], "signal int, sim string, t int, features array<double>")
    for bound in (5, 1000):
        scores = {r.score for r in forest.IsolationForest([forest.Config(4)], bound=bound).fit(same).score(same).collect()}
        assert len(scores) == 1 and np.isfinite(scores.pop())
