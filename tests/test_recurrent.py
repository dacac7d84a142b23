import numpy as np
from pyspark.sql import functions as F

from pulsewarden.functions import bilstm
from pulsewarden.operators import keyed_sums as sums
from pulsewarden.operators import recurrent

SMALL = bilstm.Shape(5, (4, 3), 2, (0.2, 0.3))


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(3)
    flat = SMALL.start([1], 0.5) + 0.05 * rng.normal(size=SMALL.size)
    x = rng.normal(size=(6, 5)) * 2
    moments = SMALL.first_moments()
    loss = lambda f: bilstm.run(SMALL, f, x, moments, np.random.default_rng(9)).loss
    got = bilstm.run(SMALL, flat, x, moments, np.random.default_rng(9)).gradient
    for k in rng.permutation(SMALL.size)[:120]:
        step = np.zeros(SMALL.size)
        step[k] = 1e-5
        assert np.isclose((loss(flat + step) - loss(flat - step)) / 2e-5, got[k], rtol=2e-4, atol=1e-6), k


def test_default_shape_is_the_one_of_three_widths():
    shape = bilstm.Shape()
    assert [w for _, w, _ in shape.layers] == [128, 64, 32, 32, 64, 128] and [d for *_, d in shape.layers] == [0.2, 0.2, 0.3, 0.2, 0.2, 0.2]
    assert bilstm.run(shape, shape.start([1]), np.ones((3, 14)), shape.first_moments()).rebuilt.shape == (3, 14)


def test_course_of_training():
    model = lambda k: recurrent.Model(np.array([k]), np.array([k]))
    course = recurrent.Course(1.0, floor=4, patience=2, plateau=3)
    for k, loss in enumerate([5.0, 1.0, 2.0, 3.0, 4.0, 2.5]):
        course.judge(loss, model(k))
        if course.done:
            break
    # epochs before the fourth are not looked at for the best weights, but count for the rate
    assert not course.done and course.model.flat[0] == 5 and course.rate == 0.5
    course.judge(2.6, model(6))
    course.judge(2.7, model(7))
    assert course.done and course.model.flat[0] == 5
    course = recurrent.Course(1.0, floor=1, patience=2)
    course.judge(1.0, model(0))
    course.judge(float("nan"), model(1))
    assert course.done and course.model.flat[0] == 0


def waves(rng, signal, n, odd=()):
    level = 4 * signal
    return [(signal, "s", t, (level + 2 * np.sin(np.arange(5) + rng.random() * 6) + (rng.normal(0, 4, 5) if t in odd else 0)).tolist(), t % 5 == 0) for t in range(n)]


KIND = "signal int, sim string, t int, seq array<double>, held boolean"


def test_partitions_do_not_change_the_sums(spark, monkeypatch):
    rows = spark.createDataFrame(waves(np.random.default_rng(1), 1, 60) + waves(np.random.default_rng(2), 2, 30), KIND)
    whole = {s: np.array([x for r in rows.where(f"signal = {s}").collect() for x in r.seq]).sum() for s in (1, 2)}

    def partial(frames):
        out = {}
        for frame in frames:
            for s, part in frame.groupby("signal"):
                out[int(s),] = out.get((int(s),), 0) + np.array([np.concatenate(part["seq"].to_list()).sum()])
        return out

    for wide in (64, 2):
        monkeypatch.setattr(sums, "WIDE", wide)
        got = sums.keyed_sums(rows.repartition(5), partial, {"signal": "int"})
        assert {k[0]: round(float(v[0]), 6) for k, v in got.items()} == {s: round(float(v), 6) for s, v in whole.items()}


def test_planted_sequences_have_the_largest_errors(spark):
    rng = np.random.default_rng(5)
    shape = bilstm.Shape(5, (6, 4), 2, (0.0, 0.0))
    rows = spark.createDataFrame(waves(rng, 1, 300) + waves(rng, 3, 300) + [(3, "s", 900, [1.0, None, 2.0, 3.0, 4.0], False), (7, "s", 1, [1.0] * 5, True)], KIND).repartition(3)
    model = recurrent.SequenceAutoencoder(shape, epochs=60, rate=0.03, floor=5).fit(rows)
    assert set(model.models) == {1, 3} and all(min(v) < 0.7 * v[0] for v in model.losses.values())
    odd = spark.createDataFrame(waves(rng, 1, 100, range(8)) + waves(rng, 3, 100, range(8)) + [(9, "s", 0, [0.0] * 5, False), (3, "x", 0, [None] * 5, False)], KIND)
    scored = model.score(odd)
    for signal in (1, 3):
        top = scored.where(F.col("signal") == signal).orderBy(F.desc_nulls_last("score")).limit(8).collect()
        assert sum(r.t < 8 for r in top) >= 6
    assert scored.where("signal = 9").count() == 0 and scored.where("sim = 'x'").head().score is None


def test_blocks_of_signals_and_empty_tables(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([r for s in (1, 2, 3) for r in waves(rng, s, 20)], KIND)
    apart = recurrent.SequenceAutoencoder(SMALL, epochs=2, at_once=1).fit(rows)
    together = recurrent.SequenceAutoencoder(SMALL, epochs=2).fit(rows)
    assert set(apart.models) == set(together.models) == {1, 2, 3}
    assert all(np.allclose(apart.models[s].flat, together.models[s].flat, atol=1e-2) for s in (1, 2, 3))
    none = recurrent.SequenceAutoencoder(SMALL, epochs=2).fit(rows.limit(0))
    assert none.models == {} and none.score(rows).count() == 0
