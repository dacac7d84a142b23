import random

import numpy as np

from pyspark.sql import functions as F

from pulsewarden.llm import mixing as m


def corpus(spark):
    rng = random.Random(2)
    words = {"a": ["red", "blue", "green", "x"], "b": ["one", "two", "three", "x"], "c": ["sun", "moon", "x"]}
    rows = []
    for k in range(300):
        name = "aaaaabbbc"[k % 9]
        rows.append((k, " ".join(rng.choice(words[name]) for _ in range(rng.randint(3, 40))), name))
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows] + [(900, None, 1.0), (901, "", 1.0), (None, "x", 1.0), (902, "red sun " * 20000, 1.0)], "doc_id long, text string, rate double")
    labels = spark.createDataFrame([(i, n) for i, _, n in rows[:150]] + [(3, None), (None, "a"), (5000, "ghost")], "doc_id long, domain string")
    return docs, labels


def test_totals_meet_targets(spark):
    docs, labels = corpus(spark)
    mixed = m.mix(docs.where("doc_id < 300"), labels, {"a": 0.2, "b": 0.5, "c": 0.3})
    total = mixed.agg(F.sum("n_tokens")).head()[0]
    got = mixed.agg(*[F.sum(F.col("rate") * F.col("n_tokens") * F.col("posterior")[k]) for k in range(3)], F.min("rate")).head()
    assert all(abs(g - w * total) <= 0.002 * total for g, w in zip(got, (0.2, 0.5, 0.3))) and got[3] >= 0


def test_all_rows_and_posteriors(spark):
    docs, labels = corpus(spark)
    rows = m.mix(docs, labels, {"a": 1, "b": 1}).collect()
    assert len(rows) == 304 and all(abs(sum(r.posterior) - 1) < 1e-9 and r.rate >= 0 for r in rows)
    top = [(r.doc_id, max(range(3), key=lambda k: r.posterior[k])) for r in rows if r.doc_id is not None and r.doc_id < 300]
    assert sum("abc"[k] == "aaaaabbbc"[i % 9] for i, k in top) > 280
    assert sum(r.n_tokens for r in rows if r.doc_id in (900, 901)) == 0


def test_resample_has_the_shares_and_does_not_grow(spark):
    docs, labels = corpus(spark)
    docs = docs.where("doc_id < 300").withColumn("__words", F.lit(1)).withColumn("posterior", F.lit("x"))
    out = m.resample(docs, labels, {"a": 0.4, "b": 0.4, "c": 0.2})
    assert out.columns == docs.columns
    size = F.size(F.split("text", " "))
    kind = F.substring("text", 1, 0)
    for name, words in {"a": "red|blue|green", "b": "one|two|three", "c": "sun|moon"}.items():
        kind = F.when(F.col("text").rlike(words), name).otherwise(kind)
    got = {r[0]: r[1] for r in out.groupBy(kind).agg(F.sum(size)).collect()}
    total, before = sum(got.values()), docs.agg(F.sum(size)).head()[0]
    assert abs(total - before) < 0.15 * before and abs(got["a"] / total - 0.4) < 0.07 and abs(got["c"] / total - 0.2) < 0.07
    assert abs(out.count() - 300) < 60
    docs = corpus(spark)[0]
    assert m.resample(docs, labels.limit(0), {"a": 1.0}).count() == 304
    assert m.resample(docs, labels, {"a": 0.5, "b": 0.5}).where("doc_id IS NULL").count() == 1
    assert m.mix(docs.limit(0), labels, {"a": 1.0}).count() == 0


def test_rates_are_the_least_squares_ones(spark):
    """Against plain projected gradient steps on all rates at once, in NumPy, run to the end."""
    members = overlapping(spark, 0.06)
    rows = members.orderBy("doc_id").collect()
    n, p = np.array([r.n_tokens for r in rows], float), np.array([r.posterior for r in rows])
    goal = np.array([0.85, 0.15]) * n.sum()
    part, numbers = n[:, None] * p, np.zeros(2)
    for _ in range(200_000):
        rate = np.maximum(0, 1 + p @ numbers)
        numbers += (goal - part.T @ rate) / n.sum()
    got = m.fit_rates(members, goal.tolist(), tolerance=1e-6)[0].orderBy("doc_id").collect()
    assert np.abs(part.T @ rate - goal).max() < 1e-3 * n.sum() and (rate == 0).any()
    assert np.allclose([r.rate for r in got], rate, atol=0.02)


def test_posteriors_hold_beyond_the_sample(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(f"w{rng.randint(0, 2000)}" for _ in range(40)), "b" if rng.random() < 0.2 else "a") for k in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, d) for k, _, d in rows[:300]], "doc_id long, domain string")
    unseen = m.Domains().fit(docs, labels).members(docs.where("doc_id >= 300"))
    share = unseen.agg(F.sum(F.col("n_tokens") * F.col("posterior")[1]) / F.sum("n_tokens")).head()[0]
    assert 0.1 < share < 0.3


def overlapping(spark, spread, share=0.1):
    rng = random.Random(8)
    rows = []
    for k in range(2000):
        p = min(0.99, max(0.01, rng.gauss(share, spread)))
        rows.append((k, rng.randint(10, 50), [1 - p, p]))
    return spark.createDataFrame(rows, "doc_id long, n_tokens long, posterior array<double>").persist()


def totals(rated):
    return rated.agg(*[F.sum(F.col("rate") * F.col("n_tokens") * F.col("posterior")[k]) for k in range(2)], F.min("rate")).head()


def test_rates_reach_targets_of_overlapping_domains(spark):
    members = overlapping(spark, 0.04)
    size = members.agg(F.sum("n_tokens")).head()[0]
    rated, fit = m.fit_rates(members, [0.85 * size, 0.15 * size])
    got = totals(rated)
    assert fit.met and got[2] >= 0 and all(abs(g - w * size) <= 1e-3 * w * size for g, w in zip(got, (0.85, 0.15)))


def test_targets_out_of_reach_are_reported(spark):
    members = overlapping(spark, 0.02)
    size = members.agg(F.sum("n_tokens")).head()[0]
    _, fit = m.fit_rates(members, [0.1 * size, 0.9 * size])
    assert not fit.met and fit.residuals[1] < -0.1 * size
    rated, shares, met = m.fit_shares(members, [0.1, 0.9])
    assert not met and shares[1] < 0.3 and rated.agg(F.max("rate")).head()[0] < 1000


def test_resample_shares_of_overlapping_domains(spark):
    rated, shares, met = m.fit_shares(overlapping(spark, 0.04), [0.85, 0.15])
    got = totals(rated)
    assert met and got[2] >= 0 and abs(got[1] / (got[0] + got[1]) - 0.15) <= 2e-3 and abs(shares[1] - 0.15) <= 2e-3


def test_one_step_is_enough_where_no_rate_is_held(spark):
    """Steps are those of plain projected gradient: one where nothing is projected, some where rates end at the floor."""
    members = overlapping(spark, 0.06)
    size = members.agg(F.sum("n_tokens")).head()[0]
    near, far = (m.fit_rates(members, [(1 - w) * size, w * size], tolerance=1e-4) for w in (0.101, 0.16))
    assert near[1].met and near[1].rounds <= 2 and near[0].where("rate = 0").count() == 0
    assert far[1].met and 2 < far[1].rounds < 100 and far[0].where("rate = 0").count() > 0
    for rated, fit in (near, far):
        got = totals(rated)
        assert all(abs(g - t) < 1e-6 * size for g, t in zip(got, fit.totals))
