import random

from pyspark.sql import functions as F

from pulsewarden.llm import toxicity as t


def corpus(spark, n=600):
    rng = random.Random(1)
    plain, bad = [f"word{k}" for k in range(300)], ["vile", "scummy", "moronic"]
    rows = []
    for k in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 200))]
        toxic = k % 5 == 0
        for _ in range(rng.choice([1, 3, 6]) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", ",", "!"])
        if toxic:
            words.append(rng.choice(bad))
        rows.append((k, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(i, x, 9) for i, x, _ in rows] + [(9000, None, 9), (9001, "", 9), (9002, "word1 " * 40000, 9), (9003, "word2 " * 30000 + "vile scummy", 9), (None, "vile moronic", 9)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows[:400]] + [(3, 1, 0), (None, 1, 1), (7000, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels, {i: y for i, _, y in rows}


def test_held_out(spark):
    docs, labels, truth = corpus(spark)
    model = t.train(docs, labels)
    got = {r.doc_id: r.severity for r in t.score(docs, model).collect()}
    assert sum((got[i] >= 0.6) == bool(truth[i]) for i in range(400, 600)) >= 198
    assert got[9000] == got[9001] < 0.6 and got[9002] < 0.6 and got[9003] >= 0.6 and got[None] >= 0.6
    assert (model.thresholds[1:] >= model.thresholds[:-1]).all()
    kept = t.keep_clean(docs, labels)
    assert kept.columns == docs.columns and 9000 in {r.doc_id for r in kept.collect()}


def test_severity_follows_evidence(spark):
    docs, labels, _ = corpus(spark)
    model = t.train(docs, labels)
    texts = spark.createDataFrame([(0, "word3 word4"), (1, "word3 vile"), (2, "word3 vile scummy moronic")], "doc_id long, text string")
    s = [r.severity for r in t.score(texts, model).orderBy("doc_id").collect()]
    assert s[0] < s[1] < s[2]


def test_one_grade_and_empty(spark):
    docs, labels, _ = corpus(spark, 50)
    for some in (labels.where("toxic = 0"), labels.limit(0)):
        rows = t.score(docs, t.train(docs, some)).select(F.max("severity")).head()
        assert rows[0] < 1e-6
    assert t.keep_clean(docs.limit(0), labels).collect() == []
