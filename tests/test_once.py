"""Dear inputs are read once, however many jobs use what is made of them."""

from pyspark.sql import functions as F

from pulsewarden.functions import features
from pulsewarden.operators import search
from pulsewarden.plans import queries
from pulsewarden.sources import panels


def counting(rows, seen):
    """rows, of which each that is read adds one to `seen`."""

    def run(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    return rows.mapInPandas(run, rows.schema)


def test_events_are_read_once(spark):
    days = [("2024-01-01", "a", "x"), ("2024-01-01", "a", "x"), ("2024-01-04", "b", "x"), ("2024-01-02", "a", None), (None, "c", "y")]
    seen = spark.sparkContext.accumulator(0)
    events = counting(spark.createDataFrame(days, "d string, k string, l string"), seen)
    p = panels.daily_panels([(events, F.col("d"), ["k", "l"], 1), (events.where("k != 'c'"), F.col("d"), ["k"], 7)])
    got = {(r.signal, r.sim, r.sim_idx, r.t): r.x for r in p.collect()}
    assert p.count() == len(got) == 4 * 4 + 2 * 4 and p.where("x > 0").count() == 6 and seen.value == 2 * len(days)
    some = {(1, "sig1_sim0", 0, 1): 1.0, (1, "sig1_sim1", 1, 0): 2.0, (1, "sig1_sim2", 2, 3): 1.0, (7, "sig7_sim0", 0, 0): 2.0, (7, "sig7_sim0", 0, 1): 1.0, (7, "sig7_sim1", 1, 3): 1.0}
    assert {k: v for k, v in got.items() if v} == some and all(got[1, "sig1_sim3", 3, t] == 0 for t in range(4))
    assert panels.daily_panel(events.where("d is null"), F.col("d"), ["k"]).count() == 0


def test_panel_of_the_queries_does_not_read_events_again(spark):
    assert not [f for f in queries.panel(spark, "/root/testdata/sf0.001").inputFiles() if "lineitem" in f or "orders" in f]


def test_search_makes_features_once(spark):
    series = [(s, f"sig{s}_sim{k}", t, float((t * 7 + k) % 11), 0) for s in (1, 2) for k in range(5) for t in range(40)]
    seen = spark.sparkContext.accumulator(0)
    panel = counting(spark.createDataFrame(series, "signal int, sim string, t int, x double, y int"), seen)
    splits = spark.createDataFrame([(s, f"sig{s}_sim{k}", "train" if k < 3 else "val" if k == 3 else "test") for s in (1, 2) for k in range(5)], "signal int, sim string, split string")
    train, rows = search.inputs(panel, splits, [7, 14], features.NAMES4, 30, 20)
    read = seen.value
    assert train.count() == 6 * (24 + 17) and rows.count() == 4 * (14 + 7) and seen.value == read > 0
