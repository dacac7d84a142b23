import __spark_entry__ as entry


def test_every_sql_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0].asDict().keys() == {"signal", "sim", "sens", "spec", "pod", "timeliness", "n_points"}


def test_queries_take_the_plain_path(spark):
    """No join of rows without keys other than with single-row summaries, and filters reach the scan."""
    for name in ("tail_slice", "metrics_r", "vote_2of3", "tune_two_stage"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "PythonUDF" not in plan
