import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsewarden.sources import wide_files


def matrix(path, names, rows):
    path.write_text("\n".join([",".join(names), *(",".join("" if v is None else str(v) for v in r) for r in rows)]) + "\n")


@pytest.mark.parametrize("block", ["1g", "200b", "37b"])
def test_lines_are_numbered_alike_however_files_are_split(spark, tmp_path, block):
    for k in range(3):
        (tmp_path / f"f{k}.csv").write_text("\n".join(f"line {n} of {k}" for n in range(120 + k)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        got = [tuple(r) for r in wide_files.numbered_lines(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((n, v) for _, n, v in got) == sorted((n, f"line {n} of {k}") for k in range(3) for n in range(120 + k))


def test_scan_of_sixteen_signals_and_three_seasonal_label_files(spark, tmp_path):
    want = set()
    rng = np.random.default_rng(1)
    for s in range(1, 17):
        x, y, z = (rng.integers(0, 4, (20, 3)) for _ in range(3))
        dates = [[f"2020-01-{d + 1:02d}"] for d in range(20)]
        matrix(tmp_path / f"simulated_totals_sig{s}.csv", ["Date", "a", "b", "c"], [d + r for d, r in zip(dates, x.tolist())])
        matrix(tmp_path / f"simulated_outbreaks_sig{s}.csv", ["date", "a", "b", "c"], [d + r for d, r in zip(dates, y.tolist())])
        sets = [("regular", y)]
        if s in (5, 6, 15):
            matrix(tmp_path / f"simulated_seasonal_outbreaks_sig{s}.csv", ['"a"', '"b"', '"c"'], z.tolist())
            sets.append(("seasonal", z))
        want |= {(s, name, f"sig{s}_sim{k}", k, t, float(x[t, k]), int(m[t, k] > 0)) for name, m in sets for t in range(20) for k in range(3)}
    (tmp_path / "simulated_other_sig1.csv").write_text("a\n1\n")
    got = [tuple(r) for r in wide_files.scan(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_odd_cells(spark, tmp_path):
    matrix(tmp_path / "m.csv", ["a", "ds", "b"], [[1, "x", None], ["many", "y", "2.5"], ["NaN", "z", "1e300"], ["inf", "w", " 7 "]])
    got = {(r.t, r.sim_col, r.sim_idx): r.x for r in wide_files.read_matrices(spark, str(tmp_path / "m.csv")).collect()}
    assert got == {(0, "a", 0): 1.0, (0, "b", 1): None, (1, "a", 0): None, (1, "b", 1): 2.5, (2, "a", 0): None, (2, "b", 1): 1e300, (3, "a", 0): float("inf"), (3, "b", 1): 7.0}


def test_round_trip_of_five_thousand_columns(spark, tmp_path):
    cells = spark.range(5000 * 12).select((F.col("id") % 5000).cast("int").alias("sim_idx"), (F.col("id") / 5000).cast("int").alias("t"), F.when(F.col("id") % 7 > 0, F.col("id") * 0.5).alias("a"))
    cells = cells.withColumn("sim", F.concat(F.lit("s"), F.col("sim_idx").cast("string"))).where("sim_idx <> 17 OR t <> 3")
    path = str(tmp_path / "matrix.csv")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        wide_files.write_matrix(cells, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "matrix.csv").glob("part-*"))) > 2
    back = wide_files.read_matrices(spark, path)
    assert back.count() == 60_000 and back.where("sim_idx = 17 AND t = 3 AND x IS NULL").count() == 1
    both = back.join(cells.select("sim_idx", "t", F.col("sim").alias("sim_col"), "a"), ["sim_idx", "t", "sim_col"])
    assert both.where("x <=> a").count() == 59_999
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "s4999" not in plan
