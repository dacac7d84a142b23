"""Wide matrices of daily counts as CSV files: many files in one scan, thousands of columns, files cut anywhere.

A file has a header of simulation names and a row a day. It is read as lines: a line's number comes from the counts of the
blocks before its own, so days are numbered alike however files are split, and a row is one array until its cells become
rows, so columns are never part of a plan. A folder that the writer left is read as the one file its parts make together.
Cells that are no numbers are null; quoted line feeds are not supported.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsewarden.sources import panels

# Fixed names of the files: counts, labels and seasonal labels of each signal.
NAMED = r"simulated_(totals|outbreaks|seasonal_outbreaks)_sig(\d+)\.csv$"
LABEL_SETS = {"outbreaks": "regular", "seasonal_outbreaks": "seasonal"}


def numbered_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(source, line, value): the lines of files with their numbers from 0; parts of a folder are one source."""
    read = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    read = read.withColumn("source", F.regexp_replace("file", "/part-[^/]*$", ""))
    earlier = Window.partitionBy("source").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    counts = read.groupBy("source", "file", "block").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("source", "file", "block").orderBy("at")) - 1
    placed = read.withColumn("inside", inside).join(counts.drop("n"), ["source", "file", "block"])
    return placed.select("source", (F.col("before") + F.col("inside")).alias("line"), "value")


def _cells(value: str) -> F.Column:
    return F.transform(F.split(value, ","), lambda c: F.trim(F.regexp_replace(c, '^\\s*"|"\\s*$', "")))


def read_matrices(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(source, t, sim_col, sim_idx, x) of all files: t counts rows from 0, sim_idx columns but for those of dates."""
    lines = numbered_lines(spark, paths)
    dated = lambda c: F.lower(c).isin(list(panels.DATE_NAMES))
    names = lines.where("line = 0").select("source", _cells("value").alias("names"))
    rows = lines.where("line > 0").where(F.trim("value") != "").join(names, "source")
    rows = rows.select("source", (F.col("line") - 1).cast("int").alias("t"), _cells("value").alias("cells"), "names")
    every = F.arrays_zip(F.col("names").alias("name"), F.col("cells").alias("cell"))
    kept = F.filter(every, lambda c: ~dated(c["name"]))
    each = rows.select("source", "t", F.posexplode(kept).alias("sim_idx", "c"))
    return each.select("source", "t", F.col("c.name").alias("sim_col"), "sim_idx", F.col("c.cell").alias("cell")).select("source", "t", "sim_col", "sim_idx", panels.numeric("cell").alias("x"))


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(signal, label_set, sim, sim_idx, t, x, y) of all signals' files in a folder, by one scan.

    Signal and kind of a file are in its name; other files are left out. A signal with seasonal labels has its counts once for
    each label set. A cell without a count is null, one without a label is 0.
    """
    read = read_matrices(spark, f"{folder}/simulated_*_sig*.csv")
    kind, signal = (F.regexp_extract("source", NAMED, k) for k in (1, 2))
    cells = read.where(kind != "").select(kind.alias("kind"), signal.cast("int").alias("signal"), "sim_idx", "t", "x")
    sets = F.create_map(*[F.lit(x) for pair in LABEL_SETS.items() for x in pair])
    labels = cells.where("kind <> 'totals'").select("signal", "sim_idx", "t", sets[F.col("kind")].alias("label_set"), panels.binary(F.col("x")).alias("y"))
    counts = cells.where("kind = 'totals'").select("signal", "sim_idx", "t", "x")
    joined = counts.join(labels, ["signal", "sim_idx", "t"])
    return joined.select("signal", "label_set", panels.sim_name(F.col("signal"), F.col("sim_idx")).alias("sim"), "sim_idx", "t", "x", "y")


def write_matrix(rows: DataFrame, path: str, value: str = "a", by: str = "sim", order: str = "sim_idx") -> None:
    """A CSV matrix in parts that make one file in their order: a header, then a row for each t with a column for each `by`.

    Columns follow `order`, then their name. A day's row is put together where the day is; days are dealt out by ranges, so no
    task has all, and the columns are no part of the plan. Days without rows have no line; missing cells are empty.
    """
    spark = rows.sparkSession
    listed = rows.select(F.col(order).alias("o"), F.col(by).cast("string").alias("name")).distinct().agg(F.array_sort(F.collect_list(F.struct("o", "name"))).alias("c")).head().c
    names = [r.name for r in listed]
    held = spark.sparkContext.broadcast({n: k for k, n in enumerate(names)})

    def lines(frames):
        place = held.value
        for frame in frames:
            out = []
            for sims, values in zip(frame["sims"], frame["cells"]):
                row = np.full(len(place), "", object)
                for sim, cell in zip(sims, values):
                    row[place[sim]] = cell
                out.append(",".join(row))
            yield pd.DataFrame({"value": out})

    days = rows.groupBy("t").agg(F.collect_list(F.struct(F.col(by).cast("string").alias("sim"), F.coalesce(F.col(value).cast("string"), F.lit("")).alias("cell"))).alias("x"))
    dealt = days.repartitionByRange("t").sortWithinPartitions("t").select(F.col("x.sim").alias("sims"), F.col("x.cell").alias("cells"))
    header = spark.createDataFrame([(",".join(names),)], "value string").coalesce(1)
    header.unionByName(dealt.mapInPandas(lines, "value string")).write.text(path)
