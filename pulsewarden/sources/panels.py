"""Long panels of daily counts: from wide CSV or Parquet files and from event tables.

Canonical columns: signal INT, sim STRING, sim_idx INT, t INT (0-based day), x DOUBLE; labels add y INT.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsewarden.operators import tables

#: Names of date columns, compared without case; they are dropped.
DATE_NAMES = ("date", "ds", "timestamp")


def drop_dates(wide: DataFrame, variant: str = "all") -> DataFrame:
    """Without date columns: every one ('all'), or only the first ('first')."""
    found = [c for c in wide.columns if c.lower() in DATE_NAMES]
    return wide.drop(*(found if variant == "all" else found[:1]))


def numeric(name: str, missing_as_zero: bool = False) -> Column:
    """A cell as a number: what is none becomes null, or 0."""
    value = F.col(f"`{name}`").try_cast("double")
    value = F.when(F.isnan(value), None).otherwise(value)
    return F.coalesce(value, F.lit(0.0)) if missing_as_zero else value


def binary(value: Column) -> Column:
    """1 where a label is above 0, else 0; a missing label is 0."""
    return F.coalesce(value > 0, F.lit(False)).cast("int")


def sim_name(signal: Column, index: Column) -> Column:
    return F.concat(F.lit("sig"), signal.cast("string"), F.lit("_sim"), index.cast("string"))


def parse_sim(sim: Column) -> tuple[Column, Column]:
    """(signal, index) of a name such as sig3_sim12; nulls if it isn't one."""
    pattern = r"^sig(\d+)_sim(\d+)$"
    return tuple(F.nullif(F.regexp_extract(sim, pattern, k), F.lit("")).try_cast("int") for k in (1, 2))


def read_wide(spark: SparkSession, path: str, on_missing: str = "error") -> DataFrame | None:
    """A wide CSV file with header. A missing file is an error or, with 'skip', None."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        if on_missing == "skip":
            return None
        raise FileNotFoundError(path)
    return spark.read.option("header", True).csv(path)


def to_long(wide: DataFrame, day: str, value: str = "x") -> DataFrame:
    """(day, sim_col, sim_idx, value): one row per day and simulation column; sim_idx counts columns from 0."""
    sims = [c for c in drop_dates(wide).columns if c != day]
    typed = wide.select(F.col(day), *[numeric(c).alias(c) for c in sims])
    long = typed.unpivot([day], sims, "sim_col", value)
    position = F.create_map(*[F.lit(v) for k, c in enumerate(sims) for v in (c, k)])
    return long.withColumn("sim_idx", position[F.col("sim_col")])


def with_ordinal(series: DataFrame, day: str = "day", keys: tuple[str, ...] = ("signal", "sim")) -> DataFrame:
    """t, the position of each day among the days its series has, from 0."""
    return series.withColumn("t", F.row_number().over(Window.partitionBy(*keys).orderBy(day)) - 1)


def check_shapes(frames: dict[str, DataFrame]) -> None:
    """Raise unless all wide frames have as many simulation columns."""
    widths = {name: len(drop_dates(f).columns) for name, f in frames.items()}
    if len(set(widths.values())) > 1:
        raise ValueError(f"differing numbers of simulations: {widths}")


def daily_panels(parts: list[tuple[DataFrame, Column, list[str], int]]) -> DataFrame:
    """Counts per day and key of several event tables (events, day, keys, signal), with every day of a table's range present and zeros filled in.

    Counts are written once: events are read by one scan, however often the panel is used. A signal's series are numbered by their
    sorted key; the keys (one a series) are sorted in one row, then dealt out, and each key's days are made where the key
    went, by sequences and not by a cross join of rows.
    """
    each = [events.select(F.lit(signal).alias("signal"), day.cast("date").alias("day"), F.concat_ws("/", *keys).alias("key")) for events, day, keys, signal in parts]
    counted = functools.reduce(DataFrame.unionByName, each).groupBy("signal", "key", "day").agg(F.count("*").cast("double").alias("x"))
    counted = tables.committed(counted, "daily-counts")
    spans = counted.groupBy("signal").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.array_sort(F.collect_set("key")).alias("names"))
    calendar = spans.select("signal", F.posexplode("names").alias("sim_idx", "key"), "first", "last").repartition("signal", "key")
    calendar = calendar.select("signal", "sim_idx", "key", F.posexplode(F.sequence("first", "last")).alias("t", "day"))
    filled = calendar.join(counted, ["signal", "key", "day"], "left")
    return filled.select("signal", sim_name(F.col("signal"), F.col("sim_idx")).alias("sim"), "sim_idx", "t", F.coalesce("x", F.lit(0.0)).alias("x"))


def daily_panel(events: DataFrame, day: Column, keys: list[str], signal: int = 1) -> DataFrame:
    """daily_panels of one event table."""
    return daily_panels([(events, day, keys, signal)])


def with_outbreaks(panel: DataFrame) -> DataFrame:
    """The panel with planted labels: ten days of every 170, shifted by series."""
    return panel.withColumn("y", (((F.col("t") + 31 * F.col("sim_idx")) % 170) < 10).cast("int"))


def join_labels(series: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ("signal", "sim", "t")) -> DataFrame:
    """Counts with their labels by key, not by position."""
    return series.join(labels, list(keys))


def wide(alarms: DataFrame, sims: list[str], value: str = "a", by: str = "sim", keys: tuple[str, ...] = ("t",)) -> DataFrame:
    """A row per day, a column per simulation, null where a simulation has no such day. The simulations are given, so that no pass finds them."""
    return alarms.groupBy(*keys).pivot(by, sims).agg(F.first(value))


def write_wide(alarms: DataFrame, path: str, sims: list[str], value: str = "a", by: str = "sim") -> None:
    """One CSV file, a row per day in order, a column per simulation."""
    wide(alarms, sims, value, by).orderBy("t").drop("t").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_table(rows: DataFrame, path: str, order: list[str], header: bool = True) -> None:
    """One sorted CSV file of a summary or of per-series metrics."""
    rows.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", header).csv(path)
