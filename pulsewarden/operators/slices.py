"""Slices of series by day and by length, and splits of series into train, validation and test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["signal", "sim"]


def _by_series() -> Window:
    return Window.partitionBy(*SERIES)


def long_enough(series: DataFrame, days: int) -> DataFrame:
    """Series of at least that many days."""
    return series.withColumn("n", F.count("*").over(_by_series())).where(F.col("n") >= days).drop("n")


def head(series: DataFrame, days: int) -> DataFrame:
    return series.where(F.col("t") < days)


def tail(series: DataFrame, days: int, context: int = 0) -> DataFrame:
    """The last days of each series, with `context` days before them."""
    return series.withColumn("n", F.max("t").over(_by_series()) + 1).where(F.col("t") >= F.col("n") - days - context).drop("n")


def warmed_up(series: DataFrame, window: int) -> DataFrame:
    """Days of a slice that have a whole window behind them."""
    rank = F.row_number().over(_by_series().orderBy("t"))
    return series.withColumn("rn", rank).where(F.col("rn") >= window).drop("rn")


def in_rows(series: DataFrame, first: int, last: int) -> DataFrame:
    return series.where(F.col("t").between(first, last))


def first_common(series: DataFrame) -> DataFrame:
    """The first days of each series, as many as the shortest has."""
    ranked = series.withColumn("rn", F.row_number().over(_by_series().orderBy("t")))
    shortest = ranked.groupBy(*SERIES).agg(F.count("*").alias("n")).agg(F.min("n").alias("shortest"))
    return ranked.join(F.broadcast(shortest)).where(F.col("rn") <= F.col("shortest")).drop("rn", "shortest")


def align_tail(alarms: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of the alarms' days; days without a label count as 0."""
    return alarms.join(labels.select(*SERIES, "t", "y"), [*SERIES, "t"], "left").withColumn("y", F.coalesce("y", F.lit(0)))


def shuffled_rank(seed: int) -> Column:
    """A repeatable random order of the series of a signal."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("sim")))


def split_sims(sims: DataFrame, seed: int = 42, reuse_single: bool = False) -> DataFrame:
    """(signal, sim, split): 60 % train, of the rest half (at least one) val, then test.

    A single held-out series is val only, or with reuse_single both val and test.
    """
    order = Window.partitionBy("signal").orderBy(shuffled_rank(seed), "sim")
    ranked = sims.select(*SERIES).distinct().withColumn("rn", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("signal")))
    train = F.floor(F.col("n") * 0.6)
    held = F.col("n") - train
    val = F.greatest(F.lit(1), F.floor(held / 2))
    at = F.col("rn") - train
    splits = F.when(at <= 0, F.array(F.lit("train"))).when(at <= val, F.array(F.lit("val"))).otherwise(F.array(F.lit("test")))
    if reuse_single:
        splits = F.when((held == 1) & (at == 1), F.array(F.lit("val"), F.lit("test"))).otherwise(splits)
    return ranked.select(*SERIES, F.explode(splits).alias("split"))


def read_splits(val: DataFrame, test: DataFrame) -> DataFrame:
    """Union of two split tables; a missing split column means the table's own split, names are lower-cased."""
    out = []
    for rows, default in ((val, "val"), (test, "test")):
        missing = {"signal", "sim"} - set(rows.columns)
        if missing:
            raise ValueError(f"split table without {sorted(missing)}")
        split = F.lower("split") if "split" in rows.columns else F.lit(default)
        out.append(rows.select(F.col("signal").cast("int").alias("signal"), F.col("sim").cast("string").alias("sim"), split.alias("split")))
    return out[0].unionByName(out[1])


def adopt_splits(sims: DataFrame, splits: DataFrame) -> DataFrame:
    """Series with their given split; where a signal has no train rows, its series outside val and test are train."""
    given = sims.join(splits.distinct(), SERIES).select(*SERIES, "split")
    with_train = splits.where("split = 'train'").select("signal").distinct()
    held = splits.where("split in ('val', 'test')").select(*SERIES)
    rest = sims.join(with_train, "signal", "left_anti").join(held, SERIES, "left_anti")
    return given.unionByName(rest.select(*SERIES, F.lit("train").alias("split")))


def missing_sims(sims: DataFrame, splits: DataFrame) -> DataFrame:
    """Split rows that name no series."""
    return splits.join(sims, SERIES, "left_anti")


def split_lists(splits: DataFrame) -> DataFrame:
    """Per signal and split the sorted names of its series."""
    return splits.groupBy("signal", "split").agg(F.array_sort(F.collect_set("sim")).alias("sims"))


def restrict(series: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    """Series of one split."""
    return series.join(splits.where(F.col("split") == split).select(*SERIES), SERIES, "left_semi")


def subsample(rows: DataFrame, keys: list[str], most: int, seed: int = 42) -> DataFrame:
    """A repeatable sample without replacement of at most `most` rows: those whose keys hash lowest."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), *keys).limit(most)
