"""Ensembles of detectors: per-signal choice and two-of-three vote."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsewarden.operators import calibrate
from pulsewarden.operators.slices import SERIES


def choose(candidates: DataFrame, fallback: str = "sensitivity", target: float = 0.97) -> DataFrame:
    """Per signal the best of (signal, candidate, detector, meets, sens, spec, f_beta, thr).

    Detectors that meet the target come first, then sensitivity, specificity, F-beta, earlier candidate. With
    fallback='closest_spec' detectors that miss it are ranked by the distance of their specificity first.
    """
    missed = F.when(~F.col("meets"), F.abs(F.col("spec") - target)).asc_nulls_first() if fallback == "closest_spec" else F.lit(0).asc()
    order = [F.col("meets").desc(), missed, *[F.col(c).desc_nulls_last() for c in ("sens", "spec", "f_beta")], F.col("candidate").asc()]
    return calibrate.best(candidates, order, ["signal"])


def vote(alarms: DataFrame, least: int = 2, detectors: int = 3) -> DataFrame:
    """(signal, sim, t, a, y): a = 1 where at least `least` detectors alarm; days that not all scored go.

    alarms: signal, sim, t, detector, a, y. One aggregation by day takes the place of two joins.
    """
    by_day = alarms.groupBy(*SERIES, "t").agg(F.sum(F.col("a")).alias("votes"), F.count("*").alias("n"), F.max("y").alias("y"))
    return by_day.where(F.col("n") == detectors).select(*SERIES, "t", (F.col("votes") >= least).cast("int").alias("a"), "y")


def common_span(scores: DataFrame, windows: dict[str, int]) -> DataFrame:
    """Per signal the fewest scores any detector has, and the widest window of the detectors that scored it."""
    listed = F.create_map(*[F.lit(v) for pair in windows.items() for v in pair])
    by_detector = scores.groupBy("signal", "detector").agg(F.count("*").alias("n"))
    return by_detector.groupBy("signal").agg(F.min("n").alias("length"), F.max(listed[F.col("detector")]).alias("window"))


def align_global_tail(scores: DataFrame, detectors: list[str]) -> DataFrame:
    """Scores of several detectors by position from the end of each signal's concatenated series.

    This reproduces an alignment that, with unequal windows, pairs different days; vote() by day is the default.
    Labels come from the first detector. Positions are counted within each series and moved by the sizes of those after it, so
    no window holds more than a series. Rows: signal, back (1 = last), y, one score column per detector.
    """
    of = ["signal", "detector"]
    held = scores.where(F.col("detector").isin(detectors))
    sizes = held.groupBy(*of, "sim").agg(F.count("*").alias("n"))
    later = F.sum("n").over(Window.partitionBy(*of).orderBy(F.col("sim").desc()).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*of, "sim", F.coalesce(later, F.lit(0)).alias("later"))
    back = F.col("later") + F.row_number().over(Window.partitionBy(*of, "sim").orderBy(F.col("t").desc()))
    ranked = held.join(offsets, [*of, "sim"]).select(*of, "score", "y", back.alias("back"))
    sides = [F.max(F.when(F.col("detector") == d, F.col("score"))).alias(d) for d in detectors]
    joined = ranked.groupBy("signal", "back").agg(F.count("*").alias("n"), F.max(F.when(F.col("detector") == detectors[0], F.col("y"))).alias("y"), *sides)
    return joined.where(F.col("n") == len(detectors)).select("signal", "back", "y", *detectors)
