"""Alarm metrics per series and per signal.

Alarms are (signal, sim, t, a, y); a is 1, 0 or a sentinel that counts as neither. Everything per series is
one aggregation by (signal, sim); everything per signal is one more on its small result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsewarden.operators.calibrate import sens_spec
from pulsewarden.operators.slices import SERIES

#: Rows (0-based) of the comparison's denominators.
FIRST_ROW, LAST_ROW = 2205, 2547


def _n(condition: Column) -> Column:
    return F.count_if(condition)


def per_sim(alarms: DataFrame, keys: list[str] | None = None, outbreak: Column | None = None) -> DataFrame:
    """Counts of each series: tp, fp, tn, fn, days without and with outbreak, first and last outbreak, first hit."""
    keys = keys or SERIES
    a, y, t = F.col("a"), F.col("y") > 0, F.col("t")
    span = y if outbreak is None else y & outbreak
    return alarms.groupBy(*keys).agg(
        _n((a == 1) & y).alias("tp"), _n((a == 1) & ~y).alias("fp"), _n((a == 0) & ~y).alias("tn"), _n((a == 0) & y).alias("fn"),
        _n(~y).alias("quiet"), _n(y).alias("outbreak"), F.count("*").alias("n"),
        F.min(F.when(span, t)).alias("first"), F.max(F.when(span, t)).alias("last"), F.min(F.when((a == 1) & y, t)).alias("hit"),
    )


def lead() -> Column:
    """Days from the outbreak's start to the first hit, as a share of its span; null without one."""
    return (F.col("hit") - F.col("first")).cast("double") / (F.col("last") - F.col("first") + 1)


def timeliness_by_sim(no_outbreak: float | None) -> Column:
    """Lead; 1 without a hit; `no_outbreak` for a series without outbreak."""
    return F.when(F.col("outbreak") == 0, F.lit(no_outbreak).cast("double")).otherwise(F.coalesce(lead(), F.lit(1.0)))


def _per_signal(counts: DataFrame, sens: Column, spec: Column, fpr: Column | None, by: list[str]) -> DataFrame:
    columns = [sens.alias("sensitivity"), spec.alias("specificity")] + ([fpr.alias("fpr")] if fpr is not None else [])
    pod = F.avg(F.col("hit").isNotNull().cast("double")).alias("pod")
    return counts.groupBy(*by).agg(*columns, pod, (F.sum(F.coalesce(lead(), F.lit(1.0))) / F.count("*")).alias("timeliness"))


def comparator(tail: DataFrame, full: DataFrame, by: tuple[str, ...] = ("signal",)) -> DataFrame:
    """Family 1: false and true negatives over quiet days of the denominator rows, hits over all outbreak days.

    tail: alarms with labels of the evaluated days; full: labels of whole series.
    """
    keys = [*by, "sim"]
    inside = F.col("t").between(FIRST_ROW, LAST_ROW)
    y = F.col("y") > 0
    whole = full.groupBy(*keys).agg(_n(inside & ~y).alias("n0"), _n(y).alias("p"), F.min(F.when(inside & y, F.col("t"))).alias("first"), F.max(F.when(inside & y, F.col("t"))).alias("last"))
    counts = per_sim(tail, keys).drop("first", "last").join(whole, keys)
    ratio = lambda a, b: F.try_divide(F.sum(a).cast("double"), F.sum(b))
    return _per_signal(counts, ratio("tp", "p"), ratio("tn", "n0"), ratio("fp", "n0"), list(by))


def tail_only(tail: DataFrame, by: tuple[str, ...] = ("signal",)) -> DataFrame:
    """Family 2: all denominators are days of the evaluated tail, sentinels included."""
    ratio = lambda a, b: F.try_divide(F.sum(a).cast("double"), F.sum(b))
    return _per_signal(per_sim(tail, [*by, "sim"]), ratio("tp", "outbreak"), ratio("tn", "quiet"), ratio("fp", "quiet"), list(by))


def original(tail: DataFrame, by: tuple[str, ...] = ("signal",), undefined: float | None = None) -> DataFrame:
    """Family 3: ratios over days with a definite alarm value."""
    sens, spec = sens_spec(F.sum("tp"), F.sum("fp"), F.sum("tn"), F.sum("fn"), undefined)
    return _per_signal(per_sim(tail, [*by, "sim"]), sens, spec, None, list(by))


def each_sim(tail: DataFrame, no_outbreak: float | None = None, undefined: float | None = None) -> DataFrame:
    """Per series: sens, spec, pod (null without outbreak), timeliness, n_points."""
    sens, spec = sens_spec(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"), undefined)
    pod = F.when(F.col("outbreak") > 0, F.col("hit").isNotNull().cast("double"))
    return per_sim(tail).select(*SERIES, sens.alias("sens"), spec.alias("spec"), pod.alias("pod"), timeliness_by_sim(no_outbreak).alias("timeliness"), F.col("n").alias("n_points"))


def positives(labels: DataFrame) -> DataFrame:
    """Per signal the number of labelled days, of outbreak days, and their share in percent."""
    y = F.col("y") > 0
    return labels.groupBy("signal").agg(F.count("*").alias("n"), F.count_if(y).alias("positives"), (100 * F.avg(y.cast("double"))).alias("rate"))


def means(summary: DataFrame, columns: list[str], skip_missing: bool = True) -> DataFrame:
    """Mean of summary columns over signals; without skip_missing one missing value makes the mean missing."""
    out = []
    for c in columns:
        mean = F.avg(c)
        out.append((mean if skip_missing else F.when(F.count(c) == F.count(F.lit(1)), mean)).alias(c))
    return summary.agg(*out)
