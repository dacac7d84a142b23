"""Rolling features of daily series by window functions; slices are taken before, so lags stay inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsewarden.operators.slices import SERIES

EPSILON = 1e-6
NAMES20 = (
    "x", "mean7", "meanw", "max7", "maxw", "ratio7", "ratiow", "rank7", "rankw", "diff1", "diff7", "diff14",
    "std7", "stdw", "cv", "slope", "residual", "z", "robust_z", "minmax",
)
NAMES4 = ("x", "mean", "std", "ratio")


def _frame(days: int) -> Window:
    return Window.partitionBy(*SERIES).orderBy("t").rowsBetween(1 - days, 0)


def _share_up_to(values: Column, x: Column) -> Column:
    return F.size(F.filter(values, lambda v: v <= x)) / F.size(values)


def _middle(ordered: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(ordered)
    return (F.element_at(ordered, F.floor((n + 1) / 2).cast("int")) + F.element_at(ordered, F.floor(n / 2 + 1).cast("int"))) / 2


def features20(series: DataFrame, window: int) -> DataFrame:
    """Twenty features of each day that has a whole window: keys, t, then the columns of NAMES20.

    One sort by (series, day) serves all frames. The window's values are collected once; its median, the
    absolute deviations and both ranks come from that array.
    """
    days = Window.partitionBy(*SERIES).orderBy("t")
    w, s = _frame(window), _frame(7)
    x = F.col("x")
    base = series.select(
        *SERIES, "t", "x",
        F.row_number().over(days).alias("rn"),
        F.avg("x").over(s).alias("mean7"), F.avg("x").over(w).alias("meanw"),
        F.max("x").over(s).alias("max7"), F.max("x").over(w).alias("maxw"), F.min("x").over(w).alias("minw"),
        F.stddev_pop("x").over(s).alias("std7"), F.stddev_pop("x").over(w).alias("stdw"),
        F.first("x").over(w).alias("first"),
        *[F.coalesce(x - F.lag("x", k).over(days), F.lit(0.0)).alias(f"diff{k}") for k in (1, 7, 14)],
        F.collect_list("x").over(w).alias("values"),
    ).where(F.col("rn") >= window)
    base = base.withColumn("ordered", F.array_sort("values"))
    base = base.withColumn("median", _middle(F.col("ordered")))
    base = base.withColumn("mad", _middle(F.array_sort(F.transform("values", lambda v: F.abs(v - F.col("median"))))))
    mad = F.when(F.col("mad") == 0, EPSILON).otherwise(F.col("mad"))
    slope = (x - F.col("first")) / (window + EPSILON)
    return base.select(
        *SERIES, "t", "x", "mean7", "meanw", "max7", "maxw",
        (x / (F.col("mean7") + EPSILON)).alias("ratio7"), (x / (F.col("meanw") + EPSILON)).alias("ratiow"),
        _share_up_to(F.slice("values", -min(7, window), min(7, window)), x).alias("rank7"), _share_up_to(F.col("values"), x).alias("rankw"),
        "diff1", "diff7", "diff14", "std7", "stdw",
        (F.col("stdw") / (F.col("meanw") + EPSILON)).alias("cv"), slope.alias("slope"),
        (x - (F.col("first") + slope * (window - 1))).alias("residual"),
        ((x - F.col("meanw")) / (F.col("stdw") + EPSILON)).alias("z"),
        (0.6745 * (x - F.col("median")) / mad).alias("robust_z"),
        ((x - F.col("minw")) / (F.col("maxw") - F.col("minw") + EPSILON)).alias("minmax"),
    )


def by_windows(series: DataFrame, windows: tuple[int, ...], names: tuple[str, ...] = NAMES20) -> DataFrame:
    """(signal, sim, window, t, features): the 20 features, or the 4 of NAMES4, of several window lengths from one sort.

    Each day that has a whole window of a length is a row of it.
    """
    days = Window.partitionBy(*SERIES).orderBy("t")
    x, s = F.col("x"), _frame(7)
    if names == NAMES4:
        base = series.select(*SERIES, "t", "x", F.row_number().over(days).alias("rn"), *[f("x").over(_frame(w)).alias(f"{c}{w}") for w in windows for f, c in ((F.avg, "mean_"), (F.stddev_pop, "std_"))])
        rows = [F.struct(F.lit(w).alias("window"), F.array(x, F.col(f"mean_{w}"), F.col(f"std_{w}"), x / (F.col(f"mean_{w}") + EPSILON)).alias("features")) for w in windows]
    else:
        own = [f("x").over(_frame(w)).alias(f"{c}{w}") for w in windows for f, c in ((F.avg, "mean_"), (F.max, "max_"), (F.min, "min_"), (F.stddev_pop, "std_"), (F.first, "first_"), (F.collect_list, "values_"))]
        base = series.select(*SERIES, "t", "x", F.row_number().over(days).alias("rn"), F.avg("x").over(s).alias("mean7"), F.max("x").over(s).alias("max7"), F.stddev_pop("x").over(s).alias("std7"),
                             *[F.coalesce(x - F.lag("x", k).over(days), F.lit(0.0)).alias(f"diff{k}") for k in (1, 7, 14)], *own)
        base = base.select("*", *[F.array_sort(f"values_{w}").alias(f"ordered_{w}") for w in windows])
        base = base.select("*", *[_middle(F.col(f"ordered_{w}")).alias(f"median_{w}") for w in windows])
        rows = [F.struct(F.lit(w).alias("window"), F.array(*_row20(w)).alias("features")) for w in windows]
    whole = [F.when(F.col("rn") >= w, r) for w, r in zip(windows, rows)]
    each = base.select(*SERIES, "t", F.explode(F.array(*whole)).alias("r")).where(F.col("r").isNotNull())
    return each.select(*SERIES, F.col("r.window").alias("window"), "t", F.col("r.features").alias("features"))


def _row20(w: int) -> list[Column]:
    """The features in the order of NAMES20 from by_windows' columns of window w."""
    x, of = F.col("x"), lambda c: F.col(f"{c}_{w}")
    mad = _middle(F.array_sort(F.transform(of("values"), lambda v: F.abs(v - of("median")))))
    slope = (x - of("first")) / (w + EPSILON)
    return [
        x, F.col("mean7"), of("mean"), F.col("max7"), of("max"), x / (F.col("mean7") + EPSILON), x / (of("mean") + EPSILON),
        _share_up_to(F.slice(of("values"), -min(7, w), min(7, w)), x), _share_up_to(of("values"), x), F.col("diff1"), F.col("diff7"), F.col("diff14"), F.col("std7"), of("std"),
        of("std") / (of("mean") + EPSILON), slope, x - (of("first") + slope * (w - 1)), (x - of("mean")) / (of("std") + EPSILON),
        0.6745 * (x - of("median")) / F.when(mad == 0, EPSILON).otherwise(mad), (x - of("min")) / (of("max") - of("min") + EPSILON),
    ]


def standardise_arrays(rows: DataFrame, fitted_on: DataFrame, by: list[str]) -> DataFrame:
    """Each place of `features` less its mean, over its population deviation, both from fitted_on by the given keys; deviation 0 counts as 1.

    Keys that fitted_on lacks give no rows. Both tables' arrays have one length.
    """
    places = fitted_on.select(*by, F.posexplode("features").alias("p", "v")).groupBy(*by, "p").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct("p", "m", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")).alias("s"))))
    moments = places.groupBy(*by).agg(ordered.alias("moments"))
    return rows.join(moments, by).withColumn("features", F.zip_with("features", "moments", lambda v, m: (v - m["m"]) / m["s"])).drop("moments")


def features4(series: DataFrame, window: int) -> DataFrame:
    """x, window mean, population deviation and x / (mean + eps) of each day with a whole window."""
    w = _frame(window)
    base = series.select(*SERIES, "t", "x", F.row_number().over(Window.partitionBy(*SERIES).orderBy("t")).alias("rn"), F.avg("x").over(w).alias("mean"), F.stddev_pop("x").over(w).alias("std"))
    return base.where(F.col("rn") >= window).select(*SERIES, "t", "x", "mean", "std", (F.col("x") / (F.col("mean") + EPSILON)).alias("ratio"))


def sequences(series: DataFrame, length: int = 14, stride: int = 1) -> DataFrame:
    """(signal, sim, t, seq, y): windows of `length` days, every stride-th, labelled by their last day."""
    w = _frame(length)
    rows = series.select(*SERIES, "t", "y", F.collect_list("x").over(w).alias("seq"), F.row_number().over(Window.partitionBy(*SERIES).orderBy("t")).alias("rn"))
    return rows.where((F.col("rn") >= length) & ((F.col("rn") - length) % stride == 0)).select(*SERIES, "t", "seq", "y")


def standardise(rows: DataFrame, fitted_on: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their signal's mean, over its population deviation, both from fitted_on; deviation 0 counts as 1.

    Moments are one row a signal; a signal that fitted_on lacks has none, and its columns are null.
    """
    moments = fitted_on.groupBy("signal").agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    scaled = [((F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}"))).alias(c) for c in columns]
    return rows.join(moments, "signal", "left").select(*[c for c in rows.columns if c not in columns], *scaled)


def weekly(series: DataFrame, k: int) -> DataFrame:
    """Weeks that end on day k (1-based), counted back: (signal, sim, week, cases), week 1 the oldest.

    round(k / 7) weeks; an oldest week that would start before day 1 is left at 0.
    """
    weeks = F.bround(F.lit(k) / 7).cast("int")
    back = F.floor((k - (F.col("t") + 1)) / 7).cast("int")
    summed = series.where(F.col("t") + 1 <= k).where(F.lit(k) - 7 * back - 6 >= 1).withColumn("back", back).where(F.col("back") < weeks)
    summed = summed.groupBy(*SERIES, (weeks - F.col("back")).alias("week")).agg(F.sum("x").alias("cases"))
    every = series.select(*SERIES).distinct().select(*SERIES, F.explode(F.sequence(F.lit(1), weeks)).alias("week"))
    return every.join(summed, [*SERIES, "week"], "left").select(*SERIES, "week", F.coalesce("cases", F.lit(0.0)).alias("cases"))


def anchored_weeks(series: DataFrame, most: int = 266) -> DataFrame:
    """(signal, sim, t, weeks): for each day the sums of the weeks that end on it, seven days before it and so on, newest first.

    At most `most` weeks, whole ones only; a day before the seventh has none. Days seven apart share their weeks, so one
    window over the days of a residue modulo 7 has the weeks of all of them. Series have all their days.
    """
    summed = series.select(*SERIES, "t", F.sum("x").over(_frame(7)).alias("week"), F.row_number().over(Window.partitionBy(*SERIES).orderBy("t")).alias("rn")).where(F.col("rn") >= 7)
    back = Window.partitionBy(*SERIES, F.pmod("t", F.lit(7))).orderBy("t").rowsBetween(1 - most, 0)
    return summed.select(*SERIES, "t", F.reverse(F.collect_list("week").over(back)).alias("weeks"))


def trim_leading_zeros(weeks: DataFrame) -> DataFrame:
    """Leading zero weeks become null; first_week is the first week with cases, or the last if none has."""
    by = Window.partitionBy(*SERIES)
    first = F.coalesce(F.min(F.when(F.col("cases") > 0, F.col("week"))).over(by), F.max("week").over(by))
    return weeks.withColumn("first_week", first).withColumn("cases", F.when(F.col("week") >= F.col("first_week"), F.col("cases")))


def recent_cases(series: DataFrame, days: int = 28, least: float = 5.0) -> DataFrame:
    """Cases of the last four weeks on each day and whether they are enough for an alarm."""
    recent = F.sum("x").over(_frame(days))
    return series.select(*SERIES, "t", recent.alias("recent")).withColumn("enough", F.col("recent") >= least)
