"""Alarm thresholds from labelled validation scores.

Scores are (signal, sim, t, score, y) with higher = more anomalous; an alarm is score >= threshold. A detector
whose scores are lower for anomalies negates them first: its percentile p is then minus the percentile 100 - p.
Every tuner returns one row per signal. Candidate thresholds are a fixed grid of exact percentiles; these, and the days
that reach each, come from scores sorted once (order.Ordered), so no task holds a signal's scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsewarden.operators import order
from pulsewarden.operators.order import Ordered, fraction

#: Fixed values of the reference grids.
CONTAMINATION = [0.01, 0.015, 0.02, 0.025, 0.03, 0.035, 0.04, 0.045, 0.05, 0.06, 0.07]
CONTAMINATION_FALLBACK = [0.005, 0.01, 0.015, 0.02, 0.025, 0.03, 0.035, 0.04, 0.05]
SVM_PERCENTILES = [1.0, 2.0, 3.0, 5.0, 7.0, 10.0]
STAGE_1 = [85.0, 86.0, 87.0, 88.0, 89.0, 90.0, 91.0, 92.0, 93.0, 94.0, 95.0, 96.0, 97.0, 98.0, 99.0, 99.5]
STAGE_2 = [80.0, 81.0, 82.0, 83.0, 84.0, 85.0, 86.0, 87.0, 88.0, 89.0, 90.0, 92.0, 94.0]
TAIL_GRID = [0.5 + k * 19.5 / 199 for k in range(200)]


def sens_spec(tp: Column, fp: Column, tn: Column, fn: Column, undefined: float | None = None) -> tuple[Column, Column]:
    """Sensitivity and specificity; an undefined ratio is null, or `undefined`."""
    pair = F.try_divide(tp.cast("double"), tp + fn), F.try_divide(tn.cast("double"), tn + fp)
    return pair if undefined is None else tuple(F.coalesce(x, F.lit(undefined)) for x in pair)


def f_beta(sens: Column, spec: Column, beta: float = 0.5) -> Column:
    square = beta * beta
    below = square * sens + spec + 1e-12
    return F.when(below <= 0, 0.0).otherwise((1 + square) * sens * spec / below)


def grid(scores: DataFrame | Ordered, percents: list[float], over: str = "all") -> DataFrame:
    """(signal, pos, percent, thr, sens, spec, positives, negatives) of each candidate percentile.

    over='negatives' takes percentiles over days without outbreak, or over all where a signal has none. Several grids of the
    same scores share one Ordered.
    """
    ordered = scores if isinstance(scores, Ordered) else Ordered(scores)
    met = ordered.reached(ordered.percentiles([p / 100 for p in percents], over))
    percent = F.element_at(F.array(*[F.lit(float(p)) for p in percents]), F.col("pos") + 1)
    return met.select("signal", "pos", percent.alias("percent"), "thr", fraction(F.col("tp"), F.col("positives")).alias("sens"),
                      fraction(F.col("negatives") - F.col("fp"), F.col("negatives")).alias("spec"), "positives", "negatives")


def best(rows: DataFrame, order: list[Column], by: list[str]) -> DataFrame:
    """The first row of each group; ties go to the earliest grid position when it ends the order."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__rn = 1").drop("__rn")


def _pick(cells: DataFrame, feasible: Column, objective: Column, prefix: str) -> DataFrame:
    top = best(cells.where(feasible & objective.isNotNull()), [objective.desc(), F.col("pos").asc()], ["signal"])
    return top.select("signal", *[F.col(c).alias(f"{prefix}_{c}") for c in ("percent", "thr", "sens", "spec")])


def _first_of(signals: DataFrame, parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Per signal the values of the first part that has any, with the part's name as `stage`."""
    out = signals.select("signal").distinct()
    for name, part in parts:
        out = out.join(part, "signal", "left")
    stage = F.coalesce(*[F.when(F.col(f"{n}_thr").isNotNull(), F.lit(n)) for n, _ in parts])
    pick = lambda c: F.coalesce(*[F.when(F.col(f"{n}_thr").isNotNull(), F.struct(F.col(f"{n}_{c}").alias("v"))) for n, _ in parts])["v"]
    return out.select("signal", stage.alias("stage"), *[pick(c).alias(c) for c in ("percent", "thr", "sens", "spec")])


def weighted() -> Column:
    """The objective 2 * sens + 3 * spec; null where either is undefined."""
    return 2 * F.col("sens") + 3 * F.col("spec")


def contamination(scores: DataFrame, target: float = 0.97) -> DataFrame:
    """Share of alarms by the weighted objective at the target specificity, else the most specific of small shares.

    percent is 100 times the share; scores are higher = anomalous, so the threshold is the percentile 100 - percent.
    """
    scores = Ordered(scores)
    main = grid(scores, [100 - 100 * c for c in CONTAMINATION])
    spare = grid(scores, [100 - 100 * c for c in CONTAMINATION_FALLBACK])
    found = _first_of(scores.totals(), [("main", _pick(main, F.col("spec") >= target, weighted(), "main")), ("fallback", _pick(spare, F.lit(True), F.col("spec"), "fallback"))])
    return found.withColumn("percent", 100 - F.col("percent"))


def percentiles(scores: DataFrame, target: float = 0.95) -> DataFrame:
    """One of six low percentiles of a normality score (here the high ones of its negative), else the second percentile."""
    scores = Ordered(scores)
    main = grid(scores, [100 - p for p in SVM_PERCENTILES])
    return _first_of(scores.totals(), [("main", _pick(main, F.col("spec") >= target, weighted(), "main")), ("fallback", _pick(main, F.col("pos") == 1, F.lit(0.0), "fallback"))])


def two_stage(scores: DataFrame, target: float = 0.97) -> DataFrame:
    """Percentiles 85 to 99.5 at the target specificity, then 80 to 94, then the 80th."""
    scores = Ordered(scores)
    first, second = grid(scores, STAGE_1), grid(scores, STAGE_2)
    return _first_of(scores.totals(), [
        ("first", _pick(first, F.col("spec") >= target, weighted(), "first")),
        ("second", _pick(second, F.col("spec") >= target, weighted(), "second")),
        ("last", _pick(second, F.col("pos") == 0, F.lit(0.0), "last")),
    ])


def mixes(errors: DataFrame, weights: list[tuple[float, float]], target: float = 0.97) -> DataFrame:
    """The mix of mean and peak error whose two-stage threshold scores best; adds mix, its position.

    If no mix meets the target, the mix with the best specificity at its 80th percentile.
    """
    listed = F.array(*[F.struct(F.lit(k).alias("mix"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for k, (a, b) in enumerate(weights)])
    wide = errors.select("signal", "sim", "t", "y", "mse", "peak", F.explode(listed).alias("m"))
    keyed = wide.select(F.struct("signal", "m.mix").alias("signal"), "sim", "t", "y", (F.col("m.a") * F.col("mse") + F.col("m.b") * F.col("peak")).alias("score"))
    tuned = two_stage(keyed, target).select(F.col("signal.signal").alias("signal"), F.col("signal.mix").alias("mix"), "stage", "percent", "thr", "sens", "spec")
    met = (F.col("stage") != "last") & weighted().isNotNull()
    order = [met.desc(), F.when(met, weighted()).otherwise(F.col("spec")).desc_nulls_last(), F.col("mix").asc()]
    return best(tuned, order, ["signal"])


def negative_tail(scores: DataFrame, target: float, floor: float = 0.0, beta: float | None = None) -> DataFrame:
    """The threshold leaving p percent of quiet days above it, p from 0.5 to 20: the best (sens, spec[, F-beta]) at the target.

    Without a feasible one, the closest specificity, then the higher specificity, then the higher sensitivity.
    """
    cells = grid(scores, [100 - p for p in TAIL_GRID], over="negatives")
    sens, spec = F.coalesce("sens", F.lit(0.0)), F.coalesce("spec", F.lit(0.0))
    cells = cells.withColumn("sens", sens).withColumn("spec", spec)
    fb = f_beta(F.col("sens"), F.col("spec"), beta if beta is not None else 0.5)
    meets = (F.col("spec") >= target) & (F.col("sens") >= floor)
    wins = [F.col("sens"), F.col("spec"), *([fb] if beta is not None else [])]
    spare = [F.abs(F.col("spec") - target).asc(), F.col("spec").desc(), F.col("sens").desc()]
    order = [meets.desc(), *[F.when(meets, c).desc_nulls_last() for c in wins], F.when(meets, F.col("pos")).asc_nulls_last(), *spare, F.col("pos").asc()]
    return best(cells, order, ["signal"]).select("signal", meets.alias("meets"), (100 - F.col("percent")).alias("percent"), "thr", "sens", "spec", fb.alias("f_beta"))


def guard_rail(tuned: DataFrame, train_scores: DataFrame, percent: float = 95.0) -> DataFrame:
    """The tuned threshold, but not below a percentile of the train scores; that percentile where nothing was tuned."""
    rail = order.percentile(train_scores, percent / 100, "rail")
    joined = rail.join(tuned.select("signal", F.col("thr").alias("tuned")), "signal", "left")
    return joined.select("signal", "tuned", "rail", F.greatest("tuned", "rail").alias("thr"))


def choose_config(tuned: DataFrame, target: float) -> DataFrame:
    """Per signal the configuration with the best objective: weighted if it meets the target, else its specificity.

    tuned: signal, config (position), sens, spec.
    """
    score = F.when(F.col("spec") >= target, weighted()).otherwise(F.col("spec"))
    return best(tuned.withColumn("objective", score), [F.col("objective").desc_nulls_last(), F.col("config").asc()], ["signal"])


def with_default(tuned: DataFrame, train_errors: DataFrame, mix: int, percent: float = 95.0) -> DataFrame:
    """The tuned mixes, and for signals without validation days the default mix with a percentile of the mean error of train days.

    tuned is what mixes returns, train_errors has signal and mse. The threshold of such a signal is one of the mean
    error alone, though its scores are those of the mix.
    """
    rest = train_errors.join(tuned.select("signal"), "signal", "left_anti")
    missing = lambda: F.lit(None).cast("double")
    spare = order.percentile(rest, percent / 100, "thr", "mse").select(
        "signal", F.lit(mix).alias("mix"), F.lit("default").alias("stage"), F.lit(percent).alias("percent"), "thr", missing().alias("sens"), missing().alias("spec"))
    return tuned.unionByName(spare)


def apply_choice(scores: DataFrame, chosen: DataFrame) -> DataFrame:
    """Scores of each signal's chosen configuration, with a = 1 where they reach its threshold.

    scores: signal, sim, t, config, score, y; chosen: signal, config, thr, a row a signal.
    """
    small = F.broadcast(chosen.select("signal", "config", "thr"))
    return scores.join(small, ["signal", "config"]).withColumn("a", (F.col("score") >= F.col("thr")).cast("int")).drop("thr")


def alarms(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Scores with a = 1 where they reach their signal's threshold."""
    small = F.broadcast(thresholds.select("signal", "thr"))
    return scores.join(small, "signal").withColumn("a", (F.col("score") >= F.col("thr")).cast("int")).drop("thr")


def transductive(scores: DataFrame, shares: DataFrame) -> DataFrame:
    """Alarms for a fixed share of the test scores themselves: shares has signal and percent (of alarms)."""
    listed = [r.percent for r in shares.select("percent").distinct().orderBy("percent").collect()]
    if not listed:
        return scores.withColumn("a", F.lit(0)).limit(0)
    found = Ordered(scores.select("signal", "score")).percentiles([1 - p / 100 for p in listed])
    position = F.element_at(F.array(*[F.lit(p) for p in listed]), F.col("pos") + 1)
    return alarms(scores, found.withColumn("percent", position).join(shares.select("signal", "percent"), ["signal", "percent"]).select("signal", "thr"))
