"""Search over detector configurations: one plan for all signals and configurations of a detector.

Configurations are a key beside the signal, from features through models, scores and thresholds to alarms; none is a loop.
Features of all windows come from one sort, models and scores are written once and listed in a manifest, thresholds and
the choice of a configuration come from validation series alone, and test series are scored once.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsewarden.functions import features
from pulsewarden.operators import calibrate, slices, tables

KEYS = ["signal", "sim", "t"]

# Fixed values of the grids to match: (window, trees, share of rows, share of features) and (window, nu).
FOREST_GRID = [(7, 200, 0.7, 0.6), (7, 500, 0.9, 0.8), (14, 200, 0.9, 0.6), (14, 500, 0.7, 0.8), (21, 200, 0.7, 0.8), (21, 500, 0.9, 0.6)]
SVM_GRID = [(7, 0.03), (7, 0.05), (7, 0.07), (14, 0.03), (14, 0.05), (14, 0.07), (21, 0.03), (21, 0.05), (21, 0.07)]


class Found(NamedTuple):
    scores: DataFrame  # signal, config, sim, t, score, y of validation and test series
    tuned: DataFrame  # signal, config, thr, sens, spec
    chosen: DataFrame  # signal, config, objective, thr, sens, spec
    alarms: DataFrame  # test series: signal, sim, t, config, score, y, a
    manifest: DataFrame  # detector, config, settings, models, scores: what was written where


def inputs(panel: DataFrame, splits: DataFrame, windows: list[int], names: tuple[str, ...], train_days: int, tail_days: int,
           tail_context: bool = False, train_exclude_outbreaks: bool = False) -> tuple[DataFrame, DataFrame]:
    """(train rows, rows to score): standardised features by config, whose window is windows[config].

    Train rows are the first days of train series, the others the last days of validation and test series; windows stay
    inside these. A series that is held out for both is scored once. With tail_context the windows of the last days reach
    back before them, so that every one of these days has a row for every window. Features are written once. With train_exclude_outbreaks days whose
    label y is above 0 are no train rows, though windows of later days hold their counts; without it labels are not looked at.
    """
    of = {w: [k for k, x in enumerate(windows) if x == w] for w in sorted(set(windows))}
    head = features.by_windows(slices.head(slices.restrict(panel, splits, "train"), train_days), tuple(of), names)
    if train_exclude_outbreaks:
        head = head.join(panel.where("y > 0").select(*KEYS), KEYS, "left_anti")
    held = panel.join(splits.where("split in ('val', 'test')").select(*slices.SERIES).distinct(), slices.SERIES, "left_semi")
    last = features.by_windows(slices.tail(held, tail_days, max(windows) - 1 if tail_context else 0), tuple(of), names)
    if tail_context:
        last = slices.tail(last, tail_days)
    head, last = tables.committed(head, "train-features"), tables.committed(last, "held-features")
    configs = F.element_at(F.create_map(*[x for w, ks in of.items() for x in (F.lit(w), F.array(*[F.lit(k) for k in ks]))]), F.col("window"))
    scaled = lambda rows: features.standardise_arrays(rows, head, ["signal", "window"]).select(*KEYS, F.explode(configs).alias("config"), "features")
    return scaled(head), scaled(last)


def search(detector, train: DataFrame, rows: DataFrame, labels: DataFrame, splits: DataFrame, tune: Callable[[DataFrame], DataFrame], target: float, settings: list | None = None) -> Found:
    """Fit all configurations, tune each on validation series and apply each signal's best to its test series.

    A configuration without validation rows of a signal is not chosen for it; a signal without any has no alarms.
    """
    spark = train.sparkSession
    model = detector.fit(train)
    path = tables.folder(spark, f"{detector.name}-scores")
    scores = tables.committed(model.score(rows).join(labels.select(*KEYS, "y"), KEYS).select("signal", "config", "sim", "t", "score", "y"), "scores", path)
    val, test = (slices.restrict(scores, splits, s) for s in ("val", "test"))
    keyed = val.select(F.struct("signal", "config").alias("signal"), "sim", "t", "score", "y")
    tuned = tune(keyed).select("signal.signal", "signal.config", "thr", "sens", "spec")
    chosen = calibrate.choose_config(tuned, target)
    files = getattr(model, "model", None)
    listed = [(detector.name, k, json.dumps(s), ",".join(sorted({f.rsplit("/", 1)[0] for f in files.inputFiles()})) if files is not None else None, path) for k, s in enumerate(settings or [])]
    manifest = spark.createDataFrame(listed, "detector string, config int, settings string, models string, scores string")
    return Found(scores, tuned, chosen, calibrate.apply_choice(test, chosen), manifest)
