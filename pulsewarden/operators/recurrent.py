"""Recurrent sequence autoencoders, one a signal, fitted by gradients that are summed over all partitions.

A step is one Spark job: each partition adds up the gradients of its sequences for each signal, the sums of the partitions
are added, and the driver moves each signal's parameters (Adam). Sequences stay where they are; only parameters (some
MB a signal) and gradients travel, and no task holds a signal. Signals are trained in blocks of `at_once`, so the
driver's share is bounded however many there are.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsewarden.functions import bilstm
from pulsewarden.operators.keyed_sums import keyed_sums

KEYS = ["signal", "sim", "t"]
#: Rows that are normalised together at most.
BATCH = 512


class Model(NamedTuple):
    flat: np.ndarray
    moments: np.ndarray


class Course:
    """What is kept of a signal's training: rate, best weights, when to halve and when to stop.

    Training stops after `patience` epochs without a better loss, of which those before `floor` do not count; the rate is
    halved after `plateau` epochs without one; a loss that is not a number stops at once. The best weights stay.
    """

    def __init__(self, rate: float, floor: int, patience: int, plateau: int = 5, least: float = 1e-6):
        self.rate, self.floor, self.patience, self.plateau, self.least = rate, floor, patience, plateau, least
        self.epoch, self.best, self.model = 0, math.inf, None
        self.waited = self.flat_for = 0
        self.lowest, self.done = math.inf, False

    def judge(self, loss: float, model: Model) -> None:
        """Take note of an epoch's loss, reached by `model`."""
        self.epoch += 1
        if math.isnan(loss) or math.isinf(loss):
            self.done = True
            return
        if self.model is None:
            self.model = model
        if loss < self.lowest:
            self.lowest, self.flat_for = loss, 0
        else:
            self.flat_for += 1
            if self.flat_for >= self.plateau:
                self.rate, self.flat_for = max(self.rate / 2, self.least), 0
        if self.epoch < self.floor:
            return
        if loss < self.best:
            self.best, self.model, self.waited = loss, model, 0
        else:
            self.waited += 1
            self.done = self.waited >= self.patience


class SequenceAutoencoder:
    """Bidirectional LSTM autoencoder a signal. Rows to fit: signal, seq, and `held` (true: for validation only).

    Scores mix mean squared and largest absolute reconstruction error. Sequences are not scaled; the output starts at the
    mean of the signal's train days. An epoch is `batches` steps, each over the rows that hash to it. Sequences with nulls are
    left out of the fit and have null errors; a signal without train rows has no model and no scores.
    """

    def __init__(self, shape: bilstm.Shape = bilstm.Shape(), *, epochs: int = 60, rate: float = 1e-3, floor: int = 20, patience: int = 7, batches: int = 1,
                 weights: tuple[float, float] = (0.8, 0.2), seed: int = 42, at_once: int = 64):
        self.name, self.shape, self.epochs, self.rate, self.floor, self.patience = "seqauto", shape, epochs, rate, floor, patience
        self.batches, self.weights, self.seed, self.at_once = batches, weights, seed, at_once
        self.models: dict[int, Model] = {}
        self.losses: dict[int, list[float]] = {}

    def fit(self, rows: DataFrame) -> "SequenceAutoencoder":
        """rows are read once a step; give a table, or something as cheap to read."""
        held = F.col("held") if "held" in rows.columns else F.lit(False)
        whole = ~F.exists("seq", lambda v: v.isNull()) & (F.size("seq") == self.shape.days)
        rows = rows.select(F.col("signal").cast("int").alias("signal"), held.alias("held"), "seq").where(whole)
        levels = {r.signal: r.m for r in rows.where(~F.col("held")).select("signal", F.aggregate("seq", F.lit(0.0), lambda s, v: s + v).alias("s")).groupBy("signal").agg((F.avg("s") / self.shape.days).alias("m")).collect()}
        listed = sorted(levels)
        for low in range(0, len(listed), self.at_once):
            some = {s: levels[s] for s in listed[low : low + self.at_once]}
            self._fit_block(rows.where(F.col("signal").isin(list(some))) if len(listed) > self.at_once else rows, some)
        return self

    def _fit_block(self, rows: DataFrame, levels: dict[int, float]) -> None:
        models = {s: Model(self.shape.start([self.seed, s], level), self.shape.first_moments()) for s, level in levels.items()}
        courses = {s: Course(self.rate, self.floor, self.patience) for s in models}
        speed = {s: np.zeros(self.shape.size) for s in models}
        spread = {s: np.zeros(self.shape.size) for s in models}
        step = 0
        self.losses |= {s: [] for s in models}
        for epoch in range(self.epochs):
            seen = {s: np.zeros(4) for s in models}
            for batch in range(self.batches):
                going = {s: m for s, m in models.items() if not courses[s].done}
                if not going:
                    break
                part = rows if self.batches == 1 else rows.where(F.pmod(F.xxhash64("seq"), F.lit(self.batches)) == batch)
                step += 1
                for (signal,), total in self._step(part, going, step).items():
                    seen[signal] += total[:4]
                    gradient, moments = np.split(total[4:], [self.shape.size])
                    if not total[1]:
                        continue
                    gradient = gradient / total[1]
                    speed[signal] = 0.9 * speed[signal] + 0.1 * gradient
                    spread[signal] = 0.999 * spread[signal] + 0.001 * gradient**2
                    move = speed[signal] / (1 - 0.9**step) / (np.sqrt(spread[signal] / (1 - 0.999**step)) + 1e-7)
                    old = models[signal]
                    models[signal] = Model(old.flat - courses[signal].rate * move, 0.8 * old.moments + 0.2 * moments / total[1])
            for signal in going:
                loss, n, held_loss, held_n = seen[signal]
                judged = held_loss / held_n if held_n else loss / max(n, 1)
                self.losses[signal].append(judged)
                courses[signal].judge(judged, going[signal] if self.batches == 1 else models[signal])
            if all(c.done for c in courses.values()):
                break
        self.models |= {s: courses[s].model or models[s] for s in models}

    def _step(self, rows: DataFrame, models: dict[int, Model], step: int) -> dict[tuple, np.ndarray]:
        """By signal: train loss and rows, held-out loss and rows, gradient, moments; losses are those before the step."""
        shape, seed, held_models = self.shape, self.seed, rows.sparkSession.sparkContext.broadcast(models)

        def partial(frames) -> dict[tuple, np.ndarray]:
            from pyspark import TaskContext

            known, out, count = held_models.value, {}, 0
            for frame in frames:
                for (signal, held), part in frame.groupby(["signal", "held"]):
                    if signal not in known:
                        continue
                    model = known[signal]
                    flat = model.flat.astype(np.float32)
                    values = np.array(part["seq"].tolist(), np.float32)
                    total = out.setdefault((int(signal),), np.zeros(4 + shape.size + shape.moments))
                    for low in range(0, len(values), BATCH):
                        x = values[low : low + BATCH]
                        count += 1
                        rng = None if held else np.random.default_rng([seed, step, TaskContext.get().partitionId(), count])
                        got = bilstm.run(shape, flat, x, model.moments, rng)
                        if held:
                            total[2:4] += got.loss, len(x)
                        else:
                            total[:2] += got.loss, len(x)
                            total[4 : 4 + shape.size] += got.gradient
                            total[4 + shape.size :] += len(x) * got.moments
            return out

        try:
            return keyed_sums(rows, partial, {"signal": "int"})
        finally:
            held_models.destroy()

    def errors(self, rows: DataFrame) -> DataFrame:
        """(keys, mse, peak) of each sequence."""
        shape, models = self.shape, rows.sparkSession.sparkContext.broadcast(self.models)

        def run(frames):
            for frame in frames:
                mse, peak = np.full(len(frame), np.nan), np.full(len(frame), np.nan)
                keep = np.zeros(len(frame), bool)
                for signal, at in frame.groupby("signal").indices.items():
                    if signal not in models.value:
                        continue
                    keep[at] = True
                    model = models.value[signal]
                    x = np.array([[np.nan if v is None else v for v in s] for s in frame["seq"].iloc[at]], float)
                    off = np.abs(bilstm.run(shape, model.flat, x, model.moments).rebuilt - x)
                    mse[at], peak[at] = (off**2).mean(axis=1), off.max(axis=1)
                found = frame[KEYS].assign(mse=mse, peak=peak)[keep]
                yield found.astype(object).where(found.notna(), None)

        kinds = dict(rows.select(*KEYS, "seq").dtypes)
        return rows.select(*KEYS, "seq").where(F.size("seq") == shape.days).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in KEYS) + ", mse double, peak double")

    def score(self, rows: DataFrame) -> DataFrame:
        a, b = self.weights
        return self.errors(rows).select(*KEYS, (a * F.col("mse") + b * F.col("peak")).alias("score"))
