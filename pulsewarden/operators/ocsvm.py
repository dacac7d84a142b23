"""One-class support vector machines with an RBF kernel, for many signals and configurations in one plan.

The kernel is mapped to a few features by landmarks (Nystrom: kernel values to the landmarks times the inverse root of
the landmarks' own kernel matrix). Landmarks are no sample: rows are added, those first of which the features so far lose most, until
features give the kernel of any two rows within a tolerance. In that space the machine is a smooth convex problem of some hundred numbers a key,

    |w|^2 / 2 - rho + sum(hinge(rho - w . f)) / (nu * rows),

with the hinge rounded off over a width that shrinks. Newton steps solve it: a pass over the rows sums gradients and second
derivatives by key, a second one tries step lengths. Rows stay where they are, and all keys take their steps in the same
two jobs; only sums and the bounded state of a key travel.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsewarden.operators import tables
from pulsewarden.operators.forest import KEY, ROW, with_config
from pulsewarden.operators.keyed_sums import WIDE, keyed_sums

#: Rows of a key among which landmarks are chosen in a pass over all rows.
CANDIDATES = 1024
STEPS = np.array([1.0, 0.7, 0.5, 0.3, 0.15, 0.05, 0.01, 0.001])


class Map(NamedTuple):
    """Kernel features of a key."""

    landmarks: np.ndarray
    root: np.ndarray
    gamma: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return kernel(x, self.landmarks, self.gamma) @ self.root


class State(NamedTuple):
    """w and rho in one vector, the rounding of the hinge and the rows' weight."""

    v: np.ndarray
    width: float
    weight: float  # 1 / (nu * rows)


def kernel(x: np.ndarray, z: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * np.maximum((x**2).sum(axis=1)[:, None] + (z**2).sum(axis=1)[None, :] - 2 * x @ z.T, 0.0))


def nystrom(landmarks: np.ndarray, gamma: float) -> Map:
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks, gamma))
    some = values > 1e-9 * values[-1]
    return Map(landmarks, vectors[:, some] / np.sqrt(values[some]), gamma)


def pivots(x: np.ndarray, gamma: float, loss: float, known: Map | None = None, most: int | None = None) -> np.ndarray:
    """Rows of x to be landmarks beside the known ones: the row with the largest loss, again and again, until none exceeds `loss` or there are `most`.

    The loss of a row is its kernel value to itself less that of its features, 1 - f . f; of two rows, kernel and features differ by the larger loss at most.
    """
    f = known(x).T if known else np.empty((0, len(x)))
    first, f = len(f), np.concatenate([f, np.empty((len(x), len(x)))])
    left, chosen = 1.0 - (f[:first] ** 2).sum(axis=0), []
    while len(chosen) < len(x) and (most is None or len(chosen) < most):
        i, d = int(left.argmax()), first + len(chosen)
        if left[i] <= loss:
            break
        f[d] = (kernel(x, x[i : i + 1], gamma)[:, 0] - f[:d].T @ f[:d, i]) / np.sqrt(left[i])
        left = left - f[d] ** 2
        left[i] = 0.0
        chosen.append(i)
    return x[chosen]


def hinge(u: np.ndarray, width: float) -> np.ndarray:
    """max(u, 0), with a parabola of the given width between its two arms."""
    return np.where(u >= width, u - width / 2, np.maximum(u, 0.0) ** 2 / (2 * width)) if width else np.maximum(u, 0.0)


class OneClassSVM:
    """Machines of several configurations; config k of the rows has nu = nus[k], and rows of other configs are left out.

    All rows are fitted, and a key has as many landmarks as bring the kernel of any two of its rows within `loss`. Two options bound this: with `most` about so many rows
    of a key are fitted, those whose keys hash lowest; with `landmarks` a key has no more of these. gamma is
    one over the features' number times their variance. Scores are rho less w . f, higher where rows are outside. Rows of a
    key without a model have no score; an empty table gives no model.
    """

    def __init__(self, nus: list[float] | None = None, *, most: int | None = None, landmarks: int | None = None, loss: float = 0.01, rounds: int = 60, tolerance: float = 1e-4, seed: int = 42):
        self.name, self.nus, self.most, self.landmarks, self.loss = "ocsvm", nus or [0.05], most, landmarks, max(loss, 1e-4)
        self.rounds, self.tolerance, self.seed = rounds, tolerance, seed
        self.maps: dict[tuple, Map] = {}
        self.states: dict[tuple, State] = {}
        self.objective: dict[tuple, float] = {}

    def fit(self, train: DataFrame) -> "OneClassSVM":
        share = F.pmod(F.xxhash64(F.lit(self.seed), "sim", "t"), F.lit(1 << 40)) / float(1 << 40)
        rows = with_config(train).where(F.col("config").between(0, len(self.nus) - 1)).select(*KEY, share.alias("h"), "features")
        if self.most is not None:
            counts = rows.groupBy(*KEY).agg(F.count("*").alias("n"))
            rows = rows.join(F.broadcast(counts), KEY).where(F.col("h") < self.most / F.col("n"))
        spread = rows.select(*KEY, "h", "features").repartition(rows.sparkSession.sparkContext.defaultParallelism)  # rows are gone through many times
        kept = tables.committed(spread, "svm-rows")
        add = lambda of: F.aggregate("features", F.lit(0.0), lambda s, v: s + of(v))
        sized = kept.groupBy(*KEY).agg(F.count("*").alias("n"), F.max(F.size("features")).alias("d"), F.sum(add(lambda v: v)).alias("s"), F.sum(add(lambda v: v * v)).alias("q")).collect()
        if not sized:
            return self
        sizes = {(r.signal, r.config): r.n for r in sized}
        gammas = {(r.signal, r.config): 1.0 / max(r.d * (r.q / (r.n * r.d) - (r.s / (r.n * r.d)) ** 2), 1e-12) for r in sized}
        self._cover(kept, gammas)
        self._solve(kept.select(*KEY, "features"), sizes)
        return self

    def _cover(self, rows: DataFrame, gammas: dict[tuple, float]) -> None:
        """Maps of all keys. Each pass over the rows takes those with the largest losses, in equal cases those that hash lowest, and the landmarks among these."""
        going = dict(gammas)
        while going:
            held = rows.sparkSession.sparkContext.broadcast((self.maps, going, self.loss))

            def lost(frames, held=held):
                maps, known, loss = held.value
                for frame in frames:
                    for key, part in frame.groupby(KEY):
                        key = (int(key[0]), int(key[1]))
                        if key in known:
                            left = 1.0 - (maps[key](np.array(part["features"].tolist(), float)) ** 2).sum(axis=1) if key in maps else np.ones(len(part))
                            yield part.assign(left=left.round(6))[left > loss]

            order = Window.partitionBy(*KEY).orderBy(F.desc("left"), "h", "features")
            worst = rows.mapInPandas(lost, "signal int, config int, h double, features array<double>, left double").withColumn("place", F.row_number().over(order)).where(F.col("place") <= CANDIDATES)
            found = worst.toPandas().sort_values("place")
            held.destroy()
            more = {}
            for key, part in found.groupby(KEY):
                key = (int(key[0]), int(key[1]))
                known = self.maps.get(key)
                room = None if self.landmarks is None else self.landmarks - (len(known.landmarks) if known else 0)
                new = pivots(np.array(part["features"].tolist(), float), gammas[key], self.loss, known, room)
                if len(new):
                    more[key] = gammas[key]
                    self.maps[key] = nystrom(np.concatenate([known.landmarks, new]) if known else new, gammas[key])
            going = more

    def _solve(self, rows: DataFrame, sizes: dict[tuple, int]) -> None:
        means = self._sums(rows, {k: None for k in sizes}, lambda f, _: np.append(f.sum(axis=0), len(f)))
        for key, total in means.items():
            w = total[:-1] / total[-1]
            rho = float(w @ w)
            self.states[key] = State(np.append(w, rho), 0.5 * abs(rho), 1.0 / (self.nus[key[1]] * sizes[key]))
        going = dict(self.states)
        for _ in range(self.rounds):
            sums = self._sums(rows, going, _slopes)
            moves = {}
            for key, total in sums.items():
                state, d = going[key], len(going[key].v)
                ridge = np.append(np.ones(d - 1), 1e-6)
                slope = state.weight * total[1 : 1 + d] + state.v * np.append(np.ones(d - 1), 0.0)
                slope[-1] -= 1.0
                bend = np.zeros((d, d))
                bend[np.triu_indices(d)] = total[1 + d :]
                bend = bend + np.triu(bend, 1).T
                moves[key] = -np.linalg.solve(state.weight * bend + np.diag(ridge), slope)
            tried = self._sums(rows, {k: (going[k], m) for k, m in moves.items()}, _tried)
            for key, losses in tried.items():
                state, move = going[key], moves[key]
                values = state.weight * losses + np.array([_rest(state.v + s * move) for s in np.append(0.0, STEPS)])
                best = int(values.argmin())
                if best:
                    state = state._replace(v=state.v + STEPS[best - 1] * move)
                gain = values[0] - values[best]
                last = state.width <= 0.004 * abs(state.v[-1])
                if gain <= self.tolerance * abs(values[best]):
                    if last:
                        del going[key]
                        self.states[key] = state
                        continue
                    state = state._replace(width=state.width / 4)
                going[key] = self.states[key] = state
            if not going:
                break
        final = self._sums(rows, {k: (s._replace(width=0.0), 0 * s.v) for k, s in self.states.items()}, _tried)
        self.objective = {k: float(self.states[k].weight * x[0] + _rest(self.states[k].v)) for k, x in final.items()}

    def _sums(self, rows: DataFrame, states: dict[tuple, object], of) -> dict[tuple, np.ndarray]:
        held = rows.sparkSession.sparkContext.broadcast((self.maps, states))

        def partial(frames) -> dict[tuple, np.ndarray]:
            maps, known = held.value
            out: dict[tuple, np.ndarray] = {}
            for frame in frames:
                for key, part in frame.groupby(KEY):
                    key = (int(key[0]), int(key[1]))
                    if key in known:
                        out[key] = out.get(key, 0.0) + of(maps[key](np.array(part["features"].tolist(), float)), known[key])
            return out

        try:
            # second derivatives are large, so tasks add those of up to WIDE partitions before the driver does
            most = max(1, rows.rdd.getNumPartitions() // WIDE) if of is _slopes else WIDE
            return keyed_sums(rows, partial, {"signal": "int", "config": "int"}, most)
        finally:
            held.destroy()

    def score(self, rows: DataFrame) -> DataFrame:
        """(signal, config, sim, t, score), by a matrix product a batch; models are some landmarks a key."""
        held = rows.sparkSession.sparkContext.broadcast((self.maps, {k: s.v for k, s in self.states.items()}))

        def run(frames):
            maps, vectors = held.value
            for frame in frames:
                for key, part in frame.groupby(KEY):
                    key = (int(key[0]), int(key[1]))
                    if key in vectors:
                        v = vectors[key]
                        yield part[ROW].assign(score=v[-1] - maps[key](np.array(part["features"].tolist(), float)) @ v[:-1])

        return with_config(rows).mapInPandas(run, "signal int, config int, sim string, t int, score double")


def _rest(v: np.ndarray) -> float:
    return float(v[:-1] @ v[:-1] / 2 - v[-1])


def _sides(f: np.ndarray) -> np.ndarray:
    """Rows a with a . v = rho - w . f."""
    return np.append(-f, np.ones((len(f), 1)), axis=1)


def _slopes(f: np.ndarray, state: State) -> np.ndarray:
    """Loss, its gradient and the upper triangle of its second derivatives, summed over rows."""
    a = _sides(f)
    u = a @ state.v
    inner = (u > 0) & (u < state.width)
    slope = np.clip(u / state.width, 0.0, 1.0)
    return np.concatenate([[hinge(u, state.width).sum()], slope @ a, (a[inner].T @ a[inner] / state.width)[np.triu_indices(a.shape[1])]])


def _tried(f: np.ndarray, given: tuple[State, np.ndarray]) -> np.ndarray:
    """Summed losses where the state is and after each step length."""
    state, move = given
    a = _sides(f)
    u, du = a @ state.v, a @ move
    return np.array([hinge(u + s * du, state.width).sum() for s in np.append(0.0, STEPS)])
