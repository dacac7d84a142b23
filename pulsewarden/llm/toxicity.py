"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(theta_k - score) for ordered thresholds theta_1 <= theta_2 <= ..., where the score,
a sum of weights of the features a text has, is shared by all thresholds. Features are the hashed words of
a text and the hashed first letters of its longer words, each counted once however often it stands. An L1
penalty keeps the weights of only those features that carry evidence, so very long texts do not gather
noise; weights are not negative, so that a text without evidence is mild whatever else it says. The output is the expected severity, the sum over k of P(grade > k).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsewarden.llm import shared, words

#: Bytes of a word's beginning that form a feature of their own.
STEMS = (5,)
#: Expected severity from which a text counts as toxic.
CUT = 0.75


class Model(NamedTuple):
    features: np.ndarray  # sorted hashes with a weight
    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, score: np.ndarray) -> np.ndarray:
        return (1 / (1 + np.exp(np.clip(self.thresholds[:, None] - score[None, :], -60, 60)))).sum(axis=0)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all words and word beginnings, with repeats."""
    split = words.split(data, offsets)
    sums = words.prefix_sums(words.LOWER[data])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(split.rows))
    hashes, rows = [split.hash], [row]
    for size in STEMS:
        long = split.end - split.start > size
        start = split.start[long]
        hashes.append(words.mix(words.piece(sums, start, start + size) + np.uint64(size)))
        rows.append(row[long])
    return np.concatenate(hashes), np.concatenate(rows)


def _featurise(batches):
    """(grade, distinct feature hashes) of each row."""
    for batch in batches:
        grade = batch.column(1)
        for low, high, data, offsets in shared.chunks(*shared.utf8(batch.column(0))):
            hashes, row = features(data, offsets)
            each = [np.unique(hashes[row == k]) for k in range(high - low)] if high - low < 8 else _distinct(hashes, row, high - low)
            yield pa.RecordBatch.from_arrays([grade.slice(low, high - low), pa.array([x.view(np.int64) for x in each], pa.list_(pa.int64()))], names=["grade", "features"])


def _distinct(hashes: np.ndarray, row: np.ndarray, n: int) -> list[np.ndarray]:
    order = np.argsort(row, kind="stable")
    at = np.searchsorted(row[order], np.arange(n + 1))
    hashes = hashes[order]
    return [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:])]


def sample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", bound: int = 4000) -> DataFrame:
    """At most `bound` labelled texts of each grade, those whose ids hash lowest: (text, grade).

    Rows without id, text or grade are left out; an id that repeats counts once, with its highest grade and least text.
    """
    known = labels.where(F.col(grade_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(grade_col).cast("int").alias("grade"))
    spread = F.xxhash64("id")
    parts = []
    grades = sorted(r[0] for r in known.select("grade").distinct().collect())
    for grade in grades:
        parts.append(known.where(F.col("grade") == grade).orderBy(spread, "id").limit(bound))
    if not parts:
        return docs.select(F.col(text_col).alias("text"), F.lit(0).alias("grade")).limit(0)
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").where(F.col("text").isNotNull()).groupBy("id", "grade").agg(F.min("text").alias("text")).select("text", "grade")


def fit(sampled: DataFrame, *, least_docs: int | None = None, penalty: float = 3e-4, rounds: int = 100, refine=None) -> Model:
    """Fit on a bounded sample of (text, grade >= 0); its size is the caller's documented parameter.

    Features of fewer than `least_docs` texts (by default 1 in 500, 4 at least) are left out.

    Accelerated proximal gradient on the mean log-likelihood. refine(grades, has) may turn the grades
    into others before the fit. With fewer than two grades the model gives everything severity 0.
    """
    shared.small_batches(sampled.sparkSession)
    got = sampled.mapInArrow(_featurise, "grade int, features array<long>").toArrow()
    grades = got.column("grade").to_numpy().astype(np.int64)
    lists = got.column("features").combine_chunks()
    flat, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
    if len(np.unique(grades)) < 2:
        return Model(np.empty(0, np.uint64), np.empty(0), np.full(1, 60.0))
    vocabulary, seen = np.unique(flat, return_counts=True)
    least_docs = least_docs or max(4, len(grades) // 500)
    vocabulary = vocabulary[seen >= least_docs]
    column = np.searchsorted(vocabulary, flat).astype(np.int32)
    column[column == len(vocabulary)] = 0
    often = vocabulary[column] == flat if len(vocabulary) else np.zeros(len(flat), bool)
    row = np.repeat(np.arange(len(grades), dtype=np.int32), np.diff(offsets))[often]
    column = column[often]
    del flat, lists, got, often
    if refine is not None:
        grades = refine(grades, row, column)
    top = int(grades.max())
    n, width = len(grades), len(vocabulary)
    weight = np.zeros(n)
    for g, c in zip(*np.unique(grades, return_counts=True)):
        weight[grades == g] = 1.0 / c
    weight /= weight.sum()
    share = np.array([(weight * (grades <= k)).sum() for k in range(top)])
    share = np.clip(share, 1e-6, 1 - 1e-6)
    theta = np.maximum.accumulate(np.log(share / (1 - share)))
    w = np.zeros(width)
    held_w, held_theta, momentum = w.copy(), theta.copy(), 1.0
    step = 4.0 / (1 + np.bincount(row, minlength=n).max() ** 0.5)
    above = grades[None, :] > np.arange(top)[:, None]
    here_up = np.clip(grades, 0, top - 1)
    here_down = np.clip(grades - 1, 0, top - 1)

    def slope(w, theta):
        score = np.bincount(row, w[column], n)
        p = 1 / (1 + np.exp(-np.clip(theta[:, None] - score[None, :], -60, 60)))
        upper = np.where(grades < top, p[here_up, np.arange(n)], 1.0)
        lower = np.where(grades > 0, p[here_down, np.arange(n)], 0.0)
        mass = np.maximum(upper - lower, 1e-12)
        d_up, d_low = upper * (1 - upper), lower * (1 - lower)
        d_theta = np.zeros(top)
        np.add.at(d_theta, here_up, np.where(grades < top, -weight * d_up / mass, 0.0))
        np.add.at(d_theta, here_down, np.where(grades > 0, weight * d_low / mass, 0.0))
        return -(weight * np.log(mass)).sum(), np.bincount(column, (weight * (d_up - d_low) / mass)[row], width), d_theta

    best = slope(w, theta)[0]
    for _ in range(rounds):
        loss, d_w, d_theta = slope(held_w, held_theta)
        while True:
            new_w = held_w - step * d_w
            new_w = np.maximum(new_w - step * penalty, 0)
            new_theta = np.maximum.accumulate(held_theta - step * d_theta)
            move_w, move_t = new_w - held_w, new_theta - held_theta
            if slope(new_w, new_theta)[0] <= loss + d_w @ move_w + d_theta @ move_t + (move_w @ move_w + move_t @ move_t) / (2 * step) + 1e-12 or step < 1e-9:
                break
            step /= 2
        following = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        held_w = new_w + (momentum - 1) / following * (new_w - w)
        held_theta = np.maximum.accumulate(new_theta + (momentum - 1) / following * (new_theta - theta))
        w, theta, momentum, step = new_w, new_theta, following, step * 1.2
    del above, best
    some = w != 0
    return Model(vocabulary[some], w[some], theta)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "severity") -> DataFrame:
    """The kept columns and the expected severity of each text; a null or empty text has only the thresholds' own."""
    shared.small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = list(dict.fromkeys([*keep, text_col]))

    def run(batches):
        model = held.value
        for batch in batches:
            got = []
            for low, high, data, offsets in shared.chunks(*shared.utf8(batch.column(names.index(text_col)))):
                total = np.zeros(high - low)
                if len(model.features):
                    hashes, row = features(data, offsets)
                    at = np.minimum(np.searchsorted(model.features, hashes), len(model.features) - 1)
                    known = model.features[at] == hashes
                    seen = np.unique(row[known] * len(model.features) + at[known])
                    total = np.bincount(seen // len(model.features), model.weights[seen % len(model.features)], high - low)
                got.append(model.severity(total))
            value = np.concatenate(got) if got else np.empty(0)
            columns = [batch.column(names.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(value)], names=[*keep, out])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", `{out}` double"
    return docs.select(*names).mapInArrow(run, schema)


def graded(labels: DataFrame) -> DataFrame:
    """Labels with a grade: the 0/1 `toxic` column."""
    return labels.select("doc_id", F.col("toxic").alias("grade"))


def by_evidence(grades: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Grades 0..3 from 0/1 labels: a toxic text's grade rises with the distinct marker features it has.

    A marker is a feature whose texts are toxic in at least 95 of 100 cases (grades weighted alike) and
    that at least four toxic texts have. Texts with up to 1, 2-4 or more markers get grade 1, 2, 3.
    """
    toxic = grades > 0
    in_toxic = np.bincount(column[toxic[row]], minlength=column.max() + 1) if len(column) else np.zeros(0)
    in_clean = np.bincount(column[~toxic[row]], minlength=column.max() + 1) if len(column) else np.zeros(0)
    rate_t, rate_c = in_toxic / max(1, toxic.sum()), in_clean / max(1, (~toxic).sum())
    marker = (in_toxic >= 4) & (rate_t >= 0.95 * (rate_t + rate_c))
    found = np.bincount(row, marker[column], len(grades)) if len(column) else np.zeros(len(grades))
    return np.where(toxic, 1 + (found >= 2) + (found >= 5), 0).astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, bound: int = 4000) -> Model:
    return fit(sample(docs, graded(labels), bound=bound), refine=by_evidence)


def keep_clean(docs: DataFrame, labels: DataFrame, *, most: float = CUT, bound: int = 4000) -> DataFrame:
    """docs whose expected severity is below `most`; columns are unchanged."""
    scored = score(docs, train(docs, labels, bound), keep=tuple(docs.columns), out="__severity")
    return scored.where(F.col("__severity") < most).select(*docs.columns)
