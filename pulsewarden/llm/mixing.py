"""Mixing sources to target weights by soft domain membership.

1. A multinomial classifier, trained on labelled documents, gives each document's posterior p_k for every
   domain k. Its margins are calibrated on labelled documents it was not trained on, weighted by their tokens,
   so that expected domain token totals of unseen documents are those that labels would give.
2. Rates r_d >= floor are fitted so that the expected domain token totals sum_d r_d n_d p_dk meet the targets
   T_k, and of all such rates those that are closest to 1: sum_d n_d (r_d - 1)^2 is least. They have the form
   r_d = max(floor, 1 + sum_k l_k p_dk) with one number l_k a domain, found by accelerated projected gradient steps on
   the missing totals. Where no rates meet the targets, the nearest that were seen are taken and the distance left is reported.

The driver holds the K numbers l_k and one K x K matrix of second moments and nothing else; a
document's rate follows from the l_k, so no rates are stored between rounds and a lost executor costs only
its tasks. All steps over documents are DataFrame functions and Spark ML.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsewarden.llm import shared


def tokens(text: Column) -> Column:
    """Lower-cased words between white space; none for null and blank texts."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


class Domains:
    """Domain classifier on hashed words (each counted once a document)."""

    def __init__(self, *, bound: int = 3000, features: int = 1 << 13, regularise: float = 0.01, rounds: int = 12):
        self.bound, self.rounds, self.regularise = bound, rounds, regularise
        self.hashing = HashingTF(inputCol="__words", outputCol="__features", numFeatures=features, binary=True)
        self.names: list[str] = []
        self.model = self.calibrated = None

    def fit(self, docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> "Domains":
        """Fit on at most `bound` labelled documents of each domain, those whose ids hash lowest.

        labels has id_col and `domain`; rows with nulls are left out, an id that repeats takes its smallest
        domain. The classes are weighed so that posteriors follow the labelled shares. Of each domain's
        documents every third calibrates and the others train; where a domain has but one document, margins
        stay as they are. One domain or none needs no model: every posterior is then 1, or the list of
        domains is empty.
        """
        known = labels.where(F.col("domain").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min("domain").alias("domain"))
        known = known.join(docs.select(F.col(id_col).alias("__id")), "__id", "left_semi").persist()
        counts = {r[0]: r[1] for r in known.groupBy("domain").count().orderBy("domain").collect()}
        self.names = list(counts)
        if len(counts) < 2:
            known.unpersist()
            return self
        chosen = None
        for k, name in enumerate(self.names):
            part = known.where(F.col("domain") == name).orderBy(F.xxhash64("__id"), "__id").limit(self.bound)
            part = part.select("__id", F.lit(float(k)).alias("__label"), F.lit(counts[name] / min(counts[name], self.bound)).alias("__weight"))
            chosen = part if chosen is None else chosen.unionByName(part)
        place = F.row_number().over(Window.partitionBy("__label").orderBy(F.xxhash64("__id"), "__id"))
        chosen = chosen.withColumn("__held", place % 3 == 0)
        texts = docs.select(F.col(id_col).alias("__id"), tokens(F.col(text_col)).alias("__words")).join(F.broadcast(chosen), "__id")
        ready = self.hashing.transform(texts).select("__features", "__label", "__weight", "__held", F.size("__words").alias("__size")).persist()
        learner = LogisticRegression(labelCol="__label", weightCol="__weight", family="multinomial", aggregationDepth=2)
        self.model = learner.copy({learner.featuresCol: "__features", learner.maxIter: self.rounds, learner.regParam: self.regularise}).fit(ready.where(~F.col("__held")))
        self.model.setRawPredictionCol("__margins").setProbabilityCol("__p0").setPredictionCol("__top0")
        held = self.model.transform(ready.where("__held")).select("__margins", "__label", (F.col("__weight") * F.greatest(F.col("__size"), F.lit(1))).alias("__weight")).persist()
        if held.select("__label").distinct().count() == len(counts):
            self.calibrated = learner.copy({learner.featuresCol: "__margins", learner.maxIter: 50, learner.regParam: 1e-3}).fit(held)
        held.unpersist()
        ready.unpersist()
        known.unpersist()
        return self

    def members(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, n_tokens, posterior array in the order of names) of each row."""
        rows = docs.select(F.col(id_col), tokens(F.col(text_col)).alias("__words"))
        size = F.size("__words").cast("long").alias("n_tokens")
        if self.model is None:
            share = F.array(*[F.lit(1.0 / len(self.names))] * len(self.names)) if self.names else F.array().cast("array<double>")
            return rows.select(id_col, size, share.alias("posterior"))
        scored = self.model.transform(self.hashing.transform(rows)).withColumnRenamed("__p0", "__p")
        if self.calibrated is not None:
            scored = self.calibrated.setProbabilityCol("__p").setPredictionCol("__top").setRawPredictionCol("__raw").transform(scored.drop("__p"))
        return scored.select(id_col, size, self._posterior(vector_to_array("__p")).alias("posterior"))

    def _posterior(self, p: Column) -> Column:
        return F.slice(p, 1, len(self.names))


@dataclass
class Fit:
    """What a fit of rates reached: expected totals, their distances from the targets, whether all are within tolerance."""

    totals: list[float]
    residuals: list[float]
    met: bool
    rounds: int


def _dot(numbers, values: Column) -> Column:
    return sum((F.lit(float(x)) * values[k] for k, x in enumerate(numbers)), F.lit(0.0))


def fit_rates(members: DataFrame, targets: list[float], *, values: Column | None = None, floor: float = 0.0, tolerance: float = 1e-3, rounds: int = 200, patience: int = 30, penalty: float = 1e-9) -> tuple[DataFrame, Fit]:
    """(members with `rate`, the Fit): the rates closest to 1, `floor` at least, whose expected totals meet the targets.

    Least squares by accelerated projected gradient: a step projects every document's rate on those of `floor` or above, sums
    what the rates give each domain over all documents, and moves the rates along the documents' values by the missing
    totals, scaled by the domains' K x K second moments (with these a step of one is the longest safe one, and one step is
    enough where no rate is held at the floor). The state is K numbers. Momentum starts anew where it points uphill; the search
    ends within tolerance, after `rounds`, or after `patience` rounds that brought nothing, with the nearest rates seen. Rates and totals are those of one pass.

    values (by default the posteriors) are what a token of a document adds to each total. A total is met within
    tolerance of its target, or, if that is 0, of all tokens. A total that no document adds to cannot be met and is passed over. Where the
    targets cannot be met, rates come as near as the penalty lets them, Fit.met is false and Fit.residuals says what
    is missing. Documents without tokens change no total; they get a rate by their values as any other.
    """
    k = len(targets)
    if not k:
        return members.withColumn("rate", F.lit(1.0)), Fit([], [], True, 0)
    values = F.col("posterior") if values is None else values
    total = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    n, each = F.col("n_tokens"), [values[i] for i in range(k)]
    first = members.agg(total(n.cast("double")), *[total(n * F.abs(v)) for v in each]).head()
    tokens_in, known = max(float(first[0]), 1e-9), np.array([x > 1e-6 for x in first[1:]])
    goal = np.array(targets, float) * known

    def look(numbers, *more):
        """Totals of the projected rates at these numbers, and other sums of the same pass."""
        rate = F.greatest(F.lit(float(floor)), _dot(numbers, values) + 1.0)
        row = members.agg(*[total(n * rate * v) for v in each], *[total(m) for m in more]).head()
        return np.array(row[:k]) * known, row[k:]

    near = tolerance * np.where(goal == 0, tokens_in, np.maximum(np.abs(goal), 1.0))
    at = numbers = np.zeros(k)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    totals, row = look(at, *[n * each[i] * each[j] for i, j in pairs])
    bend = np.zeros((k, k))
    for (i, j), x in zip(pairs, row):
        bend[i, j] = bend[j, i] = x
    held = penalty * tokens_in
    scale = np.linalg.inv(bend * np.outer(known, known) + np.diag(np.where(known, held, 1.0))) * np.outer(known, known)
    off = lambda t: float(np.abs(t - goal).sum())
    done, pace, since, best = 0, 1.0, 0, (off(totals), at, totals)
    while done < rounds and (np.abs(totals - goal) > near).any():
        slope = goal - totals - held * at
        new = at + scale @ slope
        if float(slope @ (new - numbers)) < 0:
            pace = 1.0
        faster = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        at, numbers, pace = new + (pace - 1) / faster * (new - numbers), new, faster
        totals, _ = look(at)
        done += 1
        since = 0 if off(totals) < 0.99 * best[0] else since + 1
        best = min(best, (off(totals), at, totals), key=lambda x: x[0])
        if since >= patience:
            break
    if (np.abs(totals - goal) > near).any():
        _, at, totals = best
    left = totals - goal
    fit = Fit(totals.tolist(), left.tolist(), bool((np.abs(left) <= near).all()), done)
    return members.withColumn("rate", F.greatest(F.lit(float(floor)), _dot(at, values) + 1.0)), fit


def quality_domains(labels: DataFrame) -> DataFrame:
    """Domains of the labels table: toxic, else poor (quality 0), else plain."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "plain").alias("domain"))


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], *, id_col: str = "doc_id", text_col: str = "text", tokens_out: float | None = None) -> DataFrame:
    """(id, n_tokens, posterior, rate) of each document for target shares of tokens.

    tokens_out is the expected number of tokens of the mixture; by default as many as the input has.
    Weights of domains without labelled documents are spread over the others.
    """
    domains = Domains().fit(docs, labels, id_col=id_col, text_col=text_col)
    members = shared.cut(domains.members(docs, id_col=id_col, text_col=text_col), "members")
    given = [max(0.0, weights.get(name, 0.0)) for name in domains.names]
    total = tokens_out if tokens_out is not None else float(members.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).head()[0])
    targets = [total * w / (sum(given) or 1.0) for w in given]
    rated, fit = fit_rates(members, targets)
    if not fit.met:
        warnings.warn(f"mixing: no rates of 0 or above meet the token targets; off by domain: {dict(zip(domains.names, fit.residuals))} of {dict(zip(domains.names, targets))}", stacklevel=2)
    return rated


def fit_shares(members: DataFrame, given: list[float], *, tolerance: float = 1e-3) -> tuple[DataFrame, list[float], bool]:
    """(members with `rate` of 0 or above, shares reached, whether they are met) for shares of the tokens of weighted domains.

    The weighted domains together keep the tokens they are expected to have, dealt out by their weights; domains without
    a weight have no target. Rates that cannot meet the targets would grow without bound; a firmer penalty then holds them.
    """
    w = [x / sum(given) for x in given]
    p = F.col("posterior")
    values = F.array(*[p[k] if x > 0 else F.lit(0.0) for k, x in enumerate(w)])
    weighted = sum((p[k] for k, x in enumerate(w) if x > 0), F.lit(0.0))
    total = members.agg(F.coalesce(F.sum(F.col("n_tokens") * weighted), F.lit(0.0))).head()[0]
    targets = [x * total for x in w]
    rated, fit = fit_rates(members, targets, values=values, tolerance=tolerance)
    if not fit.met:
        rated, _ = fit_rates(members, targets, values=values, tolerance=tolerance, penalty=0.01)
    row = rated.agg(*[F.coalesce(F.sum(F.when(F.lit(x > 0), F.col("rate") * F.col("n_tokens") * p[k])), F.lit(0.0)) for k, x in enumerate(w)]).head()
    return rated, [x / (sum(row) or 1.0) for x in row], fit.met


def resample(docs: DataFrame, labels: DataFrame, weights: dict[str, float], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each row floor(rate + u) times, u in [0, 1) from the id: the mixture as rows, columns unchanged.

    Targets are the expected tokens of the domains that have a weight, dealt out by the weights, so the mixture
    stays as large as the input at every size; of all nonnegative rates that meet them those closest to 1 are taken. Domains without a weight have no
    target. If no rates meet the targets, the nearest ones by bounded rates are used. The expected shares reached are
    printed, with a warning if they are off. Rows of one id, repeated or not, are repeated alike. Rows without an id, and all rows if no document has a
    label, stay once.
    """
    domains = Domains().fit(docs, labels, id_col=id_col, text_col=text_col)
    members = shared.cut(domains.members(docs, id_col=id_col, text_col=text_col), "members")
    given = [max(0.0, weights.get(name, 0.0)) for name in domains.names]
    if not sum(given):
        return docs
    rated, shares, met = fit_shares(members, given)
    said = f"mixing: expected shares {({x: round(s, 4) for x, s, w in zip(domains.names, shares, given) if w})} for weights {weights}"
    print(said, flush=True)
    if not met:
        warnings.warn(f"{said}: no nonnegative rates meet them", stacklevel=2)
    u = F.pmod(F.xxhash64(F.lit("mix"), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    decided = rated.groupBy(id_col).agg(F.max(F.floor(F.col("rate") + u).cast("int")).alias("__copies"))
    joined = docs.join(decided, id_col, "left").withColumn("__copies", F.coalesce("__copies", F.lit(1)))
    return joined.where("__copies > 0").withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies")))).select(*docs.columns)
