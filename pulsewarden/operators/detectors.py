"""Model detectors with one contract: fit(train rows) then score(rows) -> higher = more anomalous.

Rows are (signal, config, sim, t, features array), sequences (signal, sim, t, seq array). Models are keyed by signal and
config; rows without a config have config 0. forest and ocsvm hold the others.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsewarden.operators.forest import IsolationForest
from pulsewarden.operators.ocsvm import OneClassSVM
from pulsewarden.operators.recurrent import SequenceAutoencoder

KEYS = ["signal", "sim", "t"]


class Detector(Protocol):
    name: str

    def fit(self, train: DataFrame) -> "Detector": ...

    def score(self, rows: DataFrame) -> DataFrame: ...


class SequenceReconstructor:
    """Linear autoencoder of 14-day sequences: projection on `k` principal components, one model for all signals.

    The linear counterpart of SequenceAutoencoder, of the same bottleneck. Scores mix mean squared and
    largest absolute reconstruction error. The input is (signal, sim, t, seq) and is not scaled.
    """

    def __init__(self, k: int = 4, weights: tuple[float, float] = (0.8, 0.2)):
        self.name, self.k, self.weights = "seqrecon", k, weights
        self.components: list[list[float]] = []

    def fit(self, train: DataFrame) -> "SequenceReconstructor":
        means = train.select(F.size("seq").alias("n"), F.posexplode("seq").alias("p", "v")).groupBy("p").agg(F.avg("v").alias("m")).orderBy("p").collect()
        self.mean = [r.m for r in means]
        vectors = train.select(array_to_vector(F.col("seq")).alias("v"))
        self.components = PCA(k=min(self.k, len(self.mean)), inputCol="v", outputCol="p").fit(vectors).pc.toArray().T.tolist()
        return self

    def errors(self, rows: DataFrame) -> DataFrame:
        """(keys, mse, peak) of each sequence, by array functions."""
        mean = F.array(*[F.lit(float(m)) for m in self.mean])
        centred = F.zip_with("seq", mean, lambda a, m: a - m)
        rebuilt = F.array_repeat(F.lit(0.0), len(self.mean))
        for component in self.components:
            axis = F.array(*[F.lit(float(c)) for c in component])
            part = F.aggregate(F.zip_with("c", axis, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
            rebuilt = F.zip_with(rebuilt, F.transform(axis, lambda v, part=part: v * part), lambda a, b: a + b)
        off = F.zip_with("c", "rebuilt", lambda a, b: F.abs(a - b))
        done = rows.withColumn("c", centred).withColumn("rebuilt", rebuilt).withColumn("off", off)
        mse = F.aggregate("off", F.lit(0.0), lambda s, v: s + v * v) / F.size("off")
        return done.select(*KEYS, mse.alias("mse"), F.array_max("off").alias("peak"))

    def score(self, rows: DataFrame) -> DataFrame:
        a, b = self.weights
        return self.errors(rows).select(*KEYS, (a * F.col("mse") + b * F.col("peak")).alias("score"))


#: Detectors by name; an unknown name is a KeyError.
REGISTRY = {"iforest": IsolationForest, "ocsvm": OneClassSVM, "seqauto": SequenceAutoencoder, "seqrecon": SequenceReconstructor}
