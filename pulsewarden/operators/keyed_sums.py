"""Sums of vectors by key over all partitions, for models whose state is a few vectors a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Partials of more partitions than this are summed in tasks before the driver adds them up.
WIDE = 64


def keyed_sums(rows: DataFrame, partial: Callable[[Iterator[pd.DataFrame]], dict[tuple, np.ndarray]], keys: dict[str, str], most: int = WIDE) -> dict[tuple, np.ndarray]:
    """Sum by key of what `partial` makes of each partition: {key: vector of doubles}.

    keys names the key columns and their types. The driver gets as many vectors a key as there are partitions, or `most`
    where there are more; a key's vectors all have one length.
    """
    names = list(keys)
    kind = ", ".join(f"{n} {t}" for n, t in keys.items()) + ", part int, v binary"

    def run(frames):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % most
        for key, vector in partial(frames).items():
            yield pd.DataFrame([[*key, part, vector.astype(float).tobytes()]], columns=[*names, "part", "v"])

    found = rows.mapInPandas(run, kind)
    if rows.rdd.getNumPartitions() > most:
        found = found.groupBy(*names, "part").applyInPandas(_added(names), kind)
    out: dict[tuple, np.ndarray] = {}
    for row in found.collect():
        key, vector = tuple(row[n] for n in names), np.frombuffer(bytes(row.v))
        out[key] = out[key] + vector if key in out else vector
    return out


def _added(names: list[str]):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v) for v in part["v"])
        return part[[*names, "part"]].head(1).assign(v=[total.tobytes()])

    return run
