"""Isolation forests on most of a signal's rows, for many signals and configurations in one plan.

Rows are (signal, config, sim, t, features); a model is keyed by signal and config. A key with at most `bound` rows is grown in
tasks of `block` trees, each of which gets the key's rows once. A larger key is grown level by level where its rows
lie: each partition gives the bounds of its rows in every node (one aggregation a level over signal, config, tree, node), the
splits are chosen from these, and only nodes that have come down to `bound` rows are finished as groups of their own.
So no group holds a tree's rows, and both ways give the same trees, as all choices are hashes of tree and node.

Trees are a table that is written once: (signal, config, tree, and packed arrays); each scored row meets them in one shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsewarden.functions import trees
from pulsewarden.operators import tables

KEY = ["signal", "config"]
ROW = ["signal", "config", "sim", "t"]
TREE = "signal int, config int, tree int, feature binary, cut binary, left binary, depth binary"
NODES = "signal int, config int, tree int, node long, feature int, cut double, n long"


class Config(NamedTuple):
    trees: int = 200
    row_share: float = 0.9
    feature_share: float = 0.8


def with_config(rows: DataFrame) -> DataFrame:
    """rows with column config, 0 where they have none, and the types that models use."""
    config = F.col("config") if "config" in rows.columns else F.lit(0)
    return rows.select(F.col("signal").cast("int").alias("signal"), config.cast("int").alias("config"), F.col("sim").cast("string").alias("sim"), F.col("t").cast("int").alias("t"), "features")


class IsolationForest:
    """Forests of several configurations; config k of the rows is configs[k], and rows of other configs are left out.

    Scores are 2^(-mean path / expected path), higher where rows are easier to isolate. Rows of a key without a model have no
    score; an empty table gives no model.
    """

    def __init__(self, configs: list[Config] | None = None, *, seed: int = 42, block: int = 25, bound: int = 200_000, chunk: int = 20_000):
        self.name, self.configs, self.seed = "iforest", configs or [Config()], seed
        self.block, self.bound, self.chunk = block, bound, chunk
        self.plans: dict[tuple[int, int], trees.Plan] = {}
        self.model: DataFrame | None = None

    def fit(self, train: DataFrame, path: str | None = None) -> "IsolationForest":
        train = with_config(train).where(F.col("config").between(0, len(self.configs) - 1))
        sizes = train.groupBy(*KEY).agg(F.count("*").alias("n"), F.max(F.size("features")).alias("d")).collect()
        for r in sizes:
            c = self.configs[r.config]
            self.plans[r.signal, r.config] = trees.Plan(self.seed + 1000 * r.signal, c.trees, c.row_share, r.d, c.feature_share, r.n)
        hashed = train.select(*KEY, F.xxhash64("sim", "t").alias("h"), "features")
        large = {k: p for k, p in self.plans.items() if p.rows > self.bound}
        parts = []
        if len(large) < len(self.plans):
            parts.append(self._small(_of(hashed, [k for k in self.plans if k not in large])))
        if large:
            parts.append(self._large(_of(hashed, list(large)), large))
        grown = parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else train.sparkSession.createDataFrame([], TREE)
        self.model = tables.committed(grown, "forest", path)
        return self

    def _small(self, rows: DataFrame) -> DataFrame:
        plans, block = self.plans, self.block
        blocks = F.element_at(F.array(*[F.lit(-(-c.trees // block)) for c in self.configs]), F.col("config") + 1)
        dealt = rows.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))

        def run(part: pd.DataFrame) -> pd.DataFrame:
            signal, config, number = (int(part[c].iloc[0]) for c in (*KEY, "block"))
            plan = plans[signal, config]
            values, hashes = np.array(part["features"].tolist(), float), part["h"].to_numpy()
            of = range(number * block, min((number + 1) * block, plan.trees))
            return pd.DataFrame([[signal, config, tree, *_bytes(trees.packed(*trees.grow(plan, tree, values[plan.member(hashes, tree)])))] for tree in of], columns=_COLUMNS)

        return dealt.groupBy(*KEY, "block").applyInPandas(run, TREE)

    def _large(self, rows: DataFrame, plans: dict[tuple[int, int], trees.Plan]) -> DataFrame:
        """Tops by sums over partitions until all nodes have at most `bound` rows, then the subtrees of these."""
        spark = rows.sparkSession
        width = max(p.features for p in plans.values())
        tops: dict[tuple[int, int, int], dict[int, tuple[int, float]]] = {(*k, tree): {} for k, p in plans.items() for tree in range(p.trees)}
        open_nodes = {k: {1} for k in tops}
        written = []
        while open_nodes:
            held = spark.sparkContext.broadcast((tops, open_nodes))
            arrays = "signal int, config int, tree int, node long, n long, low array<double>, high array<double>"
            stats = rows.mapInPandas(_bounds(plans, held), arrays)
            edges = [f(F.col(c)[k]).alias(f"{c}{k}") for c, f in (("low", F.min), ("high", F.max)) for k in range(width)]
            summed = stats.groupBy("signal", "config", "tree", "node").agg(F.sum("n").alias("n"), *edges)
            level = tables.committed(summed.mapInPandas(_choices(plans, width), NODES), "forest-level")
            written.append(level.where(F.col("n") > self.bound))
            again: dict[tuple[int, int, int], set[int]] = {}
            for r in level.where(F.col("n") > self.bound).collect():
                tops[r.signal, r.config, r.tree][r.node] = (r.feature, r.cut)
                if r.feature >= 0:
                    again.setdefault((r.signal, r.config, r.tree), set()).update((2 * r.node, 2 * r.node + 1))
            open_nodes = again
        held = spark.sparkContext.broadcast(tops)
        routed = rows.mapInPandas(_routed(plans, held), "signal int, config int, tree int, node long, features array<double>")

        def finish(part: pd.DataFrame) -> pd.DataFrame:
            signal, config, tree, root = (int(part[c].iloc[0]) for c in (*KEY, "tree", "node"))
            node, feature, cut, n = trees.grow(plans[signal, config], tree, np.array(part["features"].tolist(), float), root)
            return pd.DataFrame({"signal": signal, "config": config, "tree": tree, "node": node, "feature": feature, "cut": cut, "n": n})

        nodes = routed.groupBy(*KEY, "tree", "node").applyInPandas(finish, NODES)
        for level in written:
            nodes = nodes.unionByName(level)

        def pack(part: pd.DataFrame) -> pd.DataFrame:
            tree = trees.packed(*(part[c].to_numpy() for c in ("node", "feature", "cut", "n")))
            return pd.DataFrame([[*(int(part[c].iloc[0]) for c in (*KEY, "tree")), *_bytes(tree)]], columns=_COLUMNS)

        return nodes.groupBy(*KEY, "tree").applyInPandas(pack, TREE)

    def score(self, rows: DataFrame) -> DataFrame:
        """(signal, config, sim, t, score); the trees of a key are copied once for each `chunk` of its rows."""
        plans = self.plans
        rows = with_config(rows)
        counts = {(r.signal, r.config): -(-r.n // self.chunk) for r in rows.groupBy(*KEY).agg(F.count("*").alias("n")).collect()}
        if not counts:
            return rows.select(*ROW, F.lit(0.0).alias("score"))
        listed = rows.sparkSession.createDataFrame([(*k, n) for k, n in counts.items()], "signal int, config int, chunks int")
        dealt = rows.join(F.broadcast(listed), KEY).withColumn("chunk", F.pmod(F.xxhash64("sim", "t"), F.col("chunks")).cast("int")).drop("chunks")
        copied = self.model.join(F.broadcast(listed), KEY).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

        def run(key, part: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
            if part.empty or model.empty:
                return part[ROW].head(0).assign(score=pd.Series(dtype=float))
            values, total = np.array(part["features"].tolist(), float), np.zeros(len(part))
            for tree in model.sort_values("tree").itertuples():
                total += _tree(tree).paths(values)
            sample = plans[int(key[0]), int(key[1])].sample
            return part[ROW].assign(score=2.0 ** (-(total / len(model)) / max(float(trees.expected(sample)), 1e-9)))

        on = [*KEY, "chunk"]
        return dealt.groupBy(*on).cogroup(copied.groupBy(*on)).applyInPandas(run, "signal int, config int, sim string, t int, score double")


_COLUMNS = ["signal", "config", "tree", "feature", "cut", "left", "depth"]


def _bytes(tree: trees.Tree) -> list[bytes]:
    return [x.tobytes() for x in tree]


def _tree(row) -> trees.Tree:
    return trees.Tree(*(np.frombuffer(getattr(row, c), kind) for c, kind in (("feature", np.int16), ("cut", float), ("left", np.int32), ("depth", np.float32))))


def _of(rows: DataFrame, keys: list[tuple[int, int]]) -> DataFrame:
    listed = rows.sparkSession.createDataFrame(keys, "signal int, config int")
    return rows.join(F.broadcast(listed), KEY)


def _down(top: dict[int, tuple[int, float]], values: np.ndarray) -> np.ndarray:
    """The first node below the top that each row reaches."""
    node = np.ones(len(values), np.int64)
    waiting = np.arange(len(values)) if 1 in top else np.empty(0, np.int64)
    while len(waiting):
        left = []
        for at in np.unique(node[waiting]).tolist():
            feature, cut = top[at]
            if feature < 0:
                continue
            rows = waiting[node[waiting] == at]
            node[rows] = 2 * at + (values[rows, feature] >= cut)
            left.append(rows)
        waiting = np.concatenate(left) if left else np.empty(0, np.int64)
        waiting = waiting[np.isin(node[waiting], list(top))]
    return node


def _keyed(frames):
    """(signal, config, hashes, values) of each key of each frame."""
    for frame in frames:
        for (signal, config), part in frame.groupby(KEY):
            yield int(signal), int(config), part["h"].to_numpy(), np.array(part["features"].tolist(), float)


def _bounds(plans, held):
    """Bounds and counts of this partition's rows in the open nodes."""

    def run(frames):
        tops, open_nodes = held.value
        found: dict[tuple[int, int, int, int], list] = {}
        for signal, config, hashes, values in _keyed(frames):
            plan = plans[signal, config]
            for tree in range(plan.trees):
                wanted = open_nodes.get((signal, config, tree))
                if not wanted:
                    continue
                x = values[plan.member(hashes, tree)]
                node = _down(tops[signal, config, tree], x)
                for at in np.unique(node).tolist():
                    if at not in wanted:
                        continue
                    mine = x[node == at]
                    low, high = mine.min(axis=0), mine.max(axis=0)
                    old = found.get((signal, config, tree, at))
                    found[signal, config, tree, at] = [len(mine), low, high] if old is None else [old[0] + len(mine), np.minimum(old[1], low), np.maximum(old[2], high)]
        if found:
            yield pd.DataFrame([[*k, *v] for k, v in found.items()], columns=["signal", "config", "tree", "node", "n", "low", "high"])

    return run


def _choices(plans, width: int):
    def run(frames):
        for frame in frames:
            for (signal, config, tree), part in frame.groupby(["signal", "config", "tree"]):
                plan = plans[signal, config]
                low, high = (part[[f"{c}{k}" for k in range(plan.features)]].to_numpy(float) for c in ("low", "high"))
                feature, cut = trees.choose(plan, int(tree), part["node"].to_numpy(), low, high, part["n"].to_numpy())
                yield part[["signal", "config", "tree", "node"]].assign(feature=feature, cut=cut, n=part["n"])

    return run


def _routed(plans, held):
    """Rows of each tree's sample with the node below the top that they reach, but for leaves of the top."""

    def run(frames):
        tops = held.value
        for signal, config, hashes, values in _keyed(frames):
            plan = plans[signal, config]
            for tree in range(plan.trees):
                top = tops[signal, config, tree]
                x = values[plan.member(hashes, tree)]
                node = _down(top, x)
                going = ~np.isin(node, list(top))
                if going.any():
                    yield pd.DataFrame({"signal": signal, "config": config, "tree": tree, "node": node[going], "features": list(x[going])})

    return run
