"""Isolation forest (Liu, Ting & Zhou 2008).

Every tree sees a bounded hash sample, so trees are grown one per group; all
rows are then scored against the node table, whose size is set by the number of
trees and the sample size, not by the data. Random choices are md5 draws per
(seed, tree, node): the forest is the same under any partitioning.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import uniform

NODE_SCHEMA = "tree int, node int, feature int, threshold double, path double"
_EULER = 0.5772156649015329


@dataclass(frozen=True)
class Forest:
    """Node table (``feature`` is -1 at a leaf) and its parameters."""

    nodes: DataFrame
    features: tuple[str, ...]
    trees: int
    sample: int


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + _EULER) - 2.0 * (n - 1.0) / n


def depth_limit(sample: int) -> int:
    return math.ceil(math.log2(max(sample, 2)))


def _draw(*tags: object) -> float:
    word = hashlib.md5("|".join(map(str, tags)).encode()).hexdigest()[:8]
    return (int(word, 16) + 1) / 4294967297.0


def fit_forest(
    rows: DataFrame,
    key: str,
    features: Sequence[str],
    trees: int = 50,
    max_samples: int = 1_000,
    seed: int = 42,
) -> Forest:
    """Grow ``trees`` trees on ``max_samples`` rows each (all rows if fewer).

    ``key`` must be unique: it decides which trees see a row.
    """
    n = rows.count()
    sample = min(max_samples, n)
    # Enough for the sample with a margin of ten standard deviations; the grower
    # keeps exactly the ``sample`` lowest draws.
    share = min(1.0, (sample + 10.0 * math.sqrt(sample) + 30.0) / max(n, 1))
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.struct(t.alias("tree"), uniform(F.col("key"), t.cast("string"), seed).alias("u")),
    )
    tagged = (
        rows.select(
            F.col(key).alias("key"), F.array(*[F.col(f).cast("double") for f in features]).alias("x")
        )
        .select("key", "x", F.explode(F.filter(draws, lambda d: d["u"] <= F.lit(share))).alias("d"))
        .select("key", "x", "d.tree", "d.u")
    )
    nodes = tagged.groupBy("tree").applyInPandas(_grower(sample, seed), NODE_SCHEMA)
    return Forest(nodes, tuple(features), trees, sample)


def _grower(sample: int, seed: int):
    limit = depth_limit(sample)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        chosen = group.sort_values(["u", "key"], kind="stable").head(sample)
        x = np.array(chosen["x"].tolist(), dtype="float64")
        tree = int(group["tree"].iloc[0])
        out, todo = [], [(1, 0, np.arange(len(x)))]
        while todo:
            node, depth, members = todo.pop()
            here = x[members]
            low, high = here.min(axis=0), here.max(axis=0)
            varied = np.flatnonzero(low < high)
            if depth == limit or len(members) <= 1 or len(varied) == 0:
                out.append((tree, node, -1, 0.0, depth + average_path(len(members))))
                continue
            feature = int(varied[int(_draw(seed, tree, node, "f") * len(varied))])
            span = high[feature] - low[feature]
            threshold = float(low[feature] + _draw(seed, tree, node, "t") * span)
            out.append((tree, node, feature, threshold, 0.0))
            goes_left = here[:, feature] <= threshold
            for child, part in ((2 * node, members[goes_left]), (2 * node + 1, members[~goes_left])):
                if len(part):
                    todo.append((child, depth + 1, part))
                else:
                    out.append((tree, child, -1, 0.0, float(depth + 1)))
        return pd.DataFrame(out, columns=["tree", "node", "feature", "threshold", "path"])

    return grow


def forest_score(forest: Forest) -> Column:
    """Score column over the forest's features: -1 (isolated) to 0 (normal)."""
    # At most trees * 2 * sample nodes, whatever the number of rows.
    nodes = sorted(tuple(n) for n in forest.nodes.collect())
    place = {(tree, node): i for i, (tree, node, *_) in enumerate(nodes)}
    feature = np.array([n[2] for n in nodes], dtype="int32")
    threshold, path = (np.array([n[i] for n in nodes], dtype="float64") for i in (3, 4))
    # A leaf is its own child; so is a node whose side was never grown.
    left, right = (
        np.array([place.get((t, 2 * n + side), i) if f >= 0 else i for i, (t, n, f, *_) in enumerate(nodes)], dtype="int64")
        for side in (0, 1)
    )
    roots = [place[t, 1] for t in range(forest.trees) if (t, 1) in place]
    depth = depth_limit(forest.sample)
    tables = forest.nodes.sparkSession.sparkContext.broadcast((feature, threshold, path, left, right))
    scale = average_path(forest.sample) or 1.0

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        feature, threshold, path, left, right = tables.value
        x = np.column_stack([c.to_numpy(dtype="float64") for c in columns])
        rows = np.arange(len(x))
        total = np.zeros(len(x))
        for root in roots:
            at = np.full(len(x), root)
            for _ in range(depth):
                goes_right = x[rows, feature[at]] > threshold[at]
                at = np.where(goes_right, right[at], left[at])
            total += path[at]
        return pd.Series(-np.exp2(-(total / max(1, len(roots))) / scale))

    return F.round(score(*[F.col(f).cast("double") for f in forest.features]), 9)
