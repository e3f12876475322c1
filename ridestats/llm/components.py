"""Connected components of a graph given by its edges, as Spark joins.

Each task first replaces its edges by a spanning forest of them. Then rounds of "large
star" and "small star" hang every node under its smallest neighbour until nothing
changes, in about as many rounds as the logarithm of the longest chain. No component is
ever gathered in one place: a node with very many edges is an aggregated minimum and a
join whose large side can be split. Each round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ridestats.sources.scratch import stage


class Forest:
    """Union-find over any hashable nodes; the root of a set is its smallest node."""

    def __init__(self) -> None:
        self.above: dict = {}

    def root(self, x):
        above, path = self.above, []
        while (up := above.get(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            above[p] = x
        return x

    def join(self, x, y) -> bool:
        """Whether the two were apart."""
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.above[max(x, y)] = min(x, y)
        return True


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
            if a != b:
                forest.join(a, b)
    nodes = list(forest.above)
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pa.RecordBatch.from_pydict(
            {"a": pa.array(part, pa.int64()), "b": pa.array([forest.root(x) for x in part], pa.int64())})


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b) but the roots; root: its smallest node.

    Nodes are longs without nulls. Loops and repeated edges are harmless; no edges, no rows.
    """
    at = stage(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_forest, "a long, b long"), "forest")
    before = None
    while (now := _state(at)) != before and now[0]:
        before = now
        at = stage(_small_star(_large_star(at)), "stars")
    return at.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    rest = down.join(least, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return rest.unionByName(least.withColumnRenamed("low", "b")).distinct()
