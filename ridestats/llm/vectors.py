"""Near-duplicate vectors by binary codes of randomly rotated vectors.

A vector, scaled to length 1 and rotated at random, is stored as the signs of its
coordinates and a correction factor, the inner product of the rotated vector with its own
signs. From a vector, the signs and factor of another, their inner product is estimated
without bias, with a confidence bound that follows from the factor; pairs whose bound
lies below the threshold are done, all others are computed exactly in double precision.

Which vectors meet. Equal vectors are one class. The signs of several rotations are cut
into ``tables`` keys; vectors that share a key of a table meet there, and a pair counts in
the first table in which it meets. A pair with cosine 0.98 shares a given key of 16 signs
with probability 0.35, so 32 tables miss it with probability 1e-6, and pairs beyond with
less; the bound (``width`` deviations) errs less often still. Keys that one class alone has
leave after one aggregation.

Groups of one key are cut into chunks and worked on by pairs of chunks, so a group may
hold any share of all vectors. A pair of chunks is two small matrices; what leaves a task
are numbers of links and a spanning forest, never all pairs.

Vectors are compared only when their labels are equal and not null. Null or empty vectors,
vectors of zeros or with null or non-finite numbers, and vectors of different lengths link
with nothing. Repeated rows are vectors of their own. Ids may repeat or be null; a null id
counts for nothing in the smallest id of a component unless it has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ridestats.llm.components import Forest, components
from ridestats.sources.scratch import stage

CHUNK = 512  # vectors of a group that are compared at a time
TABLES, BITS = 32, 16
BIN_ROWS = 20_000  # rows of a task of many groups


@lru_cache(maxsize=4)
def rotations(size: int, count: int, seed: int = 7) -> np.ndarray:
    """``count`` random rotations of ``size`` dimensions."""
    rng = np.random.default_rng(seed)
    out = [np.linalg.qr(rng.standard_normal((size, size))) for _ in range(count)]
    return np.stack([q * np.sign(np.diag(r)) for q, r in out]).astype(np.float32)


def keys_of(unit: np.ndarray, tables: int = TABLES, bits: int = BITS) -> np.ndarray:
    """Keys of each vector in each table, from the signs of as many rotations as it takes."""
    size = unit.shape[1]
    turned = np.concatenate([unit @ r for r in rotations(size, -(-tables * bits // size))], axis=1)
    signs = (turned[:, : tables * bits] > 0).reshape(len(unit), tables, bits)
    return (signs * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)


class Codes:
    """Signs, correction factors and lengths of the confidence intervals of some vectors."""

    def __init__(self, unit: np.ndarray):
        size = unit.shape[1]
        self.turned = unit @ rotations(size, 1, seed=11)[0]
        self.signs = np.where(self.turned > 0, 1, -1).astype(np.float32) / np.sqrt(np.float32(size))
        self.factor = np.maximum((self.turned * self.signs).sum(axis=1), 1e-6)
        self.spread = np.sqrt(np.maximum(1 / self.factor**2 - 1, 0) / max(1, size - 1))

    def estimate(self, queries: np.ndarray, rows: slice | np.ndarray = slice(None)) -> np.ndarray:
        """Unbiased estimates of the inner products of rotated unit vectors with these."""
        return (queries @ self.signs[rows].T) / self.factor[rows]


def links_of(a: np.ndarray, b: np.ndarray, keys_a: np.ndarray, keys_b: np.ndarray, table: int, threshold: float,
             width: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs with the threshold that meet first in this table; each once if ``same``."""
    unit_a, unit_b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    codes = Codes(unit_b.astype(np.float32))
    queries = unit_a.astype(np.float32) @ rotations(a.shape[1], 1, seed=11)[0]
    open_pairs = codes.estimate(queries) + width * codes.spread >= threshold
    if same:
        open_pairs = np.triu(open_pairs, 1)
    left, right = np.nonzero(open_pairs)
    found = []
    for i in range(0, len(left), 1 << 16):  # exact, some pairs at a time
        x, y = left[i : i + (1 << 16)], right[i : i + (1 << 16)]
        norms = np.sqrt(np.einsum("ij,ij->i", a, a)[x]) * np.sqrt(np.einsum("ij,ij->i", b, b)[y])
        near = np.einsum("ij,ij->i", a[x], b[y]) / norms >= threshold
        x, y = x[near], y[near]
        earlier = (keys_a[x, :table] == keys_b[y, :table]).any(axis=1)
        found.append((x[~earlier], y[~earlier]))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (left, right)


def _usable(vector: str) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(good, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def near_vectors(vectors: DataFrame, threshold: float = 0.98, tables: int = TABLES, bits: int = BITS, width: float = 5.0,
                 id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    n_links: other rows with a cosine of at least the threshold; component_id: smallest id
    that links lead to, its own included; kept: whether that is its own.
    """
    own = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    usable = F.col("label").isNotNull() & _usable("vector")
    own = own.select("vec_id", "label", F.when(usable, F.col("vector")).alias("vector"))
    known = own.filter("vector is not null")
    classes = known.groupBy("label", "vector").agg(F.count("*").alias("times"))
    classes = stage(classes.select(F.monotonically_increasing_id().alias("class"), F.xxhash64("label", F.size("vector")).alias("side"), "label", "vector", "times"), "vector-classes")
    links, counts = _links(classes, threshold, tables, bits, width)
    roots = components(links).select(F.col("node").alias("class"), "root")
    placed = classes.join(roots, "class", "left").join(counts, "class", "left").select(
        F.col("label").alias("_label"), F.col("vector").alias("_vector"), F.coalesce("root", "class").alias("root"),
        (F.col("times") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    rows = own.join(placed, (F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector")), "left").select("vec_id", "root", "n_links")
    rows = stage(rows, "placed-vectors")
    least = rows.filter("root is not null").groupBy("root").agg(F.min("vec_id").alias("least"))
    out = rows.join(least, "root", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = np.asarray(vectors.flatten(), np.float64)
    return flat.reshape(len(vectors), -1)


def _links(classes: DataFrame, threshold: float, tables: int, bits: int, width: float) -> tuple[DataFrame, DataFrame]:
    """A spanning forest of the links (a, b) of classes, and how many rows each class links to."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch["vector"].value_lengths())
            for size in np.unique(sizes):
                some = pa.array(np.flatnonzero(sizes == size))
                rows = batch.take(some)
                x = _matrix(rows["vector"])
                keys = keys_of((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32), tables, bits)
                yield pa.RecordBatch.from_arrays(
                    [rows["class"], rows["side"], pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), tables).cast(pa.list_(pa.int32()))],
                    names=["class", "side", "keys"])

    keyed = stage(classes.select("class", "side", "vector").mapInArrow(key, "class long, side long, keys array<int>"), "vector-keys")
    entries = keyed.select("class", "side", F.posexplode("keys").alias("table", "key"))
    group = ["side", "table", "key"]
    groups = entries.groupBy(*group).agg(F.count("*").alias("size")).filter("size > 1").withColumn("chunks", F.ceil(F.col("size") / F.lit(CHUNK)).cast("int"))
    members = entries.join(groups, group).withColumn("chunk", F.pmod(F.xxhash64("class"), "chunks").cast("int"))
    # A chunk meets itself and every other chunk of its group once.
    pairs = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pairs = pairs.select("class", F.col("table").cast("int").alias("table"), F.xxhash64(*group, F.least("chunk", "other"), F.greatest("chunk", "other")).alias("unit"),
                         (F.col("chunk") <= F.col("other")).alias("first"), (F.col("chunk") >= F.col("other")).alias("second"))
    pairs = stage(pairs, "vector-meetings")
    bins = max(1, -(-pairs.count() // BIN_ROWS))
    rows = pairs.join(classes.select("class", "vector", "times"), "class").join(keyed.select("class", "keys"), "class").withColumn(
        "bin", F.pmod("unit", F.lit(bins)))

    def compare(batch: pa.Table) -> pa.Table:
        units, out = np.asarray(batch["unit"]), ([], [], [])
        order = np.argsort(units, kind="stable")
        nodes, times, table, first, second = (np.asarray(batch[c]) for c in ("class", "times", "table", "first", "second"))
        vectors, keys = batch["vector"].combine_chunks(), batch["keys"].combine_chunks()
        forest = Forest()
        for rows in np.split(order, np.flatnonzero(np.diff(units[order])) + 1):
            at = pa.array(rows)
            x, k = _matrix(vectors.take(at)), np.asarray(keys.take(at).flatten()).reshape(len(rows), -1)
            a, b = np.flatnonzero(first[rows]), np.flatnonzero(second[rows])
            same = len(a) == len(rows) == len(b)
            p, q = links_of(x[a], x[b], k[a], k[b], int(table[rows[0]]), threshold, width, same)
            p, q = rows[a[p]], rows[b[q]]
            out[0].append(np.concatenate([nodes[p], nodes[q]]))
            out[1].append(np.concatenate([times[q], times[p]]))
            for s, t in zip(nodes[p].tolist(), nodes[q].tolist()):
                forest.join(s, t)
        node, at = np.unique(np.concatenate(out[0]) if out[0] else np.empty(0, np.int64), return_inverse=True)
        n = np.bincount(at, np.concatenate(out[1]) if out[1] else None, len(node)).astype(np.int64)
        return pa.table({"node": pa.array(node, pa.int64()), "n": pa.array(n, pa.int64()),
                         "root": pa.array([forest.root(x) for x in node.tolist()], pa.int64())})

    found = stage(rows.groupBy("bin").applyInArrow(compare, "node long, n long, root long"), "vector-links")
    links = found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    return links, found.groupBy(F.col("node").alias("class")).agg(F.sum("n").alias("n"))
