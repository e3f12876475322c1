"""Exact top-k inner products: candidates by descending length, pruned by rotated partial sums.

Vectors are whole numbers, ``floor(scale * x)`` of each component. A rotation by the
eigenvectors of their second moments (an SVD of the whole table, from sums that tasks add
up) moves most of a vector's length into its first coordinates. Candidates are
range-partitioned by descending length and cut into blocks of bounded size.

The first round shows every query the blocks of the longest candidates, as many as the square
root of their number; the last of its k best so far is what any later candidate must reach.
The second round shows a block of queries the blocks whose longest vector can reach that for
one of the queries. In both a task holds a few blocks of candidates, bounded in bytes, and
block after block of queries passes by them: no pair of blocks is written, shuffled or
broadcast, and of what a task finds it hands on the k best of each query. Inside a block,
candidates come by descending length: queries for which they are too short (Cauchy-Schwarz on
whole vectors) drop out, and for the others the inner product of the first coordinates plus the
product of the residual lengths must reach the bound, once for few and once for more
coordinates. What is left is multiplied exactly in whole numbers.

Pruning works in doubles with a margin far above their rounding errors and drops only what
lies below the bound, so no candidate and no tie is lost. Ties go to the smaller id.

Null vectors, vectors with null or non-finite components and rows without an id take no
part; shorter vectors count as ending in zeros, empty and zero vectors have products 0.
Every row is a query or candidate of its own, also repeated ones; a query leaves out all
rows with its own id. Products beyond 2**62 are an error. No rows, no result. Only the two
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ridestats.llm.packing import give_back
from ridestats.sources.scratch import single_files, small_batches, small_files, stage

BLOCK_BYTES = 2 << 20  # of whole numbers in a block of candidates; one of queries has a quarter
FIRST_BLOCKS = 2  # blocks of the longest candidates that every query meets in the first round, at least
RANGES = 1024  # most ranges of lengths
FILE_BLOCKS = 8  # blocks in a file; a task holds the candidates of one file
TASKS = 4096  # of a round, unless there are more files of candidates
CHUNK = 256  # candidates looked at together
DENSE = 64  # where more than one in so many products is left, a matrix product makes them all
MARGIN = 1e-9  # of the product of lengths
ENERGY = (0.5, 0.8)  # shares of the squared lengths in the first and second partial sums
_DOUBLES, _LONGS, _WHOLE = 2.0**52, 2.0**62, 2.0**53


def whole_vectors(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v, length) with whole components, of the rows that take part."""
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))

    def whole(c: Column) -> Column:
        scaled = c * F.lit(float(scale))
        return F.when(F.abs(scaled) < _WHOLE, F.floor(scaled)).otherwise(F.raise_error(F.lit("a component is too large")).cast("long"))

    v = x.filter(F.col("id").isNotNull() & F.col("x").isNotNull() & finite).select("id", F.transform("x", whole).alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    return v.withColumn("length", F.sqrt(squares))


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id",
                 vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` candidates of each query with the highest products.

    ``is_query`` is a condition on the column ``id``; every row but the query's own is a
    candidate. A query with fewer candidates gets them all.
    """
    if k < 1:
        raise ValueError("k >= 1 is needed")
    spark = vectors.sparkSession
    whole = stage(whole_vectors(vectors, scale, id_col, vector_col), "whole-vectors")
    size, n, longest = whole.agg(F.max(F.size("v")), F.count(F.lit(1)), F.max("length")).first()
    size = max(size or 0, 1)
    n_queries, longest_query = whole.filter(is_query).agg(F.count(F.lit(1)), F.max("length")).first()
    if (longest or 0.0) * (longest_query or 0.0) >= _LONGS:
        raise ValueError("inner products may pass 2**62")
    rows = max(16, BLOCK_BYTES // (8 * size))
    candidates = _blocks(whole, n, rows, size, "candidate-blocks")
    queries = _blocks(whole.filter(is_query), n_queries, max(16, rows // 4), size, "query-blocks")
    search = _searcher(_rotation(whole, size), size, k)
    blocks = candidates.count()
    # Block numbers follow the order of lengths: the first ones hold the longest.
    last = candidates.select("block").orderBy("block").limit(max(FIRST_BLOCKS, isqrt(blocks))).agg(F.max("block")).first()[0]
    front = F.col("block") <= (-1 if last is None else last)

    def meet(asked: DataFrame, some: DataFrame, label: str) -> DataFrame:
        """The k best of each query in some blocks of candidates; those of a file are held by a task, queries pass by.

        Sizes that Spark could go by say nothing of a product: the hint keeps it from sending either side to all tasks.
        """
        passing = asked.coalesce(max(1, TASKS // -(-max(blocks, 1) // FILE_BLOCKS)))
        met = passing.hint("shuffle_replicate_nl").join(some.select("longest", "ids", "vs"), F.col("longest") >= F.col("need"))
        found = met.select("query_block", "query_ids", "query_vs", "bounds", "ids", "vs").mapInArrow(
            search, "query_block long, query int, query_id long, vec_id long, score long")
        with single_files(spark), small_batches(spark, 4 * BLOCK_BYTES):
            return stage(best(found), label)

    def best(found: DataFrame) -> DataFrame:
        """The k best of each query; what a task found is k rows a query at most."""
        top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id"))), 1, k)
        return found.groupBy("query_block", "query", "query_id").agg(top.alias("top"))

    own = queries.select(F.col("block").alias("query_block"), F.col("ids").alias("query_ids"), F.col("vs").alias("query_vs"), "lengths")
    none = F.lit(None).cast("array<bigint>")
    with small_files(spark, FILE_BLOCKS):
        longest_ones = stage(candidates.filter(front), "front-blocks")
    top = meet(own.withColumn("bounds", none).withColumn("need", F.lit(0.0)), longest_ones, "first-products")
    # By block the bounds of its queries, in their order, and the shortest candidate that matters.
    held = top.groupBy("query_block").agg(F.map_from_entries(F.collect_list(F.struct(
        "query", F.when(F.size("top") == k, -F.element_at("top", -1)["down"]).alias("bound")))).alias("held"))
    bounds = F.transform(F.sequence(F.lit(0), F.size("query_ids") - 1), lambda i: F.try_element_at("held", i))
    reach = F.zip_with("bounds", "lengths", lambda b, q: F.when((b > 0) & (q > 0), b / q * (1 - MARGIN)).otherwise(0.0))
    bounded = own.join(held, "query_block", "left").withColumn("bounds", bounds).withColumn("need", F.array_min(reach)).drop("held", "lengths")
    with small_files(spark, FILE_BLOCKS):
        asked = stage(bounded, "asked-blocks")
    least = asked.agg(F.coalesce(F.min("need"), F.lit(0.0))).first()[0]
    later = meet(asked, candidates.filter(~front & (F.col("longest") >= least)), "later-products")
    each = top.unionByName(later).select("query_block", "query", "query_id", F.explode("top").alias("t")).select(
        "query_block", "query", "query_id", (-F.col("t")["down"]).alias("score"), F.col("t")["vec_id"].alias("vec_id"))
    final = best(each).select("query_id", F.posexplode("top").alias("place", "t"))
    return final.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("t")["vec_id"].alias("vec_id"),
                        (-F.col("t")["down"]).alias("score"))


def _blocks(whole: DataFrame, n: int, rows: int, size: int, label: str) -> DataFrame:
    """(block, longest, ids, lengths, vs): the ``n`` vectors by descending length, their components one after the other.

    Block numbers hold the range of lengths in their upper half. They are written, a few to a file.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, rows - n)
                held.append(part)
                at, n = at + part.num_rows, n + part.num_rows
                if n == rows:
                    yield one(number, held)
                    number, held, n = number + 1, [], 0
        if held:
            yield one(number, held)

    def one(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(held).combine_chunks()
        ids, lengths = part["id"].combine_chunks(), part["length"].combine_chunks()
        ends = pa.array([0, len(ids)], pa.int32())
        lists = part["v"].combine_chunks()
        counts = np.diff(np.asarray(lists.offsets))
        flat = np.zeros(len(ids) * size, np.int64)
        where = np.repeat(np.arange(len(ids)) * size, counts) + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
        flat[where] = np.asarray(lists.flatten())
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([lengths[0].as_py()]), pa.ListArray.from_arrays(ends, ids),
             pa.ListArray.from_arrays(ends, lengths), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))], names=names)

    names = ["block", "longest", "ids", "lengths", "vs"]
    ranges = int(min(RANGES, max(1, -(-n // (4 * rows)))))
    ordered = whole.repartitionByRange(ranges, F.desc("length"), "id").sortWithinPartitions(F.desc("length"), "id")
    made = ordered.mapInArrow(cut, "block long, longest double, ids array<long>, lengths array<double>, vs array<long>")
    with small_files(whole.sparkSession, FILE_BLOCKS):
        return stage(made, label)


def _rotation(whole: DataFrame, size: int) -> np.ndarray:
    """Orthogonal columns, those along which the vectors are longest first."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            lists = batch.column(0)
            counts = np.diff(np.asarray(lists.offsets))
            v = np.zeros((len(counts), size))
            inside = np.arange(size) < counts[:, None]
            v[inside] = np.asarray(lists.flatten())
            total += v.T @ v
        i, j = np.indices(total.shape).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"i": i.ravel(), "j": j.ravel(), "x": total.ravel()})

    sums = whole.select("v").mapInArrow(moments, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    matrix = np.zeros((size, size))
    for i, j, x in sums:  # size * size numbers
        matrix[i, j] = x
    peak = np.abs(matrix).max()
    _, columns = np.linalg.eigh((matrix + matrix.T) / (2 * peak or 1.0))
    return np.ascontiguousarray(columns[:, ::-1])


def _searcher(rotation: np.ndarray, size: int, k: int):
    """Search pairs of blocks; the k best of a block of queries are kept while pairs with it follow each other."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, q_ids, best = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                if row["query_block"].as_py() != block:
                    if best is not None:
                        yield told(block, q_ids, best)
                    block, best = row["query_block"].as_py(), None
                    q_ids, known = np.array(row["query_ids"].values), row["bounds"].values
                    bounds = np.full(len(q_ids), -np.inf) if known is None else np.array(
                        [-np.inf if b is None else b for b in known.to_pylist()], np.float64)
                q, c = (np.asarray(row[x].values).reshape(-1, size) for x in ("query_vs", "vs"))
                best = best_of_block(q, q_ids, c, np.asarray(row["ids"].values), bounds, rotation, k, best)
                give_back()
        if best is not None:
            yield told(block, q_ids, best)

    def told(block: int, q_ids: np.ndarray, best: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        who, ids, scores = best
        return pa.RecordBatch.from_pydict(
            {"query_block": pa.array(np.full(len(who), block), pa.int64()), "query": pa.array(who, pa.int32()),
             "query_id": pa.array(q_ids[who], pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.int64())})

    return search


def best_of_block(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, bounds: np.ndarray, rotation: np.ndarray,
                  k: int, before: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best candidates of each query that reach its bound.

    Candidates come by descending length. ``bounds``: scores that matter are not below.
    ``before``: what other blocks have left of the same queries; the best of all are returned.
    """
    turned = [np.asarray(v, np.float64) @ rotation for v in (q, c)]
    tails = [np.sqrt(np.cumsum((t**2)[:, ::-1], axis=1)[:, ::-1]) for t in turned]  # lengths from a coordinate on
    energy = np.cumsum((turned[1] ** 2).sum(axis=0))
    cuts = sorted({int(np.searchsorted(energy, e * energy[-1])) + 1 for e in ENERGY} - {q.shape[1]}) if energy[-1] else []
    rest = [[np.append(t, np.zeros((len(t), 1)), axis=1)[:, h] for h in (0, *cuts)] for t in tails]
    best_who, best_ids, best_scores = before or (np.empty(0, np.int64) for _ in range(3))
    bounds, edges = bounds.copy(), np.full(len(bounds), np.iinfo(np.int64).max)  # at the bound, a smaller id than the edge matters
    _raise(bounds, edges, best_who, best_ids, best_scores, k)
    q_long, c_long = rest[0][0], rest[1][0]
    for at in range(0, len(c), CHUNK):
        part = slice(at, min(at + CHUNK, len(c)))
        active = np.flatnonzero(q_long * c_long[at] * (1 + MARGIN) >= bounds)
        if not len(active):
            break  # all later candidates are shorter
        slack = MARGIN * np.outer(q_long[active], c_long[part])
        sums, alive, done = None, None, 0
        for level, h in enumerate(cuts, 1):
            more = turned[0][active, done:h] @ turned[1][part, done:h].T
            sums, done = more if sums is None else sums + more, h
            alive = sums + np.outer(rest[0][level][active], rest[1][level][part]) + slack >= bounds[active, None]
            if not alive.any():
                break
        if alive is None:
            alive = np.ones((len(active), part.stop - at), bool)
        alive &= q_ids[active, None] != c_ids[None, part]
        left = np.count_nonzero(alive)
        if not left:
            continue
        kind = np.float64 if q_long.max() * c_long[at] < _DOUBLES else np.int64  # either is exact
        if left * DENSE > alive.size:
            i, j, scores = _dense(q[active].astype(kind), c[part].astype(kind), c_ids[part], alive, bounds[active], k)
            i, j = active[i], j + at
        else:
            i, j = np.nonzero(alive)
            i, j = active[i], j + at
            scores = _products(q, c, i, j, kind)
        reach = (scores > bounds[i]) | (scores == bounds[i]) & (c_ids[j] < edges[i])
        if not reach.any():
            continue
        who, ids, scores = (np.concatenate([a, b[reach]]) for a, b in zip((best_who, best_ids, best_scores), (i, c_ids[j], scores)))
        order = np.lexsort((ids, -scores, who))
        who, ids, scores = who[order], ids[order], scores[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        best_who, best_ids, best_scores = (x[place < k] for x in (who, ids, scores))
        _raise(bounds, edges, best_who, best_ids, best_scores, k)
    return best_who, best_ids, best_scores


def _raise(bounds: np.ndarray, edges: np.ndarray, who: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
    """Nothing behind the last of a query's k best, by score and id, matters any more; ``who`` ascends."""
    last = np.arange(len(who)) - np.searchsorted(who, who) == k - 1
    who, ids, scores = who[last], ids[last], scores[last]
    higher = scores >= bounds[who]
    bounds[who[higher]], edges[who[higher]] = scores[higher], ids[higher]


def _dense(q: np.ndarray, c: np.ndarray, c_ids: np.ndarray, alive: np.ndarray, bounds: np.ndarray,
           k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of c, score) of the k best of each row among those alive, from one matrix product; rows below their bound are left out."""
    by_id = np.argsort(c_ids, kind="stable")
    down = -(q @ c[by_id].T)
    alive = alive[:, by_id]
    down[~alive] = np.inf if down.dtype == np.float64 else np.iinfo(np.int64).max
    rows = np.flatnonzero(alive.any(axis=1) & (down.min(axis=1) <= -bounds))
    j = np.argsort(down[rows], axis=1, kind="stable")[:, :k]  # of equal scores the smaller ids
    i = np.broadcast_to(rows[:, None], j.shape)
    taken = alive[i, j]
    i, j = i[taken], j[taken]
    return i, by_id[j], (-down[i, j]).astype(np.int64)


def _products(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray, kind: type) -> np.ndarray:
    """Inner products of the rows i of q and j of c, a bounded number at a time."""
    out, step = np.empty(len(i), np.int64), max(1, (1 << 20) // q.shape[1])
    for a in range(0, len(i), step):
        b = slice(a, a + step)
        out[b] = np.einsum("ij,ij->i", q[i[b]].astype(kind), c[j[b]].astype(kind))
    return out
