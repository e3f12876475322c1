"""Exact k-nearest-neighbour self join over weighted distinct points.

A tree without a cap. Its first level are the cells of a hash sample of the points as
pivots: a point belongs to its nearest pivot. Cells that lie together make up regions, the
rows that tasks exchange. A cell with more points than a region may have is cut further,
level by level, into slabs along its widest dimension at quantiles that tasks estimate
together; points learn their slab in a join with the cuts of their node. No node is ever
gathered. Inside a region, points lie in leaves: cells, or parts of them.

Every region first compares its points with each other, which bounds the distance of each
point's k-th neighbour. Then the tree is walked down for all regions at once, as joins of
(region, node) with the node's children; a child whose box is farther from the region's
box than the largest bound is left out with all below it. The regions that remain pass by
nearest first, while the bounds shrink. Inside, a point is compared with the leaves that
the triangle inequality cannot exclude, nor the plane half way between its own pivot and
theirs. A task holds two regions at a time, and hands on k neighbours of a point.

Nothing is dropped or approximated: squared distances by a matrix product say, with a
margin, which pairs may matter, and those are measured again by differences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import stage
from .ranking import sorted_codes

PIVOTS = 4_096          # cells of the first level; pivots travel to every task
REGION_POINTS = 16_384  # points in a region, the unit that tasks exchange
LEAST_POINTS, REGIONS = 1_024, 32  # small sets have smaller regions, so that there are some for every core
LEAF_POINTS = 24        # points in a leaf, the unit that is compared
ROWS = 512              # points compared with all of a region at a time
FANOUT = 16             # slabs of a node below the first level
MOST_PARTS = 10_000     # of a comparison; more regions share them
LEVELS = 40             # of the tree; larger regions are cut into parts without regard to place
_MARGIN = 1e-12         # of squared lengths, far above the rounding of a matrix product
_NEAR = 1 + 1e-9        # bounds are taken a little wider


def nearest_neighbors(
    points: DataFrame,
    k: int,
    region_points: int | None = None,
    leaf_points: int = LEAF_POINTS,
    fanout: int = FANOUT,
) -> DataFrame:
    """``(pid, nbr, dist, w)``: per point the nearest rows until ``k`` are counted.

    ``points`` is ``(pid string, w bigint, x array<double>)``, one row per
    distinct position, ``w`` being the number of rows there. ``w`` of the result
    says how many rows of ``nbr`` count. Ties go to the smaller ``pid``.
    """
    points = points.select("pid", "w", "x")
    codes = stage(sorted_codes(points, "pid", "at"), "point-codes")
    own = stage(points.join(codes, "pid").select(F.col("at").cast("long").alias("at"), "w", "x"), "points")
    dims, n = own.agg(F.max(F.size("x")), F.count(F.lit(1))).first()
    if not n:
        return points.select("pid", F.col("pid").alias("nbr"), F.lit(0.0).alias("dist"), "w")
    region_points = region_points or max(LEAST_POINTS, min(REGION_POINTS, n // REGIONS))
    sample = own.select("at", "x").orderBy(F.xxhash64("at"), "at").limit(max(1, min(PIVOTS, n // leaf_points))).collect()
    pivots = np.array([r["x"] for r in sample], dtype="float64")
    celled = stage(own.mapInArrow(_placer(pivots, dims), "at long, w long, x array<double>, cell int"), "cells")
    sizes = np.zeros(len(pivots), dtype="int64")
    for r in celled.groupBy("cell").count().collect():  # a number per pivot
        sizes[r["cell"]] = r["count"]
    labels = F.array(*map(F.lit, _labels(pivots, sizes, region_points)))
    placed, nodes = _tree(celled.withColumn("node", F.element_at(labels, F.col("cell") + 1)), dims, region_points, max(2, fanout))
    regions = stage(placed.groupBy("node").applyInArrow(_packed(pivots, region_points, leaf_points, dims), _REGION), "regions")
    itself = regions.select("region", F.col("region").alias("other"), F.lit(0.0).alias("apart"))
    found = _met(itself, regions, None, k, dims)
    found = stage(_best(found, k), "own-region")
    bounds = _bounds(found, regions, k)
    met = _met(_near_regions(regions, nodes, bounds), regions, bounds, k, dims)
    found = stage(_best(found.unionByName(met), k), "nearest")
    names = codes.select(F.col("pid").alias("nbr"), F.col("at").alias("near"))
    return found.join(codes, "at").join(names, "near").select("pid", "nbr", "dist", "w")


# The tree ----------------------------------------------------------------------


def _placer(pivots: np.ndarray, dims: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                cell = _squares(np.asarray(part["x"].flatten()).reshape(-1, dims), pivots)[0].argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32())], names=["at", "w", "x", "cell"])

    return place


def _labels(pivots: np.ndarray, sizes: np.ndarray, region_points: int) -> list[str]:
    """By cell the region it goes to: neighbouring cells share one; a large cell has its own."""
    order, label, number, held = leaf_order(pivots, 8), [""] * len(pivots), 0, 0
    for cell in order.tolist():
        if held and held + sizes[cell] > region_points:
            number, held = number + 1, 0
        label[cell] = f"{number:0{_LABEL}d}"
        held += int(sizes[cell])
    return label


def _tree(points: DataFrame, dims: int, region_points: int, fanout: int) -> tuple[DataFrame, DataFrame]:
    """Points with the ``node`` they end in, and all nodes: (node, parent, low, high).

    Nodes are paths: the first level has numbers, children add a letter for their slab.
    """
    todo, done, children = points, [], []
    for level in range(LEVELS + 1):
        sizes = todo.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *_box(dims))
        sizes = stage(sizes, "nodes")
        children.append(sizes.select("node", "low", "high"))
        large = sizes.where(F.col("n") > region_points)
        if level == LEVELS or large.isEmpty():
            break
        cuts = stage(_cuts(todo, large, region_points, fanout), "cuts")
        small = sizes.where(F.col("n") <= region_points).select("node")
        done.append(todo.join(small, "node", "left_semi"))
        slab = F.size(F.filter("cuts", lambda c: F.element_at("x", F.col("dim")) > c))
        moved = todo.join(cuts, "node").withColumn("node", F.concat("node", F.char(F.lit(ord("A")) + slab)))
        todo = stage(moved.select("at", "w", "x", "cell", "node"), "slabs")
    done.append(todo)
    placed, nodes = done[0], children[0]
    for more in done[1:]:
        placed = placed.unionByName(more.select(*placed.columns))
    for more in children[1:]:
        nodes = nodes.unionByName(more)
    parent = F.when(F.length("node") > _LABEL, F.expr("substring(node, 1, length(node) - 1)")).otherwise(F.lit(""))
    return placed, stage(nodes.withColumn("parent", parent), "tree")


def _box(dims: int) -> list[Column]:
    x = [F.element_at("x", i + 1) for i in range(dims)]
    return [F.array(*[F.min(c) for c in x]).alias("low"), F.array(*[F.max(c) for c in x]).alias("high")]


def _cuts(points: DataFrame, large: DataFrame, region_points: int, fanout: int) -> DataFrame:
    """(node, dim, cuts): where the large nodes are cut, ascending, and below the highest point."""
    width = F.zip_with("high", "low", lambda h, lo: h - lo)
    widest = large.select("node", "n", "low", "high", F.array_position(width, F.array_max(width)).cast("int").alias("dim"))
    widest = widest.select("node", "n", "dim", F.element_at("low", F.col("dim")).alias("least"), F.element_at("high", F.col("dim")).alias("most"))
    value = F.element_at("x", F.col("dim"))
    quantiles = F.percentile_approx(value, [i / fanout for i in range(1, fanout)], 1_000)
    found = points.join(widest, "node").groupBy("node").agg(
        F.first("dim").alias("dim"), F.first("n").alias("n"), F.first("least").alias("least"), F.first("most").alias("most"), quantiles.alias("q"))
    # As many slabs as the size asks for; a middle where quantiles say nothing.
    slabs = F.least(F.lit(fanout), F.ceil(F.col("n") * 1.1 / F.lit(region_points)))
    step = F.lit(float(fanout)) / slabs
    inner = F.transform(F.sequence(F.lit(1), slabs.cast("int") - 1), lambda i: F.element_at("q", F.greatest(F.lit(1), F.round(i * step).cast("int"))))
    useful = F.array_distinct(F.filter(inner, lambda c: c < F.col("most")))
    middle = F.array(F.col("least") / 2 + F.col("most") / 2)
    return found.select("node", "dim", F.when(F.size(useful) > 0, F.array_sort(useful)).otherwise(middle).alias("cuts"))


_LABEL = 4  # digits
_REGION = ("region string, node string, low array<double>, high array<double>, ats array<long>, ws array<long>, xs array<double>, "
           "ends array<long>, pivots array<double>, tops array<double>")


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten())


def _packed(pivots: np.ndarray, region_points: int, leaf_points: int, dims: int):
    def pack(group: pa.Table) -> pa.Table:
        x = _flat(group["x"]).reshape(-1, dims)
        ats, ws, cells = (np.asarray(group[c]) for c in ("at", "w", "cell"))
        node, rows = group["node"][0].as_py(), []
        by_name = np.argsort(ats, kind="stable")
        for part, start in enumerate(range(0, len(x), region_points)):
            some = by_name[start : start + region_points]
            order, ends = leaves_of(x[some], cells[some], leaf_points)
            some = some[order]
            begins = np.concatenate([[0], ends[:-1]])
            centres = np.add.reduceat(x[some], begins) / (ends - begins)[:, None]
            rows.append((f"{node}#{part}", node, x[some].min(axis=0), x[some].max(axis=0), ats[some], ws[some], x[some].ravel(), ends,
                         centres.ravel(), pivots[cells[some][begins]].ravel()))
        kinds = (pa.string(), pa.string(), *[pa.list_(pa.float64())] * 2, *[pa.list_(pa.int64())] * 2, pa.list_(pa.float64()),
                 pa.list_(pa.int64()), *[pa.list_(pa.float64())] * 2)
        return pa.table({c.split()[0]: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate(zip(_REGION.split(", "), kinds))})

    return pack


def leaf_order(x: np.ndarray, most: int) -> np.ndarray:
    """An order in which close points stand together: halved along the widest dimension down to ``most`` points."""
    order, todo = np.arange(len(x)), [(0, len(x))]
    while todo:
        a, b = todo.pop()
        if b - a > most:
            middle, some = (b - a) // 2, order[a:b]
            order[a:b] = some[np.argpartition(x[some, int(np.ptp(x[some], axis=0).argmax())], middle)]
            todo += [(a, a + middle), (a + middle, b)]
    return order


def leaves_of(x: np.ndarray, cells: np.ndarray, leaf_points: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings cells, and in them leaves, together, and where leaves end."""
    order = np.argsort(cells, kind="stable")
    cuts = np.flatnonzero(np.diff(cells[order])) + 1
    ends = []
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(x)]):
        leaves = -(-(b - a) // leaf_points)
        if leaves > 1:
            order[a:b] = order[a:b][leaf_order(x[order[a:b]], leaf_points)]
        ends += [a + (b - a) * (leaf + 1) // leaves for leaf in range(leaves)]
    return order, np.array(ends, dtype="int64")


def _squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances, and by row how far off they may be."""
    own, other = (a * a).sum(axis=1), (b * b).sum(axis=1)
    return a @ (-2.0 * b.T) + own[:, None] + other[None, :], _MARGIN * (own + other.max(initial=0.0))


# Which regions meet ---------------------------------------------------------------


def _apart(low: str, high: str, other_low: str, other_high: str) -> Column:
    """Distance of two boxes, a little less for its rounding."""
    gaps = F.zip_with(F.zip_with(other_low, high, lambda a, b: a - b), F.zip_with(low, other_high, lambda a, b: a - b),
                      lambda a, b: F.greatest(a, b, F.lit(0.0)))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)) / _NEAR


def _near_regions(regions: DataFrame, nodes: DataFrame, bounds: DataFrame) -> DataFrame:
    """(region, other, apart): other regions within reach."""
    boxes = regions.select("region", "node", "low", "high")
    own = stage(boxes.join(bounds.select("region", "reach"), "region").select("region", "reach", F.col("low").alias("l"), F.col("high").alias("h")), "reaches")
    near = _apart("l", "h", "low", "high") <= F.col("reach")
    inner, ends = nodes, boxes.withColumnRenamed("region", "other")
    front, found = own.withColumn("at", F.lit("")), []
    while True:
        # The regions of a node; a large one that could not be split has several.
        met = front.join(ends, front["at"] == ends["node"])
        found.append(met.withColumn("apart", _apart("l", "h", "low", "high")).where(
            (F.col("apart") <= F.col("reach")) & (F.col("region") != F.col("other"))).select("region", "other", "apart"))
        below = front.join(inner, front["at"] == inner["parent"]).where(near).select("region", "reach", "l", "h", F.col("node").alias("at"))
        front = stage(below, "front")
        if front.isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return stage(every, "near-regions")


def _bounds(found: DataFrame, regions: DataFrame, k: int) -> DataFrame:
    """(region, bounds, reach): by place the distance that a neighbour must not exceed, and the largest."""
    last = found.groupBy("region", "row").agg(F.max("dist").alias("d"), F.sum("w").alias("have"))
    held = last.where(F.col("have") >= k).groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("row", "d"))).alias("held"))
    places = F.sequence(F.lit(0), F.size("ats") - 1)
    bounds = F.transform(places, lambda i: F.coalesce(F.try_element_at("held", i), F.lit(float("inf"))))
    both = regions.select("region", "ats").join(held, "region", "left").select("region", bounds.alias("bounds"))
    return both.withColumn("reach", F.array_max("bounds"))


# Comparing ------------------------------------------------------------------------


def _met(pairs: DataFrame, regions: DataFrame, bounds: DataFrame | None, k: int, dims: int) -> DataFrame:
    """(region, row, at, near, dist, w): for each point of a region its k best in the others."""
    parts = max(1, min(MOST_PARTS, regions.count()))
    asking = regions.select("region", "ats", "xs", F.col("ends").alias("own_ends"), F.col("tops").alias("own_tops"))
    if bounds is None:
        asking = asking.withColumn("bounds", F.lit(None).cast("array<double>"))
    else:
        asking = asking.join(bounds.select("region", "bounds"), "region")
    told = regions.select(F.col("region").alias("other"), *[F.col(c).alias(f"o_{c}") for c in ("ats", "ws", "xs", "ends", "pivots", "tops")])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None  # the region that others pass by
        for batch in batches:
            for i in range(batch.num_rows):
                def values(column):
                    return np.asarray(batch[column][i].values)

                region = batch["region"][i].as_py()
                if now is None or now.region != region:
                    if now is not None:
                        yield from now.best()
                    limit = values("bounds") if batch["bounds"][i].is_valid else None
                    home = np.repeat(values("own_tops").reshape(-1, dims), np.diff(values("own_ends"), prepend=0), axis=0)
                    now = _Region(region, values("xs").reshape(-1, dims), home, values("ats"), limit, k)
                if batch["apart"][i].as_py() <= now.limit.max():
                    now.meet(values("o_xs").reshape(-1, dims), values("o_ats"), values("o_ws"), values("o_ends"),
                             values("o_pivots").reshape(-1, dims), values("o_tops").reshape(-1, dims))
        if now is not None:
            yield from now.best()

    # A region's rows come one after the other, those of the nearest others first.
    met = pairs.join(asking, "region").join(told, "other").select("apart", *asking.columns, *told.columns)
    # As many parts as regions, which Spark would merge by their bytes: the work is in comparing.
    passing = met.repartition(parts, "region").sortWithinPartitions("region", "apart", "other").drop("other")
    return passing.mapInArrow(compare, "region string, row int, at long, near long, dist double, w long")


class _Region:
    """Points of a region and the nearest others that they have met."""

    def __init__(self, region: str, x: np.ndarray, home: np.ndarray, ats: np.ndarray, limit: np.ndarray | None, k: int):
        self.region, self.x, self.home, self.ats, self.k = region, x, home, ats, k
        self.limit = np.full(len(x), np.inf) if limit is None else limit.copy()
        self.found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)]  # row, near, dist, w

    def meet(self, other, o_ats, o_ws, ends, centres, tops) -> None:
        row, col, dist = nearest_of(self.x, self.home, self.limit, self.ats, other, o_ats, o_ws, ends, centres, tops, self.k)
        if not len(row):
            return
        new = (row, o_ats[col], dist, o_ws[col] - (self.ats[row] == o_ats[col]))
        every = [np.concatenate(z) for z in zip(self.found, new)]
        order = np.lexsort((every[1], every[2], every[0]))
        every = [z[order] for z in every]
        place = np.arange(len(order)) - np.searchsorted(every[0], every[0])
        self.found = [z[place < self.k] for z in every]
        last = place == self.k - 1
        self.limit[every[0][last]] = np.minimum(self.limit[every[0][last]], every[2][last])

    def best(self) -> Iterator[pa.RecordBatch]:
        row, near, dist, w = self.found
        for a in range(0, len(row), 1 << 16):
            b = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_pydict({
                "region": pa.array([self.region] * len(row[b]), pa.string()), "row": pa.array(row[b], pa.int32()), "at": self.ats[row[b]],
                "near": near[b], "dist": dist[b], "w": w[b]})


def nearest_of(x, home, limit, ats, other, o_ats, o_ws, ends, centres, tops, k) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of the k nearest others of each row of ``x`` within its limit.

    ``home`` are the pivots of the rows' cells; ``ends``, ``centres`` and ``tops`` the leaves
    of ``other`` and the pivots of theirs. A point's other copies count as neighbours at
    distance 0, it itself does not. Equal distances come by name.
    """
    free = np.flatnonzero(~np.isfinite(limit))
    found = [_among(x, free[a : a + ROWS], limit, other, slice(0, len(other)), k) for a in range(0, len(free), ROWS)]
    bound = np.flatnonzero(np.isfinite(limit))
    if len(bound):
        near = _leaves_in_reach(x[bound], home[bound], limit[bound], other, ends, centres, tops)
        for leaf, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
            rows = bound[near[leaf]]
            if len(rows):
                found.append(_among(x, rows, limit, other, slice(a, b), None))
    row, col, dist = (np.concatenate(z) for z in zip(*found)) if found else (np.empty(0, np.int64),) * 3
    some = (ats[row] != o_ats[col]) | (o_ws[col] > 1)
    row, col, dist = row[some], col[some], dist[some]
    order = np.lexsort((o_ats[col], dist, row))
    row, col, dist = row[order], col[order], dist[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep], dist[keep]


def _leaves_in_reach(x, home, limit, other, ends, centres, tops) -> np.ndarray:
    """By leaf, which rows it may hold neighbours of."""
    starts = np.concatenate([[0], ends[:-1]])
    away = np.sqrt(((other - np.repeat(centres, ends - starts, axis=0)) ** 2).sum(axis=1))
    near, far = np.minimum.reduceat(away, starts), np.maximum.reduceat(away, starts)
    squares, slack = _squares(x, centres)
    reach = (limit * _NEAR + 1e-300)[:, None]
    possible = (squares - slack[:, None] <= (reach + far) ** 2 * _NEAR) & (squares + slack[:, None] >= np.maximum(near - reach, 0.0) ** 2 / _NEAR)
    # Points of a cell are no nearer to another pivot than to their own: beyond the plane
    # half way between two pivots, by (|x - theirs|^2 - |x - home|^2) / (2 |home - theirs|).
    own = ((x - home) ** 2).sum(axis=1)
    to, unsure = _squares(x, tops)
    pivots, which = np.unique(home, axis=0, return_inverse=True)
    apart = np.sqrt(np.maximum(_squares(pivots, tops)[0], 0.0)) * _NEAR + 1e-7 * np.sqrt(unsure.max(initial=0.0) / _MARGIN)
    possible &= to - unsure[:, None] - own[:, None] * _NEAR <= 2.0 * reach * apart[which.ravel()]
    return np.ascontiguousarray(possible.T)


def _among(x, rows, limit, other, part: slice, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of the rows with a part of the others, within the limits; with ``k``, not many beyond the k nearest."""
    a, b = x[rows], other[part]
    squares, slack = _squares(a, b)
    cut = limit[rows] ** 2 * _NEAR + slack
    if k is not None and k < len(b):  # itself may be one more
        cut = np.minimum(cut, np.partition(squares, k, axis=1)[:, k] + 2 * slack)
    i, j = np.nonzero(squares <= cut[:, None])
    total = np.zeros(len(i))
    for d in range(x.shape[1]):
        gap = a[i, d] - b[j, d]
        total += gap * gap
    dist = np.sqrt(total)
    fine = dist <= limit[rows[i]]
    return rows[i[fine]], j[fine] + part.start, dist[fine]


def _best(edges: DataFrame, k: int) -> DataFrame:
    """Nearest first, until ``k`` rows are counted; at most k per pair of regions come in."""
    order = Window.partitionBy("region", "row", "at").orderBy("dist", "near")
    before = F.coalesce(F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        edges.withColumn("_before", before)
        .where(F.col("_before") < k)
        .select("region", "row", "at", "near", "dist", F.least(F.col("w"), F.lit(k) - F.col("_before")).alias("w"))
    )
