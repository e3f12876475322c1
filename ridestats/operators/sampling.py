"""Seeded sampling and splitting by hash order of a business key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import digest, key_text, uniform
from .expand import repeat_rows

_PREFIX = 4          # hex digits per refinement: 65,536 buckets
_FEW = 100_000       # distinct hashes that one window partition may hold
_HASH, _STRATUM = "_hash", "_stratum"


def take_by_hash(
    df: DataFrame,
    quotas: dict[object, int],
    key: Sequence[Column],
    seed: int = 42,
    stratum: Column | None = None,
    flag: str = "taken",
    few: int = _FEW,
) -> DataFrame:
    """Flag exactly ``quotas[s]`` rows of each stratum, lowest key hash first.

    The hash at which the quota runs out is found from bucket counts, so rows
    are not sorted or gathered. Rows with exactly that hash are copies of each
    other; they are counted, and handed out as copies on either side.
    ``key`` should determine the row. Strata are few (they sit in the plan).
    """
    hashed = df.withColumn(_HASH, digest(key_text(key), seed)).withColumn(
        _STRATUM, stratum if stratum is not None else F.lit(0)
    )
    edges = _edges(hashed, quotas, few)

    below = F.lit(False)
    at_edge = F.lit(False)
    share: Column = F.lit(0)
    for s, (edge, left) in edges.items():
        in_stratum = F.col(_STRATUM) == F.lit(s)
        if edge is None:
            below = below | in_stratum
            continue
        below = below | (in_stratum & (F.col(_HASH) < F.lit(edge)))
        at_edge = at_edge | (in_stratum & (F.col(_HASH) == F.lit(edge)))
        share = F.when(in_stratum, F.lit(left)).otherwise(share)

    at_edge = F.coalesce(at_edge, F.lit(False))
    clear = hashed.where(~at_edge).withColumn(flag, F.coalesce(below, F.lit(False)))
    copies = hashed.where(at_edge).groupBy(*hashed.columns).agg(F.count(F.lit(1)).alias("_n"))
    # The quota runs out among these copies. Should rows of one key differ after
    # all, they are served in column order; the window sees one row per content.
    order = Window.partitionBy(_STRATUM).orderBy(*df.columns)
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = copies.withColumn("_served", F.greatest(F.lit(0), F.least(F.col("_n"), share - before)))
    sides = F.array(
        F.struct(F.lit(True).alias("in"), F.col("_served").alias("n")),
        F.struct(F.lit(False).alias("in"), (F.col("_n") - F.col("_served")).alias("n")),
    )
    parted = counted.withColumn("_side", F.explode(sides)).withColumn(flag, F.col("_side.in"))
    handed = repeat_rows(parted, F.col("_side.n"), "_copy").drop("_n", "_served", "_side", "_copy")
    return clear.unionByName(handed).drop(_HASH, _STRATUM)


def _edges(
    hashed: DataFrame, quotas: dict[object, int], few: int
) -> dict[object, tuple[str | None, int]]:
    """Per stratum: the hash at which the quota is used up (None: never), and
    how many of the rows with that hash still fit.

    One pass counts hash prefixes; a second one counts whole hashes under the
    prefix that was hit. Prefixes grow step by step only while too many hashes
    remain under them.
    """
    edges: dict[object, tuple[str | None, int]] = {s: ("", q) for s, q in quotas.items()}
    digits = _PREFIX
    while True:
        open_ = {s: e for s, e in edges.items() if e[0] is not None}
        wanted, quota = F.lit(False), F.lit(None).cast("bigint")
        for s, (prefix, left) in open_.items():
            here = F.col(_STRATUM) == F.lit(s)
            wanted = wanted | (here & F.col(_HASH).startswith(prefix) if prefix else here)
            quota = F.when(here, F.lit(left)).otherwise(quota)
        counts = (
            hashed.where(wanted)
            .groupBy(_STRATUM, F.substring(_HASH, 1, digits).alias("_b"))
            .agg(F.count(F.lit(1)).alias("_n"))
        )
        # At most 65,536 prefixes or ``few`` hashes per stratum reach the window.
        order = Window.partitionBy(_STRATUM).orderBy("_b")
        hit = (
            counts.withColumn("_upto", F.sum("_n").over(order))
            .where((F.col("_upto") > quota) & (F.col("_upto") - F.col("_n") <= quota))
            .collect()
        )
        found = {r[_STRATUM]: r for r in hit}
        for s, (_, left) in open_.items():
            row = found.get(s)
            edges[s] = (row["_b"], left - (row["_upto"] - row["_n"])) if row else (None, 0)
        if digits == 32 or not found:
            return edges
        digits = 32 if all(r["_n"] <= few for r in hit) else digits + _PREFIX


def seeded_sample(
    df: DataFrame, n: int, key: Sequence[Column], seed: int = 42
) -> DataFrame:
    """``n`` rows (all, if there are fewer), the same for the same seed."""
    return take_by_hash(df, {0: n}, key, seed, flag="_in").where("_in").drop("_in")


def stratified_split(
    df: DataFrame,
    positive: Column,
    key: Sequence[Column],
    test_share: float = 0.2,
    seed: int = 42,
    exact: bool = True,
    flag: str = "is_test",
) -> DataFrame:
    """Flag the hold-out rows, with the same share of both strata.

    ``exact=False`` decides row by row without a counting pass; the shares then
    hold in expectation only.
    """
    if not exact:
        return df.withColumn(flag, uniform(key_text(key), seed) < F.lit(test_share))
    positive = F.coalesce(positive, F.lit(False))
    sizes = {r["s"]: r["count"] for r in df.groupBy(positive.alias("s")).count().collect()}
    return take_by_hash(df, _allocate(sizes, test_share), key, seed, positive, flag)


def _allocate(sizes: dict[bool, int], share: float) -> dict[bool, int]:
    """Hold-out rows per stratum, largest remainder first, larger stratum on ties."""
    total = sum(sizes.values())
    wanted = math.ceil(share * total)
    ideal = {s: wanted * n / total for s, n in sizes.items()}
    quota = {s: math.floor(v) for s, v in ideal.items()}
    for s in sorted(sizes, key=lambda s: (quota[s] - ideal[s], -sizes[s])):
        if sum(quota.values()) < wanted:
            quota[s] += 1
    return quota
