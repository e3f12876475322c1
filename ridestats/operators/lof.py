"""Local outlier factor (Breunig et al. 2000) as joins over the neighbour edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import stage
from .neighbors import nearest_neighbors
from .quantiles import exact_quantiles

_EPS = 1e-10


def neighbor_count(n: int, most: int = 20) -> int:
    """A tenth of the rows, within 1 and ``most``."""
    return max(1, min(most, n // 10))


def local_outlier_factor(
    rows: DataFrame,
    key: str,
    features: Sequence[str],
    contamination: float = 0.1,
    k: int | None = None,
    **search: int,
) -> DataFrame:
    """``rows`` with ``lof`` and ``anomalia_lof`` (-1 outlier, 1 inlier).

    Rows at the same position share all their distances, so they are merged to
    one weighted point first: copies, however many, cost one point. ``key`` must
    be unique.
    """
    k = k or neighbor_count(rows.count())
    points = stage(
        rows.groupBy(*features)
        .agg(F.min(key).alias("pid"), F.count(F.lit(1)).alias("w"))
        .withColumn("x", F.array(*[F.col(f).cast("double") for f in features])),
        "points",
    )
    edges = stage(nearest_neighbors(points, k, **search), "edges")

    k_distance = edges.groupBy("pid").agg(F.max("dist").alias("kdist"))
    reach = edges.join(k_distance.withColumnRenamed("pid", "nbr"), "nbr").select(
        "pid", "w", F.greatest("kdist", "dist").alias("reach")
    )
    density = stage(
        reach.groupBy("pid").agg(
            (F.lit(1.0) / (F.sum(F.col("w") * F.col("reach")) / F.sum("w") + F.lit(_EPS))).alias("lrd")
        ),
        "density",
    )
    around = (
        edges.join(density.select(F.col("pid").alias("nbr"), F.col("lrd").alias("nbr_lrd")), "nbr")
        .groupBy("pid")
        .agg((F.sum(F.col("w") * F.col("nbr_lrd")) / F.sum("w")).alias("nbr_lrd"))
    )
    factor = around.join(density, "pid").select(
        "pid", F.round(F.col("nbr_lrd") / F.col("lrd"), 9).alias("lof")
    )
    scored = stage(rows.join(points.join(factor, "pid", "left").drop("pid", "w", "x"), list(features)), "lof")
    cut = exact_quantiles(scored.select((-F.col("lof")).alias("v")), ["v"], contamination)["v"]
    return scored.withColumn("anomalia_lof", outlier_label(-F.col("lof"), cut))


def outlier_label(score, cut: float | None):
    """-1 strictly below the cut, else 1."""
    return F.when(score < F.lit(cut).cast("double"), F.lit(-1)).otherwise(F.lit(1))
