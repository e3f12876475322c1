"""Anomalous station-hours: preparation, two detectors, consensus, reports."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import key_text
from ..functions.numeric import finite
from ..operators.iforest import Forest, fit_forest, forest_score
from ..operators.lof import local_outlier_factor, outlier_label
from ..operators.quantiles import exact_quantiles
from ..operators.sampling import seeded_sample
from ..sources.scratch import stage
from ..sources.star import require_columns

# Detector features in order, share of outliers, seed.
FEATURES = [
    "hour", "is_weekend", "month", "viajes_count", "ingreso_promedio", "duracion_promedio",
    "temperatura_promedio", "variabilidad_ingresos", "viajes_con_excedente",
]
SCALED = [f"z_{f}" for f in FEATURES]
KEY = ["station_id", "hour", "is_weekend", "month"]
CONTAMINATION = 0.1
SEED = 42


@dataclass(frozen=True)
class Scaler:
    """Median fill and standardisation, as fitted."""

    medians: dict[str, float | None]
    means: dict[str, float]
    spreads: dict[str, float]


@dataclass(frozen=True)
class AnomalyModel:
    """Everything needed to judge new station-hours, and the judged fit rows."""

    scaler: Scaler
    forest: Forest
    cut: float | None
    flagged: DataFrame


def row_key():
    return key_text([F.col("station_id"), F.col("hour"), F.col("is_weekend").cast("int"), F.col("month")])


def clean_features(
    profile: DataFrame, medians: dict[str, float | None] | None = None, drop: bool = True
) -> DataFrame:
    """Features as doubles: no infinities, missing numbers at the median.

    The weekend flag is not filled; a row without it, or with a feature that has
    no value anywhere, is dropped unless ``drop`` is unset.
    """
    require_columns(profile, FEATURES, "station-hour profile")
    others = [F.col(c) for c in profile.columns if c not in FEATURES]
    numbers = profile.select(
        *others, *[finite(F.col(f).cast("int") if f == "is_weekend" else F.col(f)).alias(f) for f in FEATURES]
    )
    if medians is None:
        medians = feature_medians(numbers)
    filled = numbers.select(
        *others,
        *[F.coalesce(F.col(f), F.lit(medians.get(f)).cast("double")).alias(f) for f in FEATURES],
    )
    return filled.dropna(subset=FEATURES) if drop else filled


def feature_medians(numbers: DataFrame) -> dict[str, float | None]:
    return exact_quantiles(numbers, [f for f in FEATURES if f != "is_weekend"], 0.5)


def fit_scaler(profile: DataFrame) -> tuple[Scaler, DataFrame]:
    """Scaler of a profile, and the profile cleaned with it."""
    numbers = profile.select(*[finite(F.col(f).cast("int") if f == "is_weekend" else F.col(f)).alias(f) for f in FEATURES])
    medians = feature_medians(numbers)
    cleaned = clean_features(profile, medians)
    row = cleaned.agg(
        *[F.avg(f).alias(f"m_{f}") for f in FEATURES], *[F.stddev_pop(f).alias(f"s_{f}") for f in FEATURES]
    ).first()
    means = {f: row[f"m_{f}"] for f in FEATURES}
    spreads = {f: row[f"s_{f}"] or 1.0 for f in FEATURES}
    return Scaler(medians, means, spreads), cleaned


def scale(cleaned: DataFrame, scaler: Scaler) -> DataFrame:
    """Adds ``z_*``: distance from the mean in population standard deviations."""
    scaled = [
        (F.round((F.col(f) - F.lit(scaler.means[f])) / F.lit(scaler.spreads[f]), 9) + F.lit(0.0)).alias(f"z_{f}")
        for f in FEATURES
    ]
    return cleaned.select("*", *scaled)


def fit(
    profile: DataFrame,
    max_rows: int | None = None,
    seed: int = SEED,
    contamination: float = CONTAMINATION,
    trees: int = 50,
    max_samples: int = 1_000,
    staged: bool = False,
) -> AnomalyModel:
    """Run both detectors over a profile (all its rows unless ``max_rows`` is given).

    The profile is written first, unless it is a table already (``staged``).
    """
    rows = profile if staged else stage(profile, "profile")
    if max_rows is not None:
        rows = seeded_sample(rows, max_rows, [row_key()], seed)
    scaler, cleaned = fit_scaler(rows)
    ready = stage(scale(cleaned.withColumn("row_key", row_key_of_clean()), scaler), "scaled")
    if ready.groupBy("row_key").count().where(F.col("count") > 1).limit(1).count():
        raise ValueError("a station, hour, weekend flag and month must name one row of the profile")

    def isolate() -> tuple[Forest, float | None]:
        grown = fit_forest(ready, "row_key", SCALED, trees, max_samples, seed)
        forest = Forest(stage(grown.nodes, "forest"), grown.features, grown.trees, grown.sample)
        scores = stage(ready.select(forest_score(forest).alias("score")), "forest-scores")
        return forest, exact_quantiles(scores, ["score"], contamination)["score"]

    def neighbors() -> DataFrame:
        return local_outlier_factor(ready, "row_key", SCALED, contamination)

    # Two independent detectors: their jobs share the cluster.
    with ThreadPoolExecutor(2) as pool:
        (forest, cut), judged = pool.map(
            inheritable_thread_target(ready.sparkSession)(lambda detect: detect()), [isolate, neighbors]
        )
    flagged = (
        judged.withColumn("score", forest_score(forest))
        .withColumn("score_iso", _decision("score", cut))
        .withColumn("anomalia_iso", outlier_label(F.col("score"), cut))
        .drop("score", *SCALED)
    )
    return AnomalyModel(scaler, forest, cut, stage(flagged, "flagged"))


def row_key_of_clean():
    """``row_key`` once the key columns are doubles."""
    return key_text([F.col("station_id"), *[F.col(c).cast("int") for c in KEY[1:]]])


def _decision(score: str, cut: float | None):
    return F.col(score) - F.lit(cut).cast("double")


def score(station_hours: DataFrame, model: AnomalyModel) -> DataFrame:
    """Flag and score of station-hours that were not in the fit.

    Every row is returned; one that cannot be judged (no weekend flag) has NULL for both.
    """
    cleaned = clean_features(station_hours, model.scaler.medians, drop=False)
    complete = reduce(and_, [F.col(f).isNotNull() for f in FEATURES])
    scaled = scale(cleaned, model.scaler).withColumn("score", F.when(complete, forest_score(model.forest)))
    return (
        scaled.withColumn("anomaly_score", _decision("score", model.cut))
        .withColumn("is_anomaly", F.col("score") < F.lit(model.cut))
        .drop("score", *SCALED)
    )


def consensus(flagged: DataFrame) -> DataFrame:
    """Rows that both detectors call outliers."""
    return flagged.where((F.col("anomalia_iso") == -1) & (F.col("anomalia_lof") == -1))


def normal(flagged: DataFrame) -> DataFrame:
    """Rows that neither detector calls an outlier."""
    return flagged.where((F.col("anomalia_iso") == 1) & (F.col("anomalia_lof") == 1))


def stats(flagged: DataFrame) -> DataFrame:
    iso, lof = F.col("anomalia_iso") == -1, F.col("anomalia_lof") == -1
    both = F.count_if(iso & lof)
    return flagged.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(iso).alias("num_anomalias_iso"),
        F.count_if(lof).alias("num_anomalias_lof"),
        both.alias("num_anomalies"),
        F.try_divide(both * 100.0, F.count(F.lit(1))).alias("anomaly_rate"),
    )


def top(flagged: DataFrame, n: int = 20) -> DataFrame:
    """Consensus anomalies with the highest mean revenue."""
    order: Sequence = [F.desc_nulls_last("ingreso_promedio"), *KEY]
    return consensus(flagged).orderBy(*order).limit(n)


def by_hour(flagged: DataFrame) -> DataFrame:
    """Consensus anomalies for each of the 24 hours."""
    counts = (
        consensus(flagged).groupBy(F.col("hour").cast("int").alias("hour"))
        .agg(F.count(F.lit(1)).alias("anomalies"))
    )
    hours = flagged.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(counts, "hour", "left").fillna(0, ["anomalies"])


def scatter(flagged: DataFrame, n: int = 500, seed: int = SEED) -> DataFrame:
    """Mean revenue against trips: up to ``n`` normal points and all anomalies."""

    def points(rows: DataFrame, kind: str) -> DataFrame:
        return rows.select(
            "row_key", F.col("ingreso_promedio").alias("x"), F.col("viajes_count").alias("y"), F.lit(kind).alias("type")
        )

    usual = seeded_sample(normal(flagged), n, [F.col("row_key")], seed)
    return points(usual, "normal").unionByName(points(consensus(flagged), "anomaly"))


def kpis_with_anomalies(
    kpis: DataFrame, flagged: DataFrame, estimated_loss: DataFrame | None = None
) -> DataFrame:
    """The KPI row with the anomaly figures and, if given, the estimated loss.

    ``estimated_loss`` is a one-row frame with the loss as its only column.
    """
    found = stats(flagged)
    combined = kpis.select(
        "*",
        found.select("num_anomalies").scalar().alias("anomalias_detectadas"),
        found.select("anomaly_rate").scalar().alias("porcentaje_anomalias"),
    )
    if estimated_loss is not None:
        combined = combined.select("*", estimated_loss.scalar().alias("perdidas_estimadas"))
    return combined
