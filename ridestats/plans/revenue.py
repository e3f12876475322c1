"""Revenue models: features, two tree ensembles, choice, scoring."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (
    GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.features import FEATURES, feature_matrix
from ..functions.hashing import milli
from ..functions.pricing import EXCESS_RATE, INCLUDED_MINUTES, theoretical_revenue
from ..operators.ranking import sorted_codes
from ..operators.regression import regression_metrics
from ..operators.sampling import seeded_sample, stratified_split
from ..sources.scratch import stage
from ..sources.star import require_columns

TARGET = "ingreso_min_excedente"
FOREST, BOOSTING = "RandomForest", "GradientBoosting"
SEED = 42
_ROWS_PER_PART, _LEAST_PARTS = 100_000, 8  # layout of the training rows
APPARENT_GAP = 2.0  # fixed value: assumed apparent minus actual temperature of a request


@dataclass(frozen=True)
class RevenueModels:
    """Both fitted ensembles, the station codes, the metrics and the choice."""

    forest: RandomForestRegressionModel
    boosting: GBTRegressionModel
    codes: DataFrame
    metrics: DataFrame
    best: str

    @property
    def model(self):
        return self.forest if self.best == FOREST else self.boosting


def trip_key() -> list[Column]:
    """What determines a training row; all its other columns depend on these."""
    return [F.col("station_id"), F.col("time_id"), F.col("bike_type_id"), milli(F.col("duracion_minutos"))]


def station_codes(training: DataFrame) -> DataFrame:
    """``(station_id, station_id_encoded)``: 0-based rank of the sorted ids.

    Written as a table: joins to it broadcast it by its known size.
    """
    return stage(sorted_codes(training, "station_id", "station_id_encoded"), "station-codes")


def features(rides: DataFrame, codes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Feature columns; a station without a code gets 0, in its own rows only."""
    return feature_matrix(rides.join(codes, "station_id", "left"), keep)


def assembled(matrix: DataFrame) -> DataFrame:
    """The feature columns as the vector that the models read."""
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(matrix)


def train(
    training: DataFrame,
    max_rows: int | None = None,
    seed: int = SEED,
    trees: int = 50,
    rounds: int = 50,
    staged: bool = False,
) -> RevenueModels:
    """Fit both ensembles on 80% of the rows and measure them on the rest.

    All rows are used unless ``max_rows`` asks for a seeded sample. A leaf holds
    at least 10 rows, so no node under 20 rows is split. The rows are written first,
    unless they are a table already (``staged``).
    """
    require_columns(training, [TARGET, "station_id", "time_id"], "training set")
    rides = training if max_rows is None else seeded_sample(training, max_rows, trip_key(), seed)
    rides = rides if staged and max_rows is None else stage(rides, "rides")
    codes = station_codes(rides)
    split = stratified_split(rides, F.col(TARGET) > 0, trip_key(), seed=seed)
    matrix = features(split, codes, keep=(TARGET, "is_test", "station_id", "time_id"))
    place = F.xxhash64(*matrix.columns).alias("place")
    ready = stage(assembled(matrix).select("features", TARGET, "is_test", place), "assembled")
    fit, held_out = _laid_out(ready.where(~F.col("is_test"))), ready.where("is_test")

    ensembles = [
        RandomForestRegressor(
            labelCol=TARGET, numTrees=trees, maxDepth=10, minInstancesPerNode=10,
            featureSubsetStrategy="sqrt", maxBins=64, seed=seed, predictionCol="forest_prediction", maxMemoryInMB=1024,
        ),
        GBTRegressor(
            labelCol=TARGET, maxIter=rounds, maxDepth=5, stepSize=0.15, subsamplingRate=0.8,
            featureSubsetStrategy="sqrt", maxBins=64, seed=seed, predictionCol="boosting_prediction",
        ),
    ]
    # Two independent fits: their jobs share the cluster.
    with ThreadPoolExecutor(2) as pool:
        forest, boosting = pool.map(inheritable_thread_target(fit.sparkSession)(lambda e: e.fit(fit)), ensembles)

    scored = boosting.transform(forest.transform(held_out))
    both = scored.select(
        TARGET,
        F.explode(
            F.create_map(
                F.lit(FOREST), F.col("forest_prediction"), F.lit(BOOSTING), F.col("boosting_prediction")
            )
        ).alias("model", "prediction"),
    )
    metrics = stage(regression_metrics(both, TARGET, "prediction", by=("model",)), "metrics")
    return RevenueModels(forest, boosting, codes, metrics, choose(metrics))


def _laid_out(rows: DataFrame) -> DataFrame:
    """Rows in an order that is theirs alone.

    The ensembles draw rows by partition and place. Partitions by a hash of the row,
    as many as the number of rows asks for, and sorted within, make the fit the
    same for any input files, cores or partitions.
    """
    parts = max(_LEAST_PARTS, -(-rows.count() // _ROWS_PER_PART))
    return rows.repartition(parts, "place").sortWithinPartitions("place")


def choose(metrics: DataFrame) -> str:
    """The forest only when its R2 is strictly greater."""
    r2 = {r["model"]: r["r2"] for r in metrics.collect()}
    forest, boosting = r2.get(FOREST), r2.get(BOOSTING)
    return FOREST if forest is not None and boosting is not None and forest > boosting else BOOSTING


def requests_from(rides: DataFrame) -> DataFrame:
    """Scoring requests in the request layout, one per ride."""
    return rides.select(
        "station_id", "hour", "is_weekend", "month",
        F.col("temperature_2m").alias("temperature"),
        F.col("relative_humidity_2m").alias("humidity"),
        F.col("bike_type_id").alias("bike_type"),
        F.col("duracion_minutos").alias("duration"),
        "day_name",
    )


def score(requests: DataFrame, models: RevenueModels) -> DataFrame:
    """Requests with ``prediction`` (not below 0), tariff revenue and the gap.

    ``day_name`` may be absent and is then Monday.
    """
    require_columns(
        requests,
        ["station_id", "hour", "is_weekend", "month", "temperature", "humidity", "bike_type", "duration"],
        "requests",
    )
    day = F.coalesce("day_name", F.lit("Monday")) if "day_name" in requests.columns else F.lit("Monday")
    carried = requests.withColumn("day_name", day)
    rides = (
        carried.withColumn("temperature_2m", F.col("temperature").cast("double"))
        .withColumn("apparent_temperature", F.col("temperature_2m") + F.lit(APPARENT_GAP))
        .withColumn("relative_humidity_2m", F.col("humidity"))
        .withColumn("bike_type_id", F.col("bike_type"))
        .withColumn("duracion_minutos", F.col("duration").cast("double"))
        .withColumn("minutos_incluidos", F.lit(INCLUDED_MINUTES))
        .withColumn("request", F.struct(*carried.columns))
    )
    predicted = models.model.transform(assembled(features(rides, models.codes, keep=("request",))))
    raw = F.col(models.model.getPredictionCol())
    return (
        predicted.select("request.*", F.greatest(F.lit(0.0), raw).alias("prediction"))
        .withColumn("theoretical_revenue", theoretical_revenue(F.col("duration")))
        .withColumn("model_difference", F.col("prediction") - F.col("theoretical_revenue"))
    )


def tariff_score(requests: DataFrame) -> DataFrame:
    """Same layout as ``score`` with the standard tariff in place of a model."""
    return requests.withColumn("prediction", theoretical_revenue(F.col("duration"), rate=EXCESS_RATE))


def feature_importance(models: RevenueModels, top: int = 15) -> DataFrame:
    """The ``top`` features of the chosen model, least important first."""
    spark = models.codes.sparkSession
    weights = zip(FEATURES, models.model.featureImportances.toArray().tolist())
    table = spark.createDataFrame(list(weights), "feature string, importance double")
    best = table.orderBy(F.desc("importance"), "feature").limit(top)
    return best.orderBy("importance", F.desc("feature"))
