"""Saved models: Spark ML folders and Parquet tables, one folder per save.

Every save writes a version folder of its own and then adds one row to a small index;
a load reads the version that the last row names. A save that breaks off leaves the
version before it in place, and a loaded model can be saved where it came from.
Older versions stay until the folder is cleaned up.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import SparkSession, functions as F

from ..operators.iforest import Forest
from .anomalies import FEATURES, SCALED, AnomalyModel, Scaler
from .revenue import RevenueModels


@dataclass(frozen=True)
class Saved:
    """What a folder holds; a kind that was never saved is None."""

    revenue: RevenueModels | None
    anomalies: AnomalyModel | None


def save(folder: str, revenue: RevenueModels | None = None, anomalies: AnomalyModel | None = None) -> None:
    """Save either kind or both below one folder."""
    if revenue is not None:
        save_revenue(revenue, f"{folder}/revenue")
    if anomalies is not None:
        save_anomalies(anomalies, f"{folder}/anomalies")


def load(spark: SparkSession, folder: str) -> Saved:
    """Whatever kinds of models were saved below the folder."""

    def kind(name, read):
        return read(spark, f"{folder}/{name}") if _current(spark, f"{folder}/{name}") else None

    return Saved(kind("revenue", load_revenue), kind("anomalies", load_anomalies))


def _current(spark: SparkSession, folder: str) -> str | None:
    """The folder of the last complete save."""
    try:
        last = spark.read.schema("stamp bigint, version string").parquet(f"{folder}/index").orderBy(F.desc("stamp")).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return f"{folder}/{last['version']}" if last else None


def _loadable(spark: SparkSession, folder: str) -> str:
    current = _current(spark, folder)
    if current is None:
        raise FileNotFoundError(f"no model was saved in {folder}")
    return current


def _publish(spark: SparkSession, folder: str, version: str) -> None:
    row = spark.createDataFrame([(time.time_ns(), version)], "stamp bigint, version string")
    row.coalesce(1).write.mode("append").parquet(f"{folder}/index")


def save_revenue(models: RevenueModels, folder: str) -> None:
    version = f"version-{uuid.uuid4().hex}"
    place, spark = f"{folder}/{version}", models.codes.sparkSession
    models.forest.write().save(f"{place}/forest")
    models.boosting.write().save(f"{place}/boosting")
    models.codes.write.parquet(f"{place}/station_codes")
    models.metrics.withColumn("best", F.col("model") == models.best).write.parquet(f"{place}/metrics")
    _publish(spark, folder, version)


def load_revenue(spark: SparkSession, folder: str) -> RevenueModels:
    place = _loadable(spark, folder)
    metrics = spark.read.parquet(f"{place}/metrics")
    best = metrics.where("best").first()["model"]
    return RevenueModels(
        RandomForestRegressionModel.load(f"{place}/forest"),
        GBTRegressionModel.load(f"{place}/boosting"),
        spark.read.parquet(f"{place}/station_codes"),
        metrics.drop("best"),
        best,
    )


def save_anomalies(model: AnomalyModel, folder: str) -> None:
    version = f"version-{uuid.uuid4().hex}"
    place, spark, scaler = f"{folder}/{version}", model.flagged.sparkSession, model.scaler
    scaling = [(f, scaler.medians.get(f), scaler.means[f], scaler.spreads[f]) for f in FEATURES]
    spark.createDataFrame(
        scaling, "feature string, median double, mean double, spread double"
    ).write.parquet(f"{place}/scaler")
    spark.createDataFrame(
        [(model.forest.trees, model.forest.sample, model.cut)], "trees int, sample int, cut double"
    ).write.parquet(f"{place}/forest_parameters")
    model.forest.nodes.write.parquet(f"{place}/forest_nodes")
    model.flagged.write.parquet(f"{place}/flagged")
    _publish(spark, folder, version)


def load_anomalies(spark: SparkSession, folder: str) -> AnomalyModel:
    place = _loadable(spark, folder)
    scaling = {r["feature"]: r for r in spark.read.parquet(f"{place}/scaler").collect()}
    trees, sample, cut = spark.read.parquet(f"{place}/forest_parameters").first()
    scaler = Scaler(
        {f: r["median"] for f, r in scaling.items()},
        {f: r["mean"] for f, r in scaling.items()},
        {f: r["spread"] for f, r in scaling.items()},
    )
    forest = Forest(spark.read.parquet(f"{place}/forest_nodes"), tuple(SCALED), trees, sample)
    return AnomalyModel(scaler, forest, cut, spark.read.parquet(f"{place}/flagged"))
