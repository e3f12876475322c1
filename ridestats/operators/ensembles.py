"""Fitted tree ensembles as node tables, and predictions computed from them by expressions.

The table has a row per node: what a model holds, in a form that joins, exports and other
engines can use. Predictions walk it level by level inside one expression per row, on the
executors' JVMs; the table, bounded by trees and depth, comes along as a scalar subquery.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.scratch import process_dir, stage

LEAF = -1
NODES = "tree int, node int, feature int, threshold double, left int, right int, value double, weight double"


def node_table(spark: SparkSession, model, label: str) -> DataFrame:
    """(tree, node, feature, threshold, left, right, value, weight) of an ensemble of regression trees.

    ``left`` is followed where the feature is at most the threshold; leaves have -1 as
    feature and children. The prediction is the sum over trees of weight times the leaf's
    value. Categorical splits are refused.
    """
    path = f"{process_dir(spark)}/model-{label}-{model.uid}"
    model.write().overwrite().save(path)
    saved = spark.read.parquet(f"{path}/data")
    node = "nodeData" if "nodeData" in saved.columns else None
    fields = saved.select("treeID", f"{node}.*") if node else saved
    if not fields.where("leftChild >= 0 and split.numCategories >= 0").isEmpty():
        raise ValueError("categorical splits are not supported")
    weights = list(model.treeWeights)
    if not hasattr(model, "getMaxIter"):  # a forest averages, boosting adds up
        weights = [w / sum(weights) for w in weights]
    shares = F.array(*[F.lit(float(w)) for w in weights])
    inner = F.col("leftChild") >= 0
    return stage(
        fields.select(
            F.col("treeID").cast("int").alias("tree"), F.col("id").cast("int").alias("node"),
            F.when(inner, F.col("split.featureIndex")).otherwise(LEAF).cast("int").alias("feature"),
            F.when(inner, F.try_element_at("split.leftCategoriesOrThreshold", F.lit(1))).alias("threshold"),
            F.when(inner, F.col("leftChild")).otherwise(LEAF).cast("int").alias("left"),
            F.when(inner, F.col("rightChild")).otherwise(LEAF).cast("int").alias("right"),
            F.col("prediction").alias("value"), F.element_at(shares, F.col("treeID").cast("int") + 1).alias("weight"),
        ),
        f"nodes-{label}",
    )


def depth(nodes: DataFrame) -> int:
    """Levels below the roots, found by following children."""
    at, levels = nodes.where("node = 0").select("tree", "node"), 0
    children = nodes.where("left >= 0").select("tree", "node", F.explode(F.array("left", "right")).alias("child"))
    while True:
        at = stage(at.join(children, ["tree", "node"]).select("tree", F.col("child").alias("node")), "level")
        if at.isEmpty():
            return levels
        levels += 1


def predict(rows: DataFrame, nodes: DataFrame, levels: int, features: str = "features", column: str = "walked") -> DataFrame:
    """``rows`` with the ensemble's prediction for a feature vector, from its node table.

    All trees are walked at once, a level per join of (tree, node) with the table; these
    joins stay with the rows while the table is small enough to be broadcast, and the
    leaves' values of a row meet in the task that walked it.
    """
    numbered = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "walkers")
    trees = nodes.agg(F.coalesce(F.max("tree"), F.lit(-1))).first()[0] + 1
    at = numbered.select(
        "_row", vector_to_array(features).alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(0).alias("node")
    )
    inner = nodes.where("left >= 0").select("tree", "node", "feature", "threshold", "left", "right")
    goes_left = F.element_at("_x", F.col("feature") + 1) <= F.col("threshold")
    child = F.when(F.col("feature").isNull(), F.col("node")).when(goes_left, F.col("left")).otherwise(F.col("right"))
    for _ in range(levels):
        at = at.join(inner, ["tree", "node"], "left").select("_row", "_x", "tree", child.alias("node"))
    leaves = nodes.select("tree", "node", (F.col("value") * F.col("weight")).alias("share"))
    walked = at.join(leaves, ["tree", "node"]).groupBy("_row").agg(F.sum("share").alias(column))
    return numbered.join(walked, "_row").drop("_row")
