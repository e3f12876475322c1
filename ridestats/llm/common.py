"""What the queries of this package share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_of(name: str) -> bytes:
    """Content of a public vocabulary file; read by the driver and sent along, tasks need no file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()
