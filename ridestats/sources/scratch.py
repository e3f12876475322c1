"""Intermediate tables in the shared folder of the cluster.

Small or often re-read intermediates are written as Parquet rather than cached:
the files outlive a lost executor, they cut the lineage, and Catalyst sees their
real size, so it broadcasts them only when they are in fact small. The shuffles behind
a written table are given up as soon as it is complete.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_DIR_KEY = "spark.checkpoint.dir"
_FREE_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN = "ridestats-scratch"
TASK_BYTES = 16 << 20  # that a task of :func:`small_tasks` reads
PARTITIONS = 2_000
_run = uuid.uuid4().hex  # tables of this process share a folder


def scratch_dir(spark: SparkSession) -> str:
    """Shared scratch folder named by ``spark.checkpoint.dir``.

    A session that runs in one process may go without the setting and uses a folder
    below its warehouse; on a cluster that folder may be the driver's own disk, so
    there the setting is needed.
    """
    configured = spark.conf.get(_DIR_KEY, None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
        raise RuntimeError(f"set {_DIR_KEY} to a folder all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{_OWN}"


def process_dir(spark: SparkSession) -> str:
    """The part of the scratch folder that belongs to this process; :func:`discard_staged` deletes it."""
    return f"{scratch_dir(spark)}/ridestats/{_run}"


@contextmanager
def _set(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _shuffles_freed(spark: SparkSession):
    """Files of a query's shuffles go when the query ends, not when the driver collects garbage."""
    return _set(spark, {_FREE_KEY: "true"})


def small_tasks(spark: SparkSession):
    """Jobs that run meanwhile give a task ``TASK_BYTES`` of files or of a shuffle at most, whatever the input's size.

    Tasks that join or sort wide rows hold many times what they read. AQE merges shuffle
    partitions up to that size, from enough of them for ``TASK_BYTES * PARTITIONS``.
    """
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _set(spark, {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TASK_BYTES),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(max(own, PARTITIONS)),
        "spark.sql.files.maxPartitionBytes": str(TASK_BYTES),
    })


def small_batches(spark: SparkSession, n_bytes: int):
    """Jobs that run meanwhile send Python workers about ``n_bytes`` at a time, or one row, however many rows that is."""
    return _set(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": str(n_bytes)})


def small_files(spark: SparkSession, rows: int):
    """Jobs that run meanwhile write ``rows`` rows, large ones, to a file at most."""
    return _set(spark, {"spark.sql.files.maxRecordsPerFile": str(rows)})


def single_files(spark: SparkSession):
    """Tasks that run meanwhile read one file, or a part of one: none is small enough to share a task."""
    return _set(spark, {"spark.sql.files.maxPartitionBytes": str(1 << 20), "spark.sql.files.openCostInBytes": str(1 << 20)})


def stage(df: DataFrame, label: str, *parts: str) -> DataFrame:
    """Write ``df`` once to the scratch folder and read it back; in folders by ``parts``, if any are named."""
    spark = df.sparkSession
    path = f"{process_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with _shuffles_freed(spark):
        df.write.partitionBy(*parts).parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def unstage(staged: DataFrame) -> None:
    """Delete one table that :func:`stage` returned; nothing may read it any more."""
    delete_folder(staged.sparkSession, staged.staged_at)


def discard_staged(spark: SparkSession) -> None:
    """Delete the tables that this process has staged; frames over them can no longer be read."""
    delete_folder(spark, process_dir(spark))


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder with all it holds, on whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
