"""The ride star schema: two facts, four dimensions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .scratch import stage

# Column names and types of the star schema.
STAR: dict[str, dict[str, str]] = {
    "trips": {
        "start_station_id": "string",
        "end_station_id": "string",
        "start_time_id": "bigint",
        "member_type_id": "int",
        "bike_type_id": "int",
        "duracion_minutos": "double",
    },
    "dim_time": {
        "time_id": "bigint",
        "hour": "int",
        "day_name": "string",
        "is_weekend": "boolean",
        "month": "int",
        "year": "int",
    },
    "weather": {
        "time_id": "bigint",
        "temperature_2m": "double",
        "apparent_temperature": "double",
        "relative_humidity_2m": "double",
    },
    "dim_member_type": {"member_type_id": "int", "member_casual": "string"},
    "dim_tarifa": {
        "member_type_id": "int",
        "bike_type_id": "int",
        "minutos_incluidos": "int",
        "tarifa_minuto_excedente": "double",
    },
    "balance_event": {
        "station_id": "string",
        "time_id": "bigint",
        "balance_net": "double",
        "tipo_evento_balance": "string",
        "flag_evento_critico": "boolean",
    },
}

DIM_KEYS: dict[str, tuple[str, ...]] = {
    "dim_time": ("time_id",),
    "weather": ("time_id",),
    "dim_member_type": ("member_type_id",),
    "dim_tarifa": ("member_type_id", "bike_type_id"),
}


def require_columns(df: DataFrame, columns: Iterable[str], what: str) -> None:
    """Raise when ``df`` lacks a column; names compare case-insensitively."""
    present = {c.lower() for c in df.columns}
    missing = [c for c in columns if c.lower() not in present]
    if missing:
        raise ValueError(f"{what} lacks column(s) {', '.join(missing)}")


def _typed(df: DataFrame, name: str, dtype: str) -> Column:
    # Measures that do not parse become NULL; a key that does not parse is an error.
    if dict(df.dtypes).get(name) == dtype:
        return F.col(name)
    column = F.col(name).try_cast(dtype) if dtype == "double" else F.col(name).cast(dtype)
    return column.alias(name)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project one table to the declared columns and types."""
    require_columns(df, STAR[table], table)
    lowered = df.toDF(*[c.lower() for c in df.columns])
    return lowered.select(*[_typed(lowered, c, t) for c, t in STAR[table].items()])


def load_star(
    spark: SparkSession,
    source: str | None = None,
    fmt: str = "parquet",
    names: Mapping[str, str] | None = None,
    options: Mapping[str, str] | None = None,
    table_options: Mapping[str, Mapping[str, str]] | None = None,
    parts: Mapping[str, tuple[str, int]] | None = None,
) -> dict[str, DataFrame]:
    """Read the six tables; errors propagate.

    ``fmt``      ``table`` (catalog; ``source`` is the database), ``jdbc``
                 (``options`` carries url, driver and the partitioning of the
                 read) or any file format (``source`` is the folder).
    ``names``    physical name per logical name, where they differ.
    ``table_options``  further options per logical name: how a fact table is read in
                 parts (``partitionColumn``, ``lowerBound``, ``upperBound``,
                 ``numPartitions``) is no option of the dimensions.
    ``parts``    key column and number of parts per logical name: a table over JDBC is
                 read by conditions on its key that a query over the key finds first.

    Dimensions that come over JDBC are copied to the scratch folder once: Catalyst
    cannot know the size of a remote table, and joining on a member type or a
    tariff must not shuffle the trips to a handful of keys.
    """
    names, common = dict(names or {}), dict(options or {})

    def read(table: str) -> DataFrame:
        physical = names.get(table, table)
        options = {**common, **(table_options or {}).get(table, {})}
        if fmt == "table":
            return spark.table(f"{source}.{physical}" if source else physical)
        if fmt == "jdbc":
            if table in (parts or {}):
                column, number = parts[table]
                counts = f"(select {column} as k, count(*) as n from {physical} group by {column}) keys"
                keys = spark.read.format("jdbc").options(**options, dbtable=counts).load()
                url, rest = options["url"], {k: v for k, v in options.items() if k != "url"}
                return spark.read.jdbc(url, physical, predicates=key_ranges(keys, column, number), properties=rest)
            return spark.read.format("jdbc").options(**options, dbtable=physical).load()
        return spark.read.format(fmt).options(**options).load(f"{source}/{physical}")

    star = {table: conform(read(table), table) for table in STAR}
    if fmt == "jdbc":
        star.update({table: stage(star[table], table) for table in DIM_KEYS})
    return star


def key_ranges(keys: DataFrame, column: str, parts: int) -> list[str]:
    """SQL conditions on a whole-number key that cut a table into about equal parts.

    ``keys`` (k, n) says how many rows each key has. Every row meets one condition, NULL
    keys that of the last. A key with more rows than a part should have is a part of its
    own; no condition on the key can cut it further. Running sums say where parts end:
    keys are range-sorted by Spark, and only sums and ends of parts meet.
    """
    if parts < 1:
        raise ValueError("at least one part is needed")
    named = keys.toDF("k", "n").where(F.col("k").isNotNull()).select(F.col("k").cast("long").alias("k"), F.col("n").cast("long").alias("n"))
    sorted_keys = stage(named.repartitionByRange(max(1, min(parts, 64)), "k").sortWithinPartitions("k").withColumn("t", F.spark_partition_id()), "keys")
    total = sorted_keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = max(1, -(-total // parts))
    sums = sorted_keys.groupBy("t").agg(F.sum("n").alias("s"))
    base = sums.select("t", F.coalesce(F.sum("s").over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = Window.partitionBy("t").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    before = sorted_keys.join(base, "t").withColumn("before", F.col("base") + F.coalesce(F.sum("n").over(own), F.lit(0)))
    # A part begins at the first key of each multiple of the size, at a large key and behind one.
    placed = before.withColumn("part", F.floor(F.col("before") / F.lit(size))).withColumn("large", F.col("n") > F.lit(size))
    starts = placed.groupBy("part", "large").agg(F.min("k").alias("k"), F.max(F.when(F.col("large"), F.col("k") + 1)).alias("behind"))
    ends = {x for r in starts.collect() for x in (r["k"], r["behind"]) if x is not None}  # a few per part
    bounds = sorted(ends)[1:]
    if not bounds:
        return [f"{column} is not null or {column} is null"]
    middle = [f"{column} >= {a} and {column} < {b}" for a, b in zip(bounds, bounds[1:])]
    return [f"{column} < {bounds[0]}", *middle, f"{column} >= {bounds[-1]} or {column} is null"]


def register_star(star: Mapping[str, DataFrame], names: Mapping[str, str] | None = None) -> None:
    """Make the tables known to ``spark.sql`` as views, under ``names`` where given."""
    for table, df in star.items():
        df.createOrReplaceTempView((names or {}).get(table, table))


def validate_dims(star: Mapping[str, DataFrame]) -> DataFrame:
    """Duplicate keys per dimension; any of them multiplies joined trips."""

    def check(table: str, keys: tuple[str, ...]) -> DataFrame:
        per_key = star[table].groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        return per_key.agg(
            F.lit(table).alias("table_name"),
            F.count(F.lit(1)).alias("distinct_keys"),
            F.count_if(F.col("n") > 1).alias("duplicate_keys"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"),
        )

    return reduce(DataFrame.unionByName, [check(t, k) for t, k in DIM_KEYS.items()])
