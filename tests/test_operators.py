import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridestats.functions.hashing import key_text, normal, uniform
from ridestats.operators.expand import repeat_rows
from ridestats.operators.quantiles import exact_quantiles
from ridestats.operators.ranking import sorted_codes
from ridestats.operators.regression import regression_metrics
from ridestats.operators.sampling import seeded_sample, stratified_split, take_by_hash


@pytest.mark.parametrize("small", [100_000, 50])
@pytest.mark.parametrize("p", [0.0, 0.1, 0.5, 0.937, 1.0])
def test_quantiles_are_exact_on_either_path(spark, small, p):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25), rng.exponential(1e6, size=1000)])
    df = spark.createDataFrame([(float(v), float(v) * -2) for v in values], "a double, b double")
    got = exact_quantiles(df.repartition(7), ["a", "b"], p, small=small)
    assert got["a"] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)
    assert got["b"] == pytest.approx(np.quantile(values * -2, p), rel=1e-12, abs=1e-12)


def test_quantiles_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None)], "a double, b double")
    assert exact_quantiles(df, ["a", "b"], 0.5) == {"a": None, "b": 1.0}


def test_repeat_rows_splits_large_counts(spark):
    df = spark.createDataFrame([("a", 7), ("b", 0), ("c", 1), ("d", None), ("e", -3)], "k string, n int")
    got = repeat_rows(df, F.col("n"), "i", chunk=3).collect()
    assert sorted((r["k"], r["i"]) for r in got) == [("a", i) for i in range(1, 8)] + [("c", 1)]


def test_sorted_codes_are_ranks(spark):
    words = [f"w{(i * 7919) % 1000:03d}" for i in range(1000)] + ["w001"] * 500
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string").repartition(9)
    got = {r["w"]: r["code"] for r in sorted_codes(df, "w", "code").collect()}
    assert got == {w: i for i, w in enumerate(sorted(set(words)))}


def copies(spark, hot=600, n=1200):
    """``hot`` equal rows among ``n`` different ones."""
    data = [("hot", 1, 1.0)] * hot + [(f"k{i}", i, float(i % 3)) for i in range(n)]
    return spark.createDataFrame(data, "k string, i int, y double")


@pytest.mark.parametrize("quota", [0, 1, 250, 1799, 1800, 5000])
@pytest.mark.parametrize("few", [100_000, 1])
def test_take_by_hash_takes_exactly_the_quota(spark, quota, few):
    df = copies(spark)
    got = take_by_hash(df, {0: quota}, [F.col("k"), F.col("i")], few=few)
    assert got.count() == 1800
    assert got.where("taken").count() == min(quota, 1800)
    assert Counter(map(tuple, got.drop("taken").collect())) == Counter(map(tuple, df.collect()))


def test_take_by_hash_cuts_among_copies(spark):
    only = spark.createDataFrame([("hot", 1)] * 500, "k string, i int")
    got = take_by_hash(only, {0: 123}, [F.col("k")])
    assert got.where("taken").count() == 123 and got.where("not taken").count() == 377


def test_take_by_hash_keeps_the_quota_when_rows_of_a_key_differ(spark):
    mixed = spark.createDataFrame([("k", i % 7) for i in range(100)], "k string, i int")
    got = take_by_hash(mixed, {0: 30}, [F.col("k")])
    assert got.where("taken").count() == 30
    assert Counter(r["i"] for r in got.collect()) == Counter(i % 7 for i in range(100))


def test_sample_does_not_depend_on_partitioning(spark):
    df = copies(spark)
    key = [F.col("k"), F.col("i")]
    a = sorted(map(tuple, seeded_sample(df.repartition(3), 400, key).collect()))
    b = sorted(map(tuple, seeded_sample(df.repartition(17, "i"), 400, key).collect()))
    c = sorted(map(tuple, seeded_sample(df, 400, key, seed=7).collect()))
    assert a == b and len(a) == 400 and a != c


def test_split_is_stratified_exactly(spark):
    df = copies(spark)
    split = stratified_split(df, F.col("y") > 0, [F.col("k"), F.col("i")])
    sizes = {(r["p"], r["is_test"]): r["count"] for r in split.groupBy((F.col("y") > 0).alias("p"), "is_test").count().collect()}
    # 1,400 positive and 400 other rows, a fifth of each.
    assert sizes == {(True, True): 280, (True, False): 1120, (False, True): 80, (False, False): 320}


def test_split_in_expectation(spark):
    df = spark.range(5000).withColumn("y", (F.col("id") % 2).cast("double"))
    share = stratified_split(df, F.col("y") > 0, [F.col("id")], exact=False).agg(F.avg(F.col("is_test").cast("int"))).first()[0]
    assert abs(share - 0.2) < 0.03


def test_split_of_one_stratum_and_odd_sizes(spark):
    df = spark.range(7).withColumn("y", F.lit(0.0))
    assert stratified_split(df, F.col("y") > 0, [F.col("id")]).where("is_test").count() == math.ceil(1.4)


def test_draws_look_uniform_and_normal(spark):
    df = spark.range(4000).select(
        uniform(F.col("id").cast("string"), "a").alias("u"),
        normal(F.col("id").cast("string"), F.lit(5.0), 2.0, "b").alias("z"),
    )
    u, z = np.array(df.collect()).T
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.02 and abs(u.std() - 12**-0.5) < 0.01
    assert abs(z.mean() - 5) < 0.12 and abs(z.std() - 2) < 0.1


def test_key_text_tells_null_from_empty(spark):
    df = spark.createDataFrame([(None, 1), ("", 1)], "s string, i int")
    assert len({r[0] for r in df.select(key_text([F.col("s"), F.col("i")])).collect()}) == 2


def test_regression_metrics(spark):
    df = spark.createDataFrame([("m", 1.0, 2.0), ("m", 3.0, 3.0), ("m", 5.0, 3.0), ("c", 1.0, 1.5)], "g string, y double, p double")
    got = {r["g"]: r for r in regression_metrics(df, "y", "p", by=("g",)).collect()}
    assert got["m"]["rmse"] == pytest.approx((5 / 3) ** 0.5) and got["m"]["mae"] == 1.0
    assert got["m"]["r2"] == pytest.approx(1 - 5 / 8)
    assert got["c"]["r2"] is None


def test_both_ways_to_a_quantile_agree_to_the_last_bit(spark):
    data = spark.range(3_000).selectExpr("rand(3) * 1000 as a", "round(rand(4) * 10, 1) as b").cache()
    for p in (0.1, 0.5, 0.73):
        assert exact_quantiles(data, ["a", "b"], p) == exact_quantiles(data, ["a", "b"], p, small=100)
    data.unpersist()
