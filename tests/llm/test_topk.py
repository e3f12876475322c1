from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ridestats.llm import queries, topk


def brute(rows, is_query, k):
    """By the definition, in whole numbers of Python."""
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in fine:
        if is_query(i):
            found = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in fine if j != i)[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(found, 1)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()))


SCHEMA = "vec_id long, embedding array<float>, score string, query int"


def vectors(n=300, size=6, seed=1):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0, 1) * rnd.choice((0.1, 1, 5)) / (1 + x) for x in range(size)]) for i in range(n)]
    rows += [(1000, [0.0] * size), (1005, [0.5] * size), (1005, [0.5] * size), (1010, [0.5] * size), (1001, None), (None, [1.0] * size),
             (1015, [None, *[1.0] * (size - 1)]), (1020, [math.nan] * size), (1025, [math.inf] * size), (1030, []), (1035, [1.0, 2.0]), (0, rows[0][1])]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("rows_a_block, first", [(16, 1), (64, 2), (4096, 2)])
def test_equals_brute_force(spark, monkeypatch, rows_a_block, first):
    monkeypatch.setattr(topk, "BLOCK_BYTES", rows_a_block * 48)
    monkeypatch.setattr(topk, "FIRST_BLOCKS", first)
    monkeypatch.setattr(topk, "CHUNK", 7)
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    assert got(topk.top_products(df, F.col("id") % 5 == 0)) == brute(rows, lambda i: i % 5 == 0, 5)
    assert got(topk.top_products(df, F.col("id") < 3, k=500)) == brute(rows, lambda i: i < 3, 500)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 4), st.integers(1, 40), st.integers(0, 10**6), st.sampled_from([1, 3, 2**20, 2**28]))
def test_a_block_by_itself(k, n, seed, scale):
    rng = np.random.default_rng(seed)
    v = rng.integers(-3, 4, (n, 5)) * scale
    c = v[np.argsort(-np.sqrt((v.astype(float) ** 2).sum(axis=1)), kind="stable")]
    rotation = np.linalg.qr(rng.standard_normal((5, 5)))[0]
    ids = rng.permutation(n)
    found = topk.best_of_block(v, np.arange(100, 100 + n), c, ids, np.full(n, -np.inf), rotation, k)
    want = []
    for i, x in enumerate(v.tolist()):
        best = sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in zip(ids.tolist(), c.tolist()))[:k]
        want += [(i, j, -s) for s, j in best]
    assert sorted(zip(*(x.tolist() for x in found))) == sorted(want)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 4), st.integers(1, 40), st.integers(0, 10**6), st.sampled_from([1, 2**28]), st.sampled_from([1, 10**9]), st.integers(1, 9))
def test_ties_across_blocks(k, n, seed, scale, dense, cut):
    rng = np.random.default_rng(seed)
    v = rng.integers(-1, 2, (n, 3)) * scale  # many equal vectors
    c = v[np.argsort(-np.sqrt((v.astype(float) ** 2).sum(axis=1)), kind="stable")]
    ids, best = rng.integers(0, 2 * n, n), None
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(topk, "DENSE", dense)
        patch.setattr(topk, "CHUNK", 4)
        for at in range(0, n, cut):
            best = topk.best_of_block(v, np.arange(n), c[at : at + cut], ids[at : at + cut], np.full(n, -np.inf), np.eye(3), k, best)
    want = []
    for i, x in enumerate(v.tolist()):
        some = sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in zip(ids.tolist(), c.tolist()) if j != i)[:k]
        want += [(i, j, -s) for s, j in some]
    assert sorted(zip(*(x.tolist() for x in best))) == sorted(want)


def test_few_rows_no_rows_and_products_that_are_too_large(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert got(topk.top_products(none, F.lit(True))) == []
    one = spark.createDataFrame([(50, [1.0], "", 1)], SCHEMA)
    assert got(topk.top_products(one, F.lit(True))) == []
    assert got(topk.top_products(one, F.lit(False))) == []
    with pytest.raises(ValueError):
        topk.top_products(spark.createDataFrame([(0, [1e12], "", 1), (1, [1e12], "", 1)], SCHEMA), F.lit(True))
    with pytest.raises(Exception, match="too large"):
        topk.top_products(spark.createDataFrame([(0, [1e30], "", 1)], SCHEMA), F.lit(True))


def test_bounds_keep_most_candidates_from_being_multiplied(monkeypatch):
    rng = np.random.default_rng(0)
    v = np.floor(256 * rng.standard_normal((4000, 32)) / np.sqrt(1 + np.arange(32)) * rng.lognormal(0, 1, (4000, 1))).astype(np.int64)
    c = v[np.argsort(-np.sqrt((v.astype(float) ** 2).sum(axis=1)))]
    _, columns = np.linalg.eigh(v.T.astype(float) @ v)
    seen, exact = [], topk._products
    monkeypatch.setattr(topk, "_products", lambda q, c, i, j, kind: seen.append(len(i)) or exact(q, c, i, j, kind))
    topk.best_of_block(v[:100], np.full(100, -1), c, np.arange(4000), np.full(100, -np.inf), columns[:, ::-1], 5)
    assert sum(seen) < 0.2 * 100 * 4000


def test_pairs_of_blocks_are_neither_broadcast_nor_shuffled(spark, monkeypatch):
    plans, staged = [], topk.stage

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def seen(df, label, *parts):
        plans.append(plan(df))
        return staged(df, label, *parts)

    monkeypatch.setattr(topk, "stage", seen)
    rows = vectors(60, 4)
    final = topk.top_products(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), F.col("id") % 5 == 0)
    plans.append(plan(final))
    met = [p for p in plans if "query_vs" in p and "MapInArrow" in p]
    assert len(met) == 2 and all("CartesianProduct" in p and "Broadcast" not in p and "SortMergeJoin" not in p for p in met)
    assert got(final) == brute(rows, lambda i: i % 5 == 0, 5)


def test_registered_query_agrees_with_its_sql(spark, tmp_path):
    rows = [(i, v) for i, v in vectors(220, 4) if i is not None and i != 1035 and i != 1030]
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.sql(queries.oracle_sql()["op13_topk_search"]).select("query_id, rank, vec_id, score").fetchall()
    assert got(queries.op13_topk_search(spark, str(tmp_path))) == sorted(want) == brute(rows, lambda i: i % 50 == 0, 5)
