from __future__ import annotations

import numpy as np
import pytest

from ridestats.llm import vectors
from ridestats.llm.components import Forest


def brute(rows, threshold=0.98):
    def usable(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    forest, links = Forest(), [0] * len(rows)
    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows[:i]):
            if la is not None and la == lb and usable(a) and usable(b) and len(a) == len(b):
                x, y = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    forest.join(i, j)
    least = {}
    for i, (v, _, _) in enumerate(rows):
        if v is not None:
            least[forest.root(i)] = min(v, least.get(forest.root(i), v))
    out = [(v, links[i], least.get(forest.root(i))) for i, (v, _, _) in enumerate(rows)]
    return sorted(((*r, r[0] == r[2]) for r in out), key=repr)


def corpus():
    rng = np.random.default_rng(5)
    rows = []
    for label in (0, 1, 2):
        centres = rng.standard_normal((12, 32))
        for i in range(60):
            x = centres[i % 12] + rng.standard_normal(32) * rng.choice([0, 0.05, 0.12, 0.2, 1])
            rows.append((len(rows), (x * rng.choice([1, 3])).astype(np.float32).tolist(), label))
    rows += [(1000 + i, rows[0][1], 0) for i in range(30)]
    odd = [None, [], [0.0] * 32, [None] + [1.0] * 31, [float("nan")] * 32, [float("inf")] + [0.0] * 31, [1.0, 0.0], [1.0, 1e-3], [5.0], [7.0]]
    rows += [(2000 + i, v, 1) for i, v in enumerate(odd)] + [(3000, rows[5][1], None), (None, rows[7][1], 0), (7, rows[7][1], 0)]
    return rows


@pytest.mark.parametrize("chunk", [512, 4])
def test_links_are_those_of_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(vectors, "CHUNK", chunk)
    monkeypatch.setattr(vectors, "BIN_ROWS", 300)
    rows = corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, root int").repartition(3)
    got = vectors.near_vectors(df).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr) == [
        (*r[:3], True if r[0] is None and r[2] is None else r[3]) for r in brute(rows)]


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(1)
    unit = rng.standard_normal((400, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    codes = vectors.Codes(unit.astype(np.float32))
    queries = unit[:200].astype(np.float32) @ vectors.rotations(64, 1, seed=11)[0]
    error = codes.estimate(queries) - unit[:200] @ unit.T
    np.fill_diagonal(error[:, :200], 0)
    assert abs(error.mean()) < 0.003
    assert (np.abs(error) <= 5 * codes.spread).mean() > 0.9999


def test_empty_table(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
