from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark import TaskContext

from ridestats.llm import blocks, lm
from ridestats.llm.packing import split_words, unpack_ints


def test_runs_of_shards():
    assert list(blocks.runs_of(np.array([0, 0, 3, 7, 7, 7]))) == [(0, 0, 2), (3, 2, 3), (7, 3, 6)]
    assert list(blocks.runs_of(np.array([], np.int64))) == []


def test_cost_of_a_block_does_not_grow_with_the_number_of_shards():
    keys = np.sort(np.random.default_rng(0).integers(0, 2**63, 2000).astype(np.uint64) * np.uint64(2))
    spent = []
    for n_shards in (10**4, 10**5, 10**9):
        at = time.perf_counter()
        parts = list(lm._cut_by_range(0, keys, [np.ones(2000, np.uint32)], n_shards))
        spent.append(time.perf_counter() - at)
        assert len(parts) <= 2000
    assert spent[1] < 3 * spent[0] + 0.2 and spent[2] < 3 * spent[0] + 0.2


def test_blocks_keep_their_numbers_apart(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 2)
    docs = spark.range(9001).selectExpr("id as doc_id", "concat('w', id) as text").coalesce(1)
    rows = blocks.cut(docs, split_words, label=None).select("block", "ids", "counts").collect()
    assert len(rows) == len({r.block for r in rows}) == 4501  # more than 4,096 in one partition
    assert sorted(i for r in rows for i in r.ids) == list(range(9001)) and all(unpack_ints(r.counts).tolist() == [1] * len(r.ids) for r in rows)
