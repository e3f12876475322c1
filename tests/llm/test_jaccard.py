from __future__ import annotations

import random
import re

import numpy as np
import pytest

from ridestats.llm import blocks, jaccard
from ridestats.llm.components import Forest, components


def brute(rows, k, num, den):
    """By comparing all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    forest = Forest()
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                forest.join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[forest.root(i)] = min(d, least.get(forest.root(i), d))
    return sorted(((d is None, d, len(s), least.get(forest.root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def corpus(seed=5, n=150):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    passage = [rnd.choice(words) for _ in range(12)]
    bases = [[rnd.choice(words) for _ in range(rnd.choice((2, 4, 12, 40, 80)))] + (passage if rnd.random() < 0.5 else []) for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice((0, 0, 1, 1, 2, 5))):
            at = rnd.randrange(len(w))
            w[at : at + 1] = rnd.choice(([], [rnd.choice(words)], [w[at].upper(), "x"]))
        rows.append((i, rnd.choice((" ", "\n", "  ")).join(w)))
    return rows + [(None, "w1 w2 w3"), (None, "w1 w2 w3"), (3, rows[3][1]), (3, rows[4][1]), (900, None), (901, ""), (902, " \t"),
                   (903, "é É"), (904, "É é"), (905, "A"), (906, "a"), (907, " ".join(words) * 60)]


@pytest.mark.parametrize("chunk, k, num", [(1 << 22, 3, 90), (1 << 22, 5, 80), (200, 3, 90), (200, 5, 80)])
def test_groups_equal_those_of_all_pairs(spark, monkeypatch, chunk, k, num):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(blocks, "SHARD_BYTES", 9000)
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component_id int").repartition(3)
    got = jaccard.jaccard_groups(docs, k, num, 100).collect()
    assert sorted(((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, k, num, 100)


def test_search_equals_comparison_with_long_lists(monkeypatch):
    monkeypatch.setattr(jaccard, "LONG_LIST", 4)
    rnd = random.Random(1)
    sets = [np.array(sorted(rnd.sample(range(40), rnd.randrange(1, 40))), np.uint64) for _ in range(60)]
    sets += [np.array(sorted({*range(30)} - {i}), np.uint64) for i in range(20)]
    index = jaccard.Inverted(sets, np.arange(len(sets)))
    for q in sets:
        want = [i for i, s in enumerate(sets) if 10 * len({*q} & {*s}) >= 7 * len({*q} | {*s})]
        assert index.similar(q, 7, 10).tolist() == want


def test_components_of_chains_stars_and_loops(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7)]
    edges += [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)]
    rnd.shuffle(edges)
    forest = Forest()
    for a, b in edges:
        forest.join(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    nodes = {x for e in edges for x in e}
    assert {(r.node, r.root) for r in got} == {(x, forest.root(x)) for x in nodes if forest.root(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_empty_table(spark):
    assert jaccard.jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
