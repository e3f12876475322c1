from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brute_lm import scores
from ridestats.llm import blocks, lm, packing, queries


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 400)
    monkeypatch.setattr(blocks, "SHARD_BYTES", 700)


def corpus(n=60):
    rnd = random.Random(3)
    words = ["the", "The", "of", "a", "CAT", "dog\x1cx", "é", "É", "sat", "on", "mat", *(f"w{i}" for i in range(15))]
    rows = [(i, " ".join(rnd.choice(words[: rnd.choice((4, 11, 26))]) for _ in range(rnd.randrange(0, 25)))) for i in range(n)]
    return rows + [(None, None), (7, "a cat"), (7, "a cat"), (1000, "the of " * 400), (1001, " \n\t ")]


@pytest.mark.parametrize("order", [2, 3])
def test_scores_follow_the_definitions(spark, order):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(3)
    scored, model = lm.fit_and_score(docs, F.coalesce(F.col("doc_id") % 7 != 2, F.lit(True)), order)
    got = sorted(((r.doc_id is None, r.doc_id, round(r.score, 6), round(r.base_score, 6), r.n_tokens, r.n_known) for r in scored.collect()), key=repr)
    train = [t for i, t in rows if i is None or i % 7 != 2]
    want = sorted(((i is None, i, round(s, 6), round(b, 6), n, k) for (i, _), (s, b, n, k) in zip(rows, scores(train, [t for _, t in rows], order))), key=repr)
    assert got == want
    again = lm.score(docs, model, "doc_id", "text")
    assert sorted(round(r.score, 6) for r in again.collect()) == sorted(w[2] for w in want)


def test_empty_table_and_no_training_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.fit_and_score(none, F.lit(True))[0].collect() == []
    scored, _ = lm.fit_and_score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(False))
    assert [(r.n_tokens, r.n_known, r.score) for r in scored.collect()] == [(3, 0, 0.0)]


def test_registered_query_scores_trigrams(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((round(r.score, 6) for r in queries.op10_lm_score(spark, str(tmp_path)).collect()))
    train = [t for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2]
    want, smaller = (sorted(round(s[0], 6) for s in scores(train, [t for _, t in rows], order)) for order in (3, 2))
    assert got == want != smaller


def test_words_are_hashed_together_by_their_bytes_alone(monkeypatch):
    rnd = random.Random(5)
    words = sorted({bytes(rnd.choice(b"ab\x00\xc3\xa9") for _ in range(n % 300)) for n in range(3000)} | {b"", b"a", b"a\x00", b"\x00" * 8, b"\x00" * 9, b"x" * 5000})
    array = pa.array(words, pa.large_binary())
    found = packing.word_hashes(array).tolist()
    assert len(set(found)) == len(words)
    assert packing.word_hashes(array[7:]).tolist() == found[7:] and packing.word_hashes(array[:0]).tolist() == []
    assert [int(packing.word_hashes(pa.array([w], pa.large_binary()))[0]) for w in words[::50]] == found[::50]

    def one_by_one(word):
        raise AssertionError("words are hashed one by one")

    monkeypatch.setattr(packing.xxhash, "xxh64_intdigest", one_by_one)
    few = [w for w in words if len(w) < 200]
    row = {"counts": packing.pack_ints(np.array([len(few)], np.uint32)), "codes": packing.pack_ints(np.arange(len(few), dtype=np.uint32)),
           "words": packing.pack_strings(pa.array(few, pa.large_binary())), "flags": packing.pack_ints(np.ones(1, np.uint8))}
    assert len(np.unique(lm._Block(row, 3).vocabulary)) == len(few) + 2
