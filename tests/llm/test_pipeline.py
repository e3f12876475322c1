"""The pipeline stage by stage against brute force, and the registered queries against SQL."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as registered
import check
import corpus_pipeline
from brute_text import judged, removed_lines
from ridestats.llm import queries
from ridestats.llm.common import file_of
from test_jaccard import brute
from test_packer import checked

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 7)))
    line = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    passages = [line(55), line(60), line(70)]
    texts = []
    for _ in range(25):
        texts.append("\n".join([line(rnd.randrange(15, 40)) for _ in range(rnd.randrange(1, 5))] + rnd.sample(passages, rnd.randrange(0, 2))))
    for i in range(15):  # near copies: some words changed, no line of 50 words in common
        words = texts[i].split(" ")
        for _ in range(rnd.choice((1, 2, 30))):
            words[rnd.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += texts[:4] + ["All rights reserved.\n" + texts[5], "BUY NOW!!! " * 30, "menu | home | about | news | more | x | y | z" * 5, "short text.", None, "", "echo " * 60]
    return [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)] + [(3, texts[3], "en", "src0", 0), (None, texts[20] + " and more of it.", None, None, None)]


def test_stages_equal_brute_force(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def after(number, docs):
        return corpus_pipeline.STAGES[number][1](spark, docs, str(tmp_path))

    def plain(df):
        assert df.schema.simpleString() == docs.schema.simpleString()
        return sorted(((r.doc_id is None, r.doc_id, r.text, r.n_chars) for r in df.collect()), key=repr)

    kept = sorted({(i is None, i, judged(t)[7], len(judged(t)[7])) for i, t, *_ in rows if judged(t)[6]}, key=repr)
    kept = [r for r in kept for _ in range(sum(x[0] == r[1] and judged(x[1])[6] for x in rows))]
    first = after(0, docs)
    assert plain(first) == kept
    assert 20 < len(kept) < len(rows)

    pairs = sorted({(i, t) for _, i, t, _ in kept}, key=repr)
    gone = dict(zip(pairs, removed_lines(pairs)))
    left = []
    for _, i, t, _ in kept:
        text = t if not gone[i, t] else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i, t])
        if text.strip() or not gone[i, t]:
            left.append((i is None, i, text, len(text)))
    second = after(1, first)
    assert plain(second) == sorted(left, key=repr)
    assert any(gone.values()) and len(left) < len(kept)

    groups = brute([(i, t) for _, i, t, _ in left], 5, 80, 100)
    third = after(2, second)
    got = plain(third)
    # One of each component: the smallest id, null ids first.
    no_null = {c for missing, i, n, c in groups if not missing}
    assert len(no_null) - 1 <= len(got) < len(left)
    assert {r[1] for r in got if not r[0]} <= no_null
    survivors = brute([(i, t) for _, i, t, _ in got], 5, 80, 100)
    assert all(missing or i == c for missing, i, _, c in survivors)

    placed = after(3, third).collect()
    tokenizer = Tokenizer.from_buffer(file_of("word_bpe_49k.json"))
    want = []
    for _, i, t, _ in got:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        want += [(i, n, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for n, s in enumerate(range(0, len(ids), 2048))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed), key=repr) == sorted(want, key=repr)
    checked([(r.length, r.sequence_id, r.offset) for r in placed], 2048)

    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(repr, [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in whole])) == sorted(map(repr, want))


def test_equal_rows_leave_one(spark, tmp_path):
    rows = [(1, "a b c d e f g", "en", "s", 1)] * 3 + [(2, "a b c d e f g", "en", "s", 1), (3, "", "x", "y", 0), (3, "", "x", "y", 0)]
    kept = corpus_pipeline.ngram_jaccard(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 3]


def test_empty_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, apply in corpus_pipeline.STAGES:
        docs = apply(spark, docs, "")
        assert docs.collect() == []


@pytest.fixture(scope="module")
def con():
    return check.database(FOLDER)


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query_equals_sql(spark, con, name):
    assert check.compare(spark, con, FOLDER, name) == ""


def test_native_queries_run_no_python(spark):
    for name in ("op1_line_dedup", "op7_license_scan"):
        plan = registered.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop")), name


def test_registered_once_for_each_operator():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)] + ["pipeline"]
    assert set(queries.oracle_sql()) <= set(names) and set(names) <= set(registered.queries())
