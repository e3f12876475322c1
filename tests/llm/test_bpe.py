from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from ridestats.llm import blocks, bpe, queries
from ridestats.llm.common import file_of

RANKS = file_of("byte_bpe_multi_50k.tiktoken")
PIECES = ["a", "B", "é", "漢字", "Straße", " ", "  ", "\n", "\t\n", "\x0b", "\x1c", "\x85", "\u00a0", "\u2028", "\u3000", "'s", "'LL", "12", "3.4",
          "…", "👍🏽", "\u0301", "<|endoftext|>", "the ", " of", "-", "\x00", "\ufeff"]


def texts(n=80):
    rnd = random.Random(9)
    rows = [(i, "".join(rnd.choice(PIECES) for _ in range(rnd.randrange(0, 40)))) for i in range(n)]
    return rows + [(None, "null id"), (5, "again"), (5, "again"), (900, None), (901, ""), (902, "word " * 3000), (903, " " * 500), (904, "x" * 3000)]


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 600)
    monkeypatch.setattr(blocks, "SHARD_BYTES", 4000)


def test_ids_are_those_of_the_library_and_decode_to_the_text(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, ids int").repartition(3)
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe._ranks(RANKS), special_tokens={})
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    want = [(i, library.encode_ordinary(t or "")) for i, t in rows]
    assert sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=repr) == sorted(want, key=repr)
    back = [(r.doc_id, bytes(r.bytes)) for r in bpe.decode(encoded, RANKS).collect()]
    assert sorted(back, key=repr) == sorted(((i, (t or "").encode()) for i, t in rows), key=repr)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.digests(encoded, RANKS).collect()}
    assert got == {(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
                   for (i, ids), (_, t) in zip(want, rows)}


def test_empty_table_and_null_ids_column(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect() == []
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bpe.decode(none, RANKS).first().bytes is None
