from __future__ import annotations

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from ridestats.llm import packer
from ridestats.llm.common import file_of

FILE = file_of("word_bpe_49k.json")
LIBRARY = Tokenizer.from_buffer(FILE)  # as loaded
WORDS = ["x<|endoftext|>Y", "<|ENDOFTEXT|>", "<|startoftext|>.", "The", "É", "e\u0301", "ΟΔΟΣ", "it's", "12", "a\u00a0b", "don't.", "漢字", "x" * 60, "<|endoftext|>", "\u2028", "of", "…", "\x1c", "End.", "A,b.c", "T\u0308.", ".,x", "Ab.'s", "\u0130.", "K.\u0301", "1.5,"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from([*"aAbZ.,'sSt1 \n-", "\u0308", "\u030c", "j", "T", "\u0130", "é", "\u00a0", "漢"]), max_size=25), max_size=6))
def test_ids_of_any_text(texts):
    ids, lengths = packer._ids(pa.array(texts, pa.string()), FILE)
    want = [[*LIBRARY.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "<|endof", "text|>", *"aAZ.,' \n", "\u0308", "É"]), max_size=15).map("".join), max_size=4))
def test_added_tokens_are_found_as_the_library_finds_them(texts):
    ids, _ = packer._ids(pa.array(texts, pa.string()), FILE)
    assert ids.tolist() == [i for t in texts for i in (*LIBRARY.encode(t, add_special_tokens=False).ids, 0)]


def checked(rows, size):
    """Every place is used once, without gaps; returns the number of sequences."""
    sequences = defaultdict(list)
    for length, sequence, offset in rows:
        sequences[sequence].append((offset, length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


def best_fit(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= n
        else:
            rooms.append(size - n)
    return len(rooms)


def test_pieces_and_places(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.choice((0, 1, 5, 40, 150))))) for i in range(120)]
    rows += [(None, "x"), (3, "again"), (3, "again"), (500, None), (501, ""), (502, "the of " * 700), (503, " \n")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int").repartition(3)
    size = 128
    cut = packer.pieces(docs, FILE, size, with_ids=True)
    placed = packer.pack(cut, size).collect()
    checked([(r.length, r.sequence_id, r.offset) for r in placed], size)

    want = []
    for i, text in rows:
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]
        for p, start in enumerate(range(0, len(ids), size)):
            part = ids[start : start + size]
            want.append((i, p, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in placed), key=repr) == sorted(want, key=repr)
    lengths = [w[3] for w in want]
    assert len({r.sequence_id for r in placed}) <= best_fit(lengths, size)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=0, max_size=80))
def test_plans_are_valid_and_no_worse_than_best_fit(lengths):
    size = 30
    histogram = np.bincount(lengths, minlength=size + 1) if lengths else np.zeros(size + 1, int)
    plan = packer.plan(histogram, size)
    held = np.zeros(size + 1, int)
    for pattern, times in plan.items():
        assert times > 0 and sum(n * c for n, c in pattern) <= size
        for n, c in pattern:
            held[n] += c * times
    assert (held == histogram).all()
    assert -(-sum(lengths) // size) <= sum(plan.values()) <= best_fit(lengths, size)


def test_local_search_empties_sequences_that_best_fit_leaves():
    # Best fit needs three sequences; exchanging pieces fits all into two.
    histogram = np.zeros(11, int)
    for n in (5, 4, 3, 3, 3, 2):
        histogram[n] += 1
    bins = packer._Bins(10)
    for n in range(10, 0, -1):
        bins.best_fit(n, int(histogram[n]))
    assert sum(packer.plan(histogram, 10).values()) <= sum(c for _, c in bins.patterns())
    apart = packer._Bins(10)
    for pattern in ({6: 1, 3: 1}, {5: 1, 4: 1}, {1: 1}, {1: 1}):
        apart._add(pattern, 1)
    apart.improve()
    assert sum(c for _, c in apart.patterns()) == 2


def test_many_equal_lengths_errors_and_empty_table(spark):
    items = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 7, if(id % 3 = 1, 64, 57)) as length").repartition(7)
    placed = packer.pack(items, 64).collect()
    assert checked([(r.length, r.sequence_id, r.offset) for r in placed], 64) == 5000 * 2 // 3 + 1 and len(placed) == 5000
    clash = packer.pack(items.selectExpr("length", "id as rank", "1 as task", "2 as offset", "3 as base"), 64)
    assert set(clash.columns) == {"length", "rank", "task", "base", "sequence_id", "offset"} and clash.count() == 5000
    for bad in (0, 65, None):
        with pytest.raises(Exception, match="lengths must lie"):
            packer.pack(spark.createDataFrame([(bad,)], "length int"), 64).collect()
    assert packer.pack(spark.createDataFrame([], "length long"), 64).collect() == []
    assert packer.pieces(spark.createDataFrame([], "doc_id long, text string"), FILE).collect() == []


def grows(one, other, size):
    """Whether a move, or one or two pieces for a shorter one, makes the squared fills of two sequences grow."""
    fill = lambda p: sum(n * c for n, c in p)
    pieces = [n for n, c in one for _ in range(min(c, 2))]
    a, b = fill(one), fill(other)
    for take in (0, *(n for n, _ in other)):
        for parts in [(x,) for x in pieces] + [p for p in itertools.combinations(pieces, 2) if take]:
            gain = sum(parts) - take
            if 0 < gain <= size - b and gain * (b - a + gain) > 0:
                return True
    return False


@pytest.mark.parametrize("low, high, n", [(400, 1100, 5000), (640, 760, 5000)])
def test_local_search_of_mid_sized_lengths_goes_on_until_nothing_grows(low, high, n):
    size = 2048
    lengths = np.random.default_rng(1).integers(low, high + 1, n)
    plan = packer.plan(np.bincount(lengths, minlength=size + 1), size)
    held = np.zeros(size + 1, int)
    for pattern, times in plan.items():
        for k, c in pattern:
            held[k] += c * times
    assert (held == np.bincount(lengths, minlength=size + 1)).all()
    if sum(plan.values()) > -(-lengths.sum() // size):
        under = [(p, t) for p, t in plan.items() if sum(k * c for k, c in p) < size]
        left = [(p, q) for p, t in under for q, u in under if (p != q or t > 1) and grows(p, q, size)]
        assert not left


def test_tasks_hold_one_python_worker_and_small_batches(spark, monkeypatch):
    plans = []

    def stage(df, *rest, **more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return whole(df, *rest, **more)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"length": [1], "rows": [batch.num_rows], "bytes": [batch.nbytes]})

    whole = packer.stage
    monkeypatch.setattr(packer, "stage", stage)
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit)
    items = spark.range(300, numPartitions=1).selectExpr("repeat(cast(id as string), 50000) as text").mapInArrow(sizes, "length long, rows long, bytes long")
    placed = packer.pack(items, 64)
    plans.append(placed._jdf.queryExecution().executedPlan().toString())
    assert max(plan.count("MapInArrow") for plan in plans) == 1
    rows = placed.collect()
    assert sum(r.rows for r in rows) == 300 and max(r.bytes for r in rows) < 5 << 20
    checked([(r.length, r.sequence_id, r.offset) for r in rows], 64)
    assert spark.conf.get(limit) == before


def test_library_is_given_a_bounded_number_of_words(monkeypatch):
    given_words = []

    class Counting:
        def encode_batch_fast(self, words, **options):
            given_words.append(len(words))
            return LIBRARY.encode_batch_fast(words, **options)

    monkeypatch.setattr(packer, "_tokenizer", lambda content: (Counting(), {}, None))
    text = " ".join(f"w{i}" for i in range(30_000)) + " W7 w29999"
    ids, lengths = packer._ids(pa.array([text, "w1"]), FILE)
    assert ids.tolist() == [i for t in (text, "w1") for i in (*LIBRARY.encode(t, add_special_tokens=False).ids, 0)]
    assert sum(given_words) == 30_000 and max(given_words) < 10_000 and lengths[1] == len(ids) - lengths[0]
