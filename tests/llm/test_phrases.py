from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from ridestats.llm import phrases, queries


def brute(rows, least, words, top):
    counts, totals, out = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", text):
            w = re.findall("[^\\x20\\x09]+", piece)
            totals[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, min(words, len(w) - i) + 1):
                    counts[lang][tuple(w[i : i + k])] += 1
    for lang, f in counts.items():
        candidates = [p for p in f if len(p) > 1 and f[p] >= least]
        inside = {q[i : i + k] for q in candidates for k in range(2, len(q)) for i in range(len(q) - k + 1) if f[q] >= f[q[i : i + k]]}
        best = []
        for p in candidates:
            if p not in inside:
                score, k = min((1000 * f[p] * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def corpus(n=200, seed=2):
    rnd = random.Random(seed)
    vocabulary = ["the", "The", "of", "a", "é", "É", "漢", "x\x1cy", "|", "it's", " ", *(f"w{i}" for i in range(30))]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rnd.randrange(40)):
            text += rnd.choice((["New", "York", "City"], ["a", "b", "a", "b", "a", "b", "a"], ["in", "spite", "of", "the", "fact", "that"], rnd.choices(vocabulary, k=3)))
            text[-1] += rnd.choice(("", "", "", ".", ",", "\n", ":", "!?"))
        rows.append((rnd.choice(("en", "en", "fr", None, "und")), rnd.choice((" ", "\t", "  ")).join(text)))
    return rows + [(None, None), ("fr", ""), ("xx", " \n\t."), ("en", "buy now " * 2000), ("fr", "alone"), ("é", "q. " * 30 + "z z" * 20)]


SCHEMA = "lang string, text string, phrase string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("least, words, top", [(5, 5, 2000), (1, 3, 7), (20, 2, 2000), (300, 4, 50)])
def test_equals_brute_force(spark, least, words, top):
    rows = corpus()
    assert got(phrases.collocations(frame(spark, rows).repartition(4), least, words, top)) == brute(rows, least, words, top)


@pytest.mark.parametrize("bin_rows, part_bytes, bits, fan_in", [(3, 300, 15, 2), (40, 2000, 3, 64)])
def test_hot_leads_small_parts_and_full_tables_lose_nothing(spark, monkeypatch, bin_rows, part_bytes, bits, fan_in):
    for name, value in (("BIN_ROWS", bin_rows), ("PART_BYTES", part_bytes), ("PAIR_BITS", bits), ("WORD_BITS", 16), ("FAN_IN", fan_in)):
        monkeypatch.setattr(phrases, name, value)
    rows = corpus(90)
    assert got(phrases.collocations(frame(spark, rows).repartition(5), 4, 5, 2000)) == brute(rows, 4, 5, 2000)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=5), st.integers(1, 5)), max_size=40), st.integers(1, 12), st.integers(0, 3))
def test_sizes_of_equal_parts_are_counts(suffixes, least, start):
    codes = np.full((len(suffixes), 6), -1, np.int32)
    counts = Counter()
    for i, (words, n) in enumerate(suffixes):
        codes[i, 0], codes[i, 1 : len(words) + 1] = 0, words
        for d in range(start, len(words) + 1):
            counts[tuple(words[:d])] += n
    weights = np.array([n for _, n in suffixes], np.int64)
    found = phrases.equal_parts(codes, weights, np.arange(len(suffixes)), start, least)
    assert sorted((tuple(codes[row, 1 : d + 1].tolist()), n) for row, d, n in found) == sorted((p, n) for p, n in counts.items() if n >= least and len(p) >= start)


def test_tables_without_words(spark):
    assert got(phrases.collocations(frame(spark, []))) == []
    assert got(phrases.collocations(frame(spark, [(None, None), ("en", "...")]))) == []
    with pytest.raises(ValueError):
        phrases.collocations(frame(spark, []), words=1)


def test_registered_query_agrees_with_its_sql(spark, tmp_path):
    rows = corpus(900)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(queries.oracle_sql()["op12_phrase_mining"]).select("lang, rank, phrase, a, l, r, n, score").fetchall()
    assert got(queries.op12_phrase_mining(spark, str(tmp_path))) == sorted(want) == brute(rows, 100, 5, 2000)


def test_exact_beyond_64_bits(spark):
    big = 4_000_000_000_000
    longer = spark.createDataFrame([("en", "a b", 2, big)], "lang string, phrase string, words int, f long")
    frequent = spark.createDataFrame([("en", "a", big + 1), ("en", "b", big + 3)], "lang string, word string, n long")
    totals = spark.createDataFrame([("en", 3 * big)], "lang string, n long")
    assert got(phrases.ranked(longer, frequent, totals, 5)) == [("en", 1, "a b", big, big + 1, big + 3, 3 * big, 1000 * big * 3 * big // ((big + 1) * (big + 3)))]
