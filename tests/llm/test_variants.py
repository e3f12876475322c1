from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ridestats.llm import queries, variants


def brute_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 5
    return {w: n for w, n in counts.items() if n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    out, forms = [], {}
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= 2 * n:
            forms[w] = best
    for w, n in counts.items():
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, forms.get(w), root, n, len(near[w]), counts.get(forms.get(w))))
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def corpus():
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abéxÿ×zio") for _ in range(rnd.choice((4, 5, 6, 9)))) for _ in range(40)]
    words = []
    for w in base:
        for _ in range(6):
            i = rnd.randrange(len(w))
            words.append(rnd.choice((w, w[:i] + w[i + 1 :], w[:i] + rnd.choice("abzé") + w[i:], w[:i] + rnd.choice("abzé") + w[i + 1 :])))
    rows = [(i, " ".join(rnd.choice((w, w.upper(), w + ",", w + "_" + w, "…" + w)) for w in rnd.choices(words, [1 / (j + 1) for j in range(len(words))], k=rnd.randrange(80)))) for i in range(150)]
    long = "ab" * 3000
    return rows + [(None, "aaaaa aaaaa aaaaab"), (3, "aaaaa aaaaab"), (3, "aaaaa aaaaab"), (900, None), (901, ""), (902, "ÀÉ Ā 1 _"),
                   *((950 + i, f"{long} x{long} {long[1:]}") for i in range(4)), *((970 + i, f"{long} " * i) for i in range(9))]


def test_equals_brute_force_and_sql(spark, tmp_path):
    rows = corpus()
    want = brute(brute_words(rows))
    assert any(r[1] for r in want) and any(r[2] != r[0] and r[2] != r[1] for r in want)
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, at int")
    assert got(variants.spelling_variants(df.repartition(5))) == want
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert got(queries.op11_spelling_variants(spark, str(tmp_path))) == want
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet') where length(text) < 9000 or text is null")
    small = [r for r in rows if len(r[1] or "") < 9000]
    assert sorted(con.sql(queries.oracle_sql()["op11_spelling_variants"]).select("word, form, root, n, n_near, form_n").fetchall()) == brute(brute_words(small))


def test_chains_ties_and_empty_tables(spark):
    counts = {"aaaaa": 100, "aaaab": 50, "aaabb": 25, "aabbb": 12, "abbbb": 6, "bbbbb": 3, "ccccc": 9, "ccccd": 9, "cccca": 18, "ccccb": 18, "ddddd": 2}
    words = spark.createDataFrame([(w,) for w, n in counts.items() for _ in range(n)], "word string")
    want = brute({w: n for w, n in counts.items() if n >= 3})
    assert got(variants.variant_groups(words)) == want and ("bbbbb", "abbbb", "aaaaa", 3, 1, 6) in want and ("ccccc", "cccca", "cccca", 9, 3, 18) in want
    assert got(variants.variant_groups(words, symbols=2)) == want
    assert got(variants.variant_groups(words.limit(0))) == []
    assert got(variants.spelling_variants(spark.createDataFrame([], "doc_id int, text string"))) == []


def test_no_join_sends_a_side_to_all_tasks(spark, monkeypatch):
    plans, staged = [], variants.stage

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def seen(df, label, *parts):
        plans.append(plan(df))
        return staged(df, label, *parts)

    monkeypatch.setattr(variants, "stage", seen)
    counts = {"aaaaa": 100, "aaaab": 50, "aaabb": 25}
    final = variants.variant_groups(spark.createDataFrame([(w,) for w, n in counts.items() for _ in range(n)], "word string"))
    plans.append(plan(final))
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)
    assert got(final) == brute(counts)


@pytest.mark.parametrize("bits", [0, 20])
def test_a_full_bit_table_loses_nothing(spark, monkeypatch, bits):
    rows = corpus()[:60]
    if not bits:
        monkeypatch.setattr(variants, "bit_table", lambda *_: np.full(1 << (variants.BITS - 3), 255, np.uint8))
    else:
        monkeypatch.setattr(variants, "AT_ONCE", 50)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(variants.spelling_variants(df)) == brute(brute_words(rows))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=6, max_size=6), min_size=1, max_size=5))
def test_neighbourhoods_are_full_and_without_repeats(rows):
    letters = np.array(rows, np.uint64)
    found = [(int(r), int(k)) for row, key in variants.neighbours(letters, 3) for r, k in zip(row, key)]
    want = set()
    for r, w in enumerate(rows):
        around = {tuple(w)} | {(*w[:i], *w[i + 1 :]) for i in range(6)} | {(*w[:i], s, *w[i + 1 :]) for i in range(6) for s in (1, 2, 3)}
        around |= {(*w[:i], s, *w[i:]) for i in range(7) for s in (1, 2, 3)}
        want |= {(r, int(variants.own_key(np.array([x], np.uint64))[0])) for x in around}
    assert len(found) == len(set(found)) and set(found) == want
