from __future__ import annotations

import random

import pytest

from brute_text import judged, removed_lines
from ridestats.llm import lines, quality


def corpus(seed=4):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeéß") for _ in range(rnd.randrange(1, 6)))
    line = lambda n: " ".join(word() for _ in range(n)) + rnd.choice((".", ".", "!", ""))
    shared = [line(n) for n in (60, 20, 20, 15, 3, 1, 55, 30, 10, 10, 10, 10, 12)]
    junk = ["All rights reserved.", "WE ARE SHOUTING HERE NOW", "a | b | c | d", "x! y! z!", "menu", "echo echo echo echo echo echo.", "% & # word$ *b*", "", "  ", "é »"]
    docs = []
    for i in range(60):
        own = [line(rnd.randrange(1, 40)) for _ in range(rnd.randrange(0, 5))]
        at = rnd.randrange(len(shared))
        own[len(own) // 2 : len(own) // 2] = shared[at : at + rnd.randrange(0, 6)]
        own += [rnd.choice(junk) for _ in range(rnd.randrange(0, 3))]
        if rnd.random() < 0.2:
            own += own
        docs.append((i, "\n".join(own)))
    docs += [(100 + i, docs[i][1]) for i in range(5)] + [(200, None), (201, ""), (202, "\n\n"), (203, " \x0b\t"), (204, "one two")]
    return docs + [(205, "\n".join(["w " * 30] * 3 + [str(i) for i in range(300)])), (206, "\n".join(str(i) for i in range(250)))]


def test_verdicts(spark, monkeypatch):
    monkeypatch.setattr(quality, "PART_BYTES", 2000)
    rows = corpus() + [(None, "null id")]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, kept int").repartition(2)
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality.judge(docs).collect()}
    assert got == {(i, *judged(t)[:7]) for i, t in rows}
    clean = quality.clean(docs)
    assert clean.schema == docs.schema
    assert sorted((r.doc_id, r.text) for r in clean.collect()) == sorted((i, judged(t)[7]) for i, t in rows if judged(t)[6])
    assert quality.judge(docs.limit(0)).collect() == [] == quality.clean(docs.limit(0)).collect()


@pytest.mark.parametrize("min_words", [50, 12])
def test_removed_lines_are_those_of_all_repeated_runs(spark, min_words):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, None) for i, t in rows], "doc_id long, text string, removed string").repartition(3)
    want = {i: gone for (i, _), gone in zip(rows, removed_lines(rows, min_words))}
    got = lines.dedup_lines(docs, min_words).collect()
    assert {r.doc_id: r.removed for r in got} == want
    texts = dict(rows)
    for r in got:
        text = texts[r.doc_id]
        left = text if not want[r.doc_id] else "\n".join(x for p, x in enumerate(text.split("\n")) if p not in want[r.doc_id])
        assert (r.text, r.n_removed, r.n_lines) == (left, len(want[r.doc_id]), 0 if text is None else text.count("\n") + 1)
    kept = lines.drop_repeats(docs, min_words)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.n_removed or r.text.strip()}


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = "\n".join(["w " * 30 + str(i) for i in range(3)])
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id, r.n_removed) for r in lines.dedup_lines(docs).collect()), key=repr)
    assert got == [(False, 1, 0), (False, 1, 0), (False, 2, 3), (True, None, 3)]
    assert lines.dedup_lines(docs.limit(0)).collect() == []
