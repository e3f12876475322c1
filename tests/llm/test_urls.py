from __future__ import annotations

import pytest

from ridestats.llm import urls
from ridestats.llm.queries import URL_RULES

CASES = {
    None: ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    "no scheme casino": ("", "", None, "block"),
    "http://A.ORG/x": ("a.org", "/x", "org/", "allow"),
    "http://org": ("org", "", None, "allow"),
    "http://www.example.org/es/1?x#y": ("www.example.org", "/es/1", "example.org/es/", "block"),
    "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
    "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
    "https://x.com/de/a": ("x.com", "/de/a", "com/de/", "block"),
    "https://x.com/fr/casino": ("x.com", "/fr/casino", "com/fr/", "allow"),
    "https://casinos.net/": ("casinos.net", "/", None, "allow"),
    "https://my-casino.net/": ("my-casino.net", "/", None, "block"),
    "https://free.net/a": ("free.net", "/a", None, "allow"),
    "https://free.net/free": ("free.net", "/free", None, "allow"),
    "https://free.net/BETS?": ("free.net", "/BETS", None, "block"),
    "ftp://h?a://b": ("h", "", None, "allow"),
    "http://É.net#c": ("É.net", "", None, "allow"),
    "http://xxx\u00e9.net/": ("xxx\u00e9.net", "/", None, "block"),
    "http:///p": ("", "/p", None, "allow"),
}


def test_verdicts(spark):
    rows = [(i, u, "x") for i, u in enumerate(CASES)] + [(None, "http://a.org/", "x"), (3, "http://A.ORG/x", "x")]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, rule string"), URL_RULES).collect()
    by_id = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert [by_id[i] for i in range(len(CASES))] == list(CASES.values())
    assert len(got) == len(rows)
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_every_subset_of_terms_is_found_at_word_ends_only():
    strict, soft = ("abc", "bc"), ("c", "d")
    assert urls.terms_in("abc", strict, soft) == ({"abc"}, set())
    assert urls.terms_in("a-bc.c/d9", strict, soft) == ({"bc"}, {"c"})
    assert urls.terms_in("c c d", (), soft) == (set(), {"c", "d"})
    assert urls.terms_in("x", (), ()) == (set(), set())


def test_rules_must_allow_or_block():
    with pytest.raises(ValueError):
        urls._by_host([("maybe", "a", "/")])
