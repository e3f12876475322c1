"""Verdicts on URLs: host and path rules first, then a weighted vocabulary.

One Aho-Corasick automaton holds all terms and finds every occurrence in one pass over a
URL. An occurrence counts when no letter or digit stands before or after it. One strict
term, or ``soft_limit`` distinct soft terms, rejects the URL.

A rule names a host and the beginning of a path and fits that host and all below it; of
the rules that fit, the longest (host and path, in characters) decides, at equal length
the one whose text is greater. Vocabulary and rules are parameters and go to every task;
the table is not shuffled and each result depends on its own row.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path:
from there up to ``?``, ``#`` or the end. Null URLs and those without ``://`` have both
empty, fit no rule and are judged by their terms alone; a null URL is allowed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Words of hosts and paths that mark pages nobody wants in a training set.
STRICT = (
    "adult", "porn", "xxx", "nsfw", "hentai", "escort", "escorts", "camgirls", "casino", "spam", "warez", "keygen",
    "viagra", "phishing", "malware",
)
# Words that are harmless alone.
SOFT = (
    "ads", "adserver", "bet", "bets", "betting", "bonus", "cheap", "click", "crack", "deal", "dating", "discount", "farm",
    "free", "jackpot", "loan", "loans", "lottery", "pill", "pills", "poker", "popup", "promo", "proxy", "redirect",
    "replica", "slots", "torrent", "track", "tracker", "win", "winner",
)
SOFT_LIMIT = 2
_LOWER = {c: c + 32 for c in range(65, 91)}

Rule = tuple[str, str, str]  # allow or block, host, beginning of the path


@lru_cache(maxsize=4)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for terms, weight in ((soft, False), (strict, True)):
        for term in terms:
            automaton.add_word(term, (term, weight))
    automaton.make_automaton()
    return automaton


def terms_in(url: str, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[set[str], set[str]]:
    """Distinct strict and soft terms that stand by themselves in a lower-case URL."""
    found: tuple[set, set] = (set(), set())
    if strict or soft:
        for end, (term, weight) in _automaton(strict, soft).iter(url):
            start = end + 1 - len(term)
            if not (start and url[start - 1].isalnum() and url[start - 1].isascii()) and not (
                end + 1 < len(url) and url[end + 1].isalnum() and url[end + 1].isascii()
            ):
                found[0 if weight else 1].add(term)
    return found


def host_and_path(url: str | None) -> tuple[str, str]:
    _, scheme, rest = (url or "").partition("://")
    if not scheme:
        return "", ""
    at = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    tail = rest[at:]
    return rest[:at].translate(_LOWER), tail[: next((i for i, c in enumerate(tail) if c in "?#"), len(tail))]


def _by_host(rules: Sequence[Rule]) -> dict[str, list[tuple[str, str]]]:
    known: dict[str, list[tuple[str, str]]] = {}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks: {verdict}")
        known.setdefault(host, []).append((path, verdict))
    return known


def best_rule(host: str, path: str, known: dict[str, list[tuple[str, str]]]) -> tuple[str | None, str | None]:
    best, at = None, host
    while at:
        for start, verdict in known.get(at, ()):
            if path.startswith(start):
                best = max(best or (0, "", ""), (len(at) + len(start), at + start, verdict))
        at = at.partition(".")[2]
    return best[1:] if best else (None, None)


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = (), strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT,
               soft_limit: int = SOFT_LIMIT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, strict_terms, soft_terms) of every row; ids as they are."""
    known, strict, soft = _by_host(rules), tuple(t.lower() for t in strict), tuple(t.lower() for t in soft)

    def judged(url: str | None) -> tuple:
        host, path = host_and_path(url)
        rule, verdict = best_rule(host, path, known)
        hard, mild = terms_in((url or "").translate(_LOWER), strict, soft)
        verdict = verdict or ("block" if hard or len(mild) >= soft_limit else "allow")
        return host, path, rule, verdict, ",".join(sorted(hard)), ",".join(sorted(mild))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judged(url) for url in batch["url"].to_pylist()]
            columns = list(zip(*found)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], *(pa.array(c, pa.string()) for c in columns)],
                names=["page_id", "host", "path", "rule", "verdict", "strict_terms", "soft_terms"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).mapInArrow(
        run, f"page_id {kind}, host string, path string, rule string, verdict string, strict_terms string, soft_terms string")


def urls_sql(rules: Sequence[Rule], strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_limit: int = SOFT_LIMIT) -> str:
    """The same over the table ``pages``, for checking."""
    listed = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    terms = ", ".join([f"('{t}', true)" for t in strict] + [f"('{t}', false)" for t in soft])
    return f"""
with p as (
  select page_id, url, case when contains(coalesce(url, ''), '://') then substr(url, strpos(url, '://') + 3) end as rest
  from pages),
q as (select page_id, url, coalesce(lower(regexp_extract(rest, '^[^/?#]*')), '') as host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from p),
r as (select * from (values {listed}) t(verdict, rhost, rpath)),
t as (select * from (values {terms}) t(term, is_strict)),
hits as (
  select u.url, string_agg(term, ',' order by term) filter (where is_strict) as hard,
         string_agg(term, ',' order by term) filter (where not is_strict) as mild,
         count(*) filter (where is_strict) as n_hard, count(*) filter (where not is_strict) as n_mild
  from (select distinct url from pages where url is not null) u, t
  where regexp_matches(lower(u.url), '(^|[^a-z0-9])' || term || '($|[^a-z0-9])') group by u.url),
fits as (
  select q.host, q.path, max(struct_pack(n := length(rhost) + length(rpath), rule := rhost || rpath, verdict := verdict)) as best
  from (select distinct host, path from q) q join r
    on (q.host = rhost or ends_with(q.host, '.' || rhost)) and starts_with(q.path, rpath)
  group by q.host, q.path)
select q.page_id, q.host, q.path, best.rule as rule,
       coalesce(best.verdict, case when coalesce(n_hard, 0) > 0 or coalesce(n_mild, 0) >= {soft_limit} then 'block' else 'allow' end) as verdict,
       coalesce(hard, '') as strict_terms, coalesce(mild, '') as soft_terms
from q left join hits using (url) left join fits on q.host = fits.host and q.path = fits.path"""
