"""The queries of this package as SQL over the raw tables, for checking."""

from __future__ import annotations

from ridestats.llm.licenses import GAP, K, NARROWER, PHRASES, SHARE, SHORT, TEMPLATES, template_runs
from ridestats.llm.quality import BOILERPLATE, SEPARATORS, Rules

_R = Rules()
_WORD = r"'[^\x20\x09-\x0D]+'"


def _count(column: str, kept: str) -> str:
    return f"length(regexp_replace({column}, '[^{kept}]', '', 'g'))"


QUALITY = rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
w as (select rid, doc_id, text, regexp_extract_all(text, {_WORD}) as w from d),
windows as (select rid, i, list_slice(w, i, i + 7) as g from w, unnest(range(1, len(w) - 6)) t(i)),
twice as (select rid, g from windows group by rid, g having count(*) > 1),
repeated as (
  select rid, count(*) as n from (select distinct rid, i + j as at from windows join twice using (rid, g), unnest(range(0, 8)) s(j))
  group by rid),
l0 as (select rid, unnest(string_split(text, chr(10))) as line from d),
l1 as (select rid, line, regexp_extract_all(line, {_WORD}) as w from l0 where regexp_matches(line, {_WORD})),
l as (
  select rid, line, len(w) as n, {_count('line', '#*$%&|<>')} as symbols, {_count('line', '!')} as shouts,
         {_count('line', 'A-Z')} as upper, {_count('line', 'a-z')} as lower,
         len(list_filter(w, lambda x: x in ({', '.join(f"'{s}'" for s in SEPARATORS)}))) as separators,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as echoes, w[-1][-1] as last
  from l1),
v as (
  select rid, line, n,
         symbols >= {_R.symbols} * n or shouts >= {_R.shouts} * n + 1 or (n >= 5 and upper > {_R.capitals} * greatest(upper + lower, 1))
         or separators >= {_R.separators} * n + 1
         or (n < {_R.short_line} and not (ascii(last) > 127 or last in ('.', '!', '?', ':', ';', '"', '''', ')', ']', '}}')))
         or (n >= 5 and echoes >= {_R.echoes} * n)
         or (n <= {_R.boilerplate_words} and regexp_matches(regexp_replace(lower(line), '[^\x00-\x7f]', '?', 'g'), '{'|'.join(BOILERPLATE)}')) as fails
  from l),
per as (
  select rid, count(*) as n_lines, count(*) filter (where fails) as lost_lines, sum(n) filter (where fails) as lost_words,
         count(*) - count(distinct line) as n_dup_lines
  from v group by rid),
all_counts as (
  select w.rid, doc_id, len(w) as n_words, list_sum(list_transform(w, lambda x: length(x))) as word_chars,
         {_count('text', '#*$%&|<>')} as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(repeated.n, 0) as n_repeat_words,
         coalesce(n_lines, 0) as n_lines, coalesce(lost_lines, 0) as lost_lines, coalesce(lost_words, 0) as lost_words
  from w left join per using (rid) left join repeated using (rid))
select doc_id, n_words, coalesce(word_chars, 0)::bigint as word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words)
         and lost_words <= cast({_R.lost} as double) * n_words and n_words - lost_words >= {_R.left} as kept,
       n_lines, lost_lines, lost_words::bigint as lost_words
from all_counts"""


def lines_cte(source: str, min_words: int = 50) -> str:
    """Tables ``cut`` (doc_id, pos, line) and ``gone`` (doc_id, pos) of the lines of a table."""
    return rf"""
split_text as (select doc_id, string_split(text, chr(10)) as lines from {source}),
cut as (select doc_id, i as pos, lines[i + 1] as line from split_text, unnest(range(0, len(lines))) t(i)),
worded as (select doc_id, pos, line, len(regexp_extract_all(line, {_WORD})) as n from cut where regexp_matches(line, {_WORD})),
summed as (
  select *, sum(n) over w as after, sum(n) over w - n as before, row_number() over w as ord
  from worded window w as (partition by doc_id order by pos)),
ends as (
  select a.doc_id, a.ord, min(b.ord) as till from summed a join summed b on a.doc_id = b.doc_id and b.after >= a.before + {min_words} and b.ord >= a.ord
  group by a.doc_id, a.ord
  union
  select a.doc_id, max(b.ord), a.ord from summed a join summed b on a.doc_id = b.doc_id and b.before <= a.after - {min_words} and b.ord <= a.ord
  group by a.doc_id, a.ord),
listed as (select doc_id, list(line order by pos) as lines, list(pos order by pos) as places from worded group by doc_id),
runs as (select doc_id, array_to_string(list_slice(lines, ord, till), chr(10)) as run, list_slice(places, ord, till) as places from ends join listed using (doc_id)),
firsts as (select run, min((doc_id, places[1])) as first from runs group by run having count(*) > 1),
gone as (select distinct doc_id, unnest(places) as pos from runs join firsts using (run) where (doc_id, places[1]) <> first)"""


LINES = f"""
with {lines_cte('documents')}
select d.doc_id,
       case when n_removed is null then text else coalesce(left_over, '') end as text, coalesce(len(string_split(text, chr(10))), 0) as n_lines,
       coalesce(n_removed, 0) as n_removed
from documents d
left join (select doc_id, count(*) as n_removed from gone group by doc_id) using (doc_id)
left join (select doc_id, string_agg(line, chr(10) order by pos) as left_over from cut anti join gone using (doc_id, pos) group by doc_id) using (doc_id)"""


def _licenses() -> str:
    narrower = ", ".join(f"('{wide}', '{label}')" for wide, labels in NARROWER.items() for label in labels)
    runs = ", ".join(f"({t}, '{label}', {size}, {q}, '{run}')" for t, label, size, q, run in template_runs(TEMPLATES, K))
    phrases = " union all ".join(
        f"select rid, p, '{label}' as label from d, unnest(range(0, len(w))) t(p) where "
        + " and ".join(f"w[p + {j + 1}] = '{part}'" for j, part in enumerate(parts)) for label, parts in PHRASES)
    return rf"""
with d as (
  select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
known as (select * from (values {runs}) t(template, label, size, q, run)),
base as ({phrases}),
bases as (select rid, count(*) as n_base, min(p) as first_word, max(p) as last_word, list(distinct label) as labels from base group by rid),
grams as (select rid, p, array_to_string(list_slice(w, p + 1, p + {K}), ' ') as run from d, unnest(range(0, len(w) - {K} + 1)) t(p)),
votes as (select rid, template, label, size, p, q, p - q as diagonal from grams join known using (run)),
diagonals as (select rid, template, label, size, diagonal, min(p) as first, max(p) as last, list(distinct q) as qs from votes group by all),
flagged as (select *, case when diagonal - lag(diagonal) over (partition by rid, template order by diagonal) > {GAP} then 1 else 0 end as new from diagonals),
banded as (select *, sum(new) over (partition by rid, template order by diagonal) as band from flagged),
merged as (select rid, template, label, size, band, min(first) as first, max(last) + {K} as till, flatten(list(qs)) as qs from banded group by all),
scored as (
  select rid, first, till, label,
         len(list_distinct(flatten(list_transform(qs, lambda q: range(q, q + {K}))))) / cast(size as double) as score, size from merged),
verified as (select * from scored where score >= case when size < {SHORT} then 1.0 else {SHARE} end),
narrower as (select * from (values {narrower}) t(label, narrow)),
standing as (
  select * from verified v where not exists (
    select 1 from narrower n join verified o on o.label = n.narrow
    where n.label = v.label and o.rid = v.rid and o.first < v.till and o.till > v.first)),
spans as (
  select rid, list(struct_pack(first_word := first, end_word := till, label := label, score := score) order by first, till, label, score) as spans,
         max(score) as best, list(distinct label) as labels
  from standing group by rid)
select doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(bases.labels), ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bases.labels, []), coalesce(spans.labels, [])))), ','), '') as labels,
       case when n_base > 0 then 1.0::double else coalesce(best, 0.0::double) end as score
from d left join bases using (rid) left join spans using (rid)"""


LICENSES = _licenses()


# Links between all pairs of equal label, and what they reach.
VECTORS = """
with recursive v as (
  select row_number() over () as rid, vec_id, label, embedding::double[] as e from embeddings),
u as (
  select rid, label, e from v
  where label is not null and e is not null and len(e) > 0 and list_count(e) = len(e)
    and len(list_filter(e, lambda x: not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (
  select a.rid as a, b.rid as b from u a join u b on a.label = b.label and a.rid <> b.rid and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach as (select rid as a, rid as b from v union select r.a, l.b from reach r join links l on r.b = l.a),
least as (select r.a as rid, min(vec_id) as component_id from reach r join v on v.rid = r.b group by r.a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id is not distinct from component_id as kept
from v join least using (rid) left join (select a as rid, count(*) as n from links group by a) using (rid)"""


def groups_cte(source: str, k: int, num: int, den: int) -> str:
    """Tables ``doc`` (rid, doc_id, n) and ``least`` (rid, root, component_id) of n-gram similarity."""
    return rf"""
doc_words as (
  select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), {_WORD}) as w from {source}),
grams as (
  select distinct rid, md5(array_to_string(list_slice(w, i, least(len(w), i + {k} - 1)), ' ')) as g
  from doc_words, unnest(range(1, greatest(len(w) - {k} + 1, least(len(w), 1)) + 1)) t(i)),
doc as (select rid, doc_id, coalesce(n, 0) as n from doc_words left join (select rid, count(*) as n from grams group by rid) using (rid)),
-- The rarest n-grams of each text: two similar texts share one of them.
ranked as (
  select rid, g, row_number() over (partition by rid order by df, g) as r
  from grams join (select g, count(*) as df from grams group by g) using (g) where df > 1),
few as (select ranked.rid, g from ranked join doc using (rid) where r <= n - ceil(n * {num} / {den}.0) + 1),
near as (select distinct a.rid as a, b.rid as b from few a join few b using (g) where a.rid < b.rid),
links as (
  select near.a, near.b from near join grams x on x.rid = near.a join grams y on y.rid = near.b and x.g = y.g
    join doc p on p.rid = near.a join doc q on q.rid = near.b
  group by near.a, near.b, p.n, q.n having {den} * count(*) >= {num} * (p.n + q.n - count(*))),
both_ways as (select a, b from links union all select b, a from links),
reach as (select rid as a, rid as b from doc union select r.a, l.b from reach r join both_ways l on r.b = l.a),
least as (select r.a as rid, min(r.b) as root, min(doc_id) as component_id from reach r join doc on doc.rid = r.b group by r.a)"""


JACCARD = f"""
with recursive {groups_cte('documents', 3, 90, 100)}
select doc_id, n as n_shingles, component_id from doc join least using (rid)"""

# crc32 bit by bit: a message's bits, the lowest of each byte first.
VARIANTS = """
with recursive runs as (
  select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{5,}')) as run from documents),
messages as (select id, run, count(*) as times, hex(id || ':' || run) as bytes from runs group by all),
hashed as (
  select run, times, xor(list_reduce(
    list_transform(range(4 * length(bytes)), lambda i: (('0x' || substr(bytes, 2 * (i // 8) + 1, 2))::bigint >> (i % 8)) & 1),
    lambda c, bit: xor(c >> 1, 3988292384 * (xor(c, bit) & 1)), 4294967295::bigint), 4294967295) as h from messages),
cut as (
  select case when h % 97 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, times from hashed),
words as (select word, sum(times)::bigint as n from cut where length(word) >= 5 group by word having sum(times) >= 3),
gaps as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest
         from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as (
  select a.word, b.word as near, b.n as near_n from gaps a join gaps b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from gaps a join words b on a.rest = b.word
  union select b.word, a.word, a.n from gaps a join words b on a.rest = b.word),
best as (select word, count(*) as n_near, max(near_n) as near_n, arg_min(near, (-near_n, near)) as near from near group by word),
judged as (
  select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.near_n >= 2 * w.n then b.near end as form,
         case when b.near_n >= 2 * w.n then b.near_n end as form_n
  from words w left join best b using (word)),
ways as (
  select word, word as at from judged
  union all select w.word, j.form from ways w join judged j on j.word = w.at where j.form is not null)
select j.word, j.form, w.at as root, j.n, j.n_near, j.form_n
from judged j join ways w using (word) join judged e on e.word = w.at where e.form is null
"""

PHRASES = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
places as (select lang, w, unnest(range(1, len(w) + 1)) as i from words),
sizes as (select lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) as size from places),
counts as (select lang, size, array_to_string(list_slice(w, i, i + size - 1), ' ') as phrase, count(*) as f from sizes group by all),
totals as (select lang, sum(f) as n from counts where size = 1 group by lang),
candidates as (select lang, size, phrase, string_split(phrase, ' ') as w, f as a from counts where size > 1 and f >= 100),
inner_ones as (
  select lang, array_to_string(list_slice(w, i, i + size - 2), ' ') as phrase, a
  from (select *, unnest([1, 2]) as i from candidates where size > 2)),
kept as (select * from candidates c where not exists (
  select 1 from inner_ones o where o.lang = c.lang and o.phrase = c.phrase and o.a >= c.a)),
cuts as (
  select lang, phrase, a, k, array_to_string(w[:k], ' ') as head, array_to_string(w[k + 1:], ' ') as tail
  from (select *, unnest(range(1, size)) as k from kept)),
scored as (
  select c.lang, c.phrase, c.a, c.k, l.f as l, r.f as r, t.n,
         ((1000::hugeint * c.a::hugeint * t.n::hugeint) // (l.f::hugeint * r.f::hugeint)) as score
  from cuts c join counts l on l.lang = c.lang and l.phrase = c.head join counts r on r.lang = c.lang and r.phrase = c.tail
  join totals t on t.lang = c.lang),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best) where rank <= 2000
"""

TOP_PRODUCTS = """
with whole as (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
products as (
  select q.row, q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from whole q join whole c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, rank::integer as rank, vec_id, score
from (select *, row_number() over (partition by row order by score desc, vec_id) as rank from products)
where rank <= 5
"""
