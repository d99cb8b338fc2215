"""The queries of this package in DuckDB SQL."""

WORDS = """
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

DECONTAMINATION = f"""
with d as (select doc_id, {WORDS} as w from documents),
b as (select item_id, {WORDS} as w from benchmark),
phrase as (
    select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as phrase
    from (select item_id, w, least(10, len(w)) as n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i
          from b where len(w) > 0)),
lengths as (select distinct n from phrase),
spot as (
    select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as phrase
    from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, lengths where len(w) >= n)),
hit as (select distinct doc_id, i, n, item_id from spot join phrase using (n, phrase)),
hit_words as (select doc_id, count(distinct p) as n_hit
              from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
hit_items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
              from (select distinct doc_id, item_id::varchar as item from hit) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit_words using (doc_id) left join hit_items using (doc_id)"""

URL_RULES = """
with parts as (
    select page_id, regexp_extract(url, '://([^/?#]*)([^?#]*)', ['h', 'p']) as hp from pages),
url as (
    select page_id,
           translate(coalesce(hp.h, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           coalesce(hp.p, '') as path from parts),
rules(h, p, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
    ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fit as (
    select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as verdict
    from url join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from url left join fit using (page_id)"""

QUALITY = r"""
with d as (
    select doc_id, coalesce(text, '') as t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (
    select doc_id, i, array_to_string(w[i:i + 7], ' ') as x
    from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, x) as c from windows) where c > 1),
repeats as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 8)) as p from twice)
            group by doc_id),
lines as (
    select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup
    from (select doc_id, unnest(string_split(t, chr(10))) as line from d)
    where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
m as (
    select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
           len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(n_dup, 0)::bigint as n_dup_lines,
           coalesce(n_lines, 0) as n_lines, coalesce(n, 0)::bigint as n_repeat_words
    from d left join repeats using (doc_id) left join lines using (doc_id)),
v as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or 10 * n_symbols > n_words or (2 * n_dup_lines > n_lines and n_dup_lines >= 4)
            or 4 * word_chars < 5 * n_words or word_chars > 25 * n_words) as kept
from v"""


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LEXICAL_SEARCH = f"""WITH
    w AS (SELECT row_number() OVER () AS row, doc_id,
        regexp_extract_all({_LOWER}, '{_TERM}') AS terms FROM documents),
    d AS (SELECT row, doc_id, len(terms) AS n, terms FROM w WHERE len(terms) > 0),
    t AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM d),
    i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id,
        unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM benchmark) GROUP BY ALL),
    p AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM d)
        WHERE term IN (SELECT term FROM i) GROUP BY ALL),
    f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, t GROUP BY term, docs),
    s AS (SELECT item_id, row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)))) AS BIGINT) AS score
        FROM p JOIN f USING (term) JOIN i USING (term), t GROUP BY ALL)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
    FROM s WHERE score > 0 QUALIFY rank <= 20"""
