"""The same results as SQL over the given tables, where SQL can express them."""

from __future__ import annotations

from accountloom.llm.templates import UNITS

_UNITS = ", ".join(f"'{u}'" for u in UNITS)


# twice: the second letter of a two-letter name may be the one before the next name
_NAMED = ("regexp_replace({x}, '([\\p{{Ll}}\\p{{N}},;:][ \\t\\n\\x0b\\f\\r])(\\p{{Lu}}\\p{{Ll}})', "
          "'\\1' || chr(57344) || '\\2', 'g')")


def _templates(source: str, key: str) -> str:
    """Words and template of every text, as lists."""
    return f"""
  SELECT {key}, words,
    list_transform(range(1, len(words) + 1), lambda i: CASE
      WHEN starts_with(words[i], chr(57344)) THEN chr(57344)
      WHEN starts_with(words[i], chr(57345)) THEN chr(57345)
      WHEN i > 1 AND starts_with(words[i - 1], chr(57345)) AND words[i] IN ({_UNITS}) THEN chr(57346)
      ELSE words[i] END) AS shape
  FROM (SELECT {key}, list_filter(string_split_regex(regexp_replace(regexp_replace(lower(marked),
          '(^|[^0-9])[.,:/]+', '\\1 ', 'g'), '[.,:/]+([^0-9]|$)', ' \\1', 'g'),
          '[^\\p{{L}}\\p{{M}}\\p{{N}}.,:/' || chr(57344) || chr(57345) || ']+'), lambda w: w <> '') AS words
        FROM (SELECT {key}, regexp_replace(named, '([0-9]+(?:[.,:/][0-9]+)*)', ' ' || chr(57345) || '\\1 ', 'g') AS marked
              FROM (SELECT {key}, {_NAMED.format(x=_NAMED.format(x='text'))} AS named
                    FROM {source} WHERE text IS NOT NULL))) WHERE len(words) > 0"""


def _windows(key: str, source: str, size: int = 8) -> str:
    return f"""
  SELECT {key}, i AS pos, shape[i:i + {size - 1}] AS shape,
    list_filter(list_transform(range(i, i + {size}), lambda k: CASE WHEN words[k] <> shape[k] THEN words[k] END),
                lambda v: v IS NOT NULL) AS slots
  FROM (SELECT *, unnest(range(1, len(words) - {size - 2})) AS i FROM {source} WHERE len(words) >= {size})"""


DECONTAMINATION = f"""
WITH d AS ({_templates('documents', 'doc_id')}),
b AS ({_templates('benchmark', 'item_id')}),
bw AS (SELECT * FROM ({_windows('item_id', 'b')}) WHERE len(slots) <= 8 * 0.4),
wanted AS (SELECT item_id, count(*) AS windows FROM bw GROUP BY 1),
hits AS (SELECT doc_id, bw.item_id, bw.pos,
           len(list_filter(range(1, len(bw.slots) + 1), lambda k: bw.slots[k] <> dw.slots[k])) AS changed
         FROM ({_windows('doc_id', 'd')}) dw JOIN bw ON dw.shape = bw.shape
         WHERE len(list_distinct(list_zip(bw.slots, dw.slots))) = len(list_distinct(bw.slots))
           AND len(list_distinct(list_zip(bw.slots, dw.slots))) = len(list_distinct(dw.slots))),
places AS (SELECT doc_id, item_id, pos, min(changed) AS changed FROM hits GROUP BY 1, 2, 3),
found AS (SELECT doc_id, item_id, count(*) AS matched, max(changed) AS slots_changed FROM places GROUP BY 1, 2)
SELECT doc_id, item_id, matched, windows, slots_changed = 0 AS verbatim,
       CAST(slots_changed AS INTEGER) AS slots_changed
FROM found JOIN wanted USING (item_id) WHERE matched >= windows * 0.25
"""

URL_RULES = r"""
WITH RECURSIVE parsed AS (
  SELECT page_id, url, html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*(\?[^#]*)', 1), '') AS query
  FROM pages),
targets AS (
  SELECT host, path, query, url, replace(trim(coalesce(
    nullif(regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'),
                   '(?is)\bhref\s*=\s*["'']?([^"''>\s]*)', 1), ''),
    regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'),
                   '(?is)\burl\s*=\s*["'']?([^"''>]+)', 1))), '&amp;', '&') AS href
  FROM parsed WHERE url LIKE '%://%'),
absolute AS (
  SELECT host || CASE WHEN path = '' THEN '/' ELSE path END || query AS u,
    CASE WHEN href LIKE '%://%' THEN href WHEN starts_with(href, '//') THEN 'x:' || href
         WHEN starts_with(href, '/') THEN 'x://' || host || href END AS target
  FROM targets WHERE href <> ''),
links AS (
  SELECT DISTINCT u, lower(regexp_extract(target, '(?s)^.*?://([^/?#]*)', 1))
    || CASE WHEN regexp_extract(target, '(?s)^.*?://[^/?#]*([^?#]*)', 1) = '' THEN '/'
            ELSE regexp_extract(target, '(?s)^.*?://[^/?#]*([^?#]*)', 1) END
    || coalesce(regexp_extract(target, '(?s)^.*?://[^?#]*(\?[^#]*)', 1), '') AS v
  FROM absolute WHERE target IS NOT NULL),
edges AS (SELECT u, v FROM links WHERE u <> v UNION SELECT v, u FROM links WHERE u <> v),
reach AS (SELECT u AS node, u AS seen FROM edges
          UNION SELECT reach.node, edges.v FROM reach JOIN edges ON reach.seen = edges.u),
ruled AS (
  SELECT node, seen, regexp_extract(seen, '^([^/?]*)', 1) AS host, regexp_extract(seen, '^[^/?]*([^?]*)', 1) AS path
  FROM reach),
blocked AS (
  SELECT node, bool_or(CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN false
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN true
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN true
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN true
    ELSE false END) AS blocked
  FROM ruled GROUP BY node),
judged AS (
  SELECT *, host || CASE WHEN path = '' THEN '/' ELSE path END || query AS place, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parsed)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM judged LEFT JOIN blocked ON judged.place = blocked.node
"""

# every language's phrases of one to three words inside pieces, their weakest cuts, and the first 2000
COLLOCATIONS = r"""
with pieces as (
  select row_number() over () as piece, lang, words from (
    select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from (
      select coalesce(lang, 'und') as lang,
             unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
      from documents)) where len(words) > 0),
grams as (
  select lang, g.n as words, unnest(list_transform(range(1, len(p.words) - g.n + 2),
         lambda i: array_to_string(p.words[i:i + g.n - 1], ' '))) as phrase
  from pieces p, (values (1), (2), (3)) g(n) where len(p.words) >= g.n),
counted as materialized (select lang, words, phrase, count(*) as f from grams group by all),
totals as (select lang, sum(f) as n from counted where words = 1 group by lang),
candidates as materialized (select *, string_split(phrase, ' ') as w from counted where words > 1 and f >= 10),
parts as (
  select lang, phrase, words, f as a, k, array_to_string(w[1:k], ' ') as left_part,
         array_to_string(w[k + 1:words], ' ') as right_part
  from candidates, (values (1), (2)) t(k) where k < words),
lefts as materialized (
  select p.*, c.f as l from parts p join counted c on c.lang = p.lang and c.phrase = p.left_part),
cuts as (
  select p.lang, p.phrase, p.words, a, k, l, c.f as r,
         (1000000::hugeint * a::hugeint * a::hugeint) // (l::hugeint * c.f::hugeint) as score
  from lefts p join counted c on c.lang = p.lang and c.phrase = p.right_part),
weakest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
longer as (
  select lang, phrase, max(f) as f from (
    select lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase, f
    from candidates where words = 3) group by lang, phrase),
kept as (
  select w.* from weakest w left join longer g on g.lang = w.lang and g.phrase = w.phrase and w.words = 2
  where g.f is null or 100 * g.f < 50 * w.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n,
       score::bigint as score, words, k as cut
from ranked join totals using (lang) where rank <= 2000
"""

# ten different-label rows of each anchor's first five rows of its own label, by integer inner product
HARD_NEGATIVES = """
with vectors as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as positive,
         list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::bigint as score
  from vectors a join vectors b on a.vec_id % 100 = 0 and (a.label <> b.label or a.vec_id <> b.vec_id)),
positives as (
  select anchor_id, id as positive_id, score as positive_score from scores where positive
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, p.positive_id,
       (row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.id))::int as rank,
       s.id as negative_id, p.positive_score, s.score as negative_score
from positives p join scores s on s.anchor_id = p.anchor_id and not s.positive
 and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
qualify rank <= 10
"""
