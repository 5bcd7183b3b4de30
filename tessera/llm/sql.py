"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .quality import GROUP_DOCUMENTS, MEASURES

#: The bins of quality.BIN in DuckDB's words.
_BIN = "CASE WHEN v < 64 THEN v ELSE length(bin(v)) * 64 + (v >> (length(bin(v)) - 6)) END"
_LOW = "CASE WHEN b < 64 THEN b ELSE (b % 64) << CAST(b // 64 - 6 AS INT) END"
_HIGH = "CASE WHEN b < 64 THEN b ELSE ((b % 64 + 1) << CAST(b // 64 - 6 AS INT)) - 1 END"


def _quality(source: str = "documents") -> str:
    """CTEs ending in judged: all columns of source, the counts, base_failed, kept."""
    measures = ", ".join(f"{sql.replace(' div ', ' // ')} AS m_{name}" for name, sql, *_ in MEASURES)
    values = " UNION ALL ".join(f"SELECT lang, source, {i} AS measure, m_{m[0]} AS v FROM f WHERE NOT base_failed" for i, m in enumerate(MEASURES))
    least = lambda k, edge: f"min(CASE WHEN 100 * upto >= (CASE measure {' '.join(f'WHEN {i} THEN {m[k]}' for i, m in enumerate(MEASURES))} END) * total THEN {edge} END)"
    level = lambda keys, name: f"""{name}_c AS (SELECT {keys}measure, b, sum(n) AS n FROM sketch GROUP BY {keys}measure, b),
{name}_u AS (SELECT *, sum(n) OVER (PARTITION BY {keys}measure ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {keys}measure) AS total FROM {name}_c),
{name}_q AS (SELECT {keys}measure, max(total) AS total, {least(2, _LOW)} AS q1, {least(3, _HIGH)} AS q3 FROM {name}_u GROUP BY {keys}measure)"""  # noqa: E731
    fence = f"""fence AS (SELECT p.lang, p.source, p.measure,
  CASE WHEN p.total >= {GROUP_DOCUMENTS} THEN p.q1 WHEN l.total >= {GROUP_DOCUMENTS} THEN l.q1 ELSE a.q1 END AS q1,
  CASE WHEN p.total >= {GROUP_DOCUMENTS} THEN p.q3 WHEN l.total >= {GROUP_DOCUMENTS} THEN l.q3 ELSE a.q3 END AS q3
  FROM source_q p JOIN lang_q l ON p.measure = l.measure AND p.lang IS NOT DISTINCT FROM l.lang JOIN all_q a ON p.measure = a.measure)"""
    inside = []
    for i, (name, _, _, _, reach, count) in enumerate(MEASURES):
        test = f"f.m_{name} <= q3 + {reach} * (q3 - q1)"
        test = f"({test} AND f.m_{name} >= q1 - {reach} * (q3 - q1))" if count is None else f"({test} OR f.{count} = 0)"
        inside.append(f"EXISTS (SELECT 1 FROM fence x WHERE x.measure = {i} AND x.lang IS NOT DISTINCT FROM f.lang AND x.source IS NOT DISTINCT FROM f.source AND {test})")
    return rf"""texts AS (SELECT *, row_number() OVER () AS r_, coalesce(text, '') AS t_ FROM {source}),
split AS (SELECT r_, list_filter(regexp_split_to_array(t_, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t_, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM texts),
wins AS (SELECT r_, list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i+7], ' ')) AS win FROM split WHERE len(ws) >= 8),
win AS (SELECT r_, unnest(win) AS w, generate_subscripts(win, 1) AS i FROM wins),
twice AS (SELECT r_, i FROM (SELECT r_, i, count(*) OVER (PARTITION BY r_, w) AS n FROM win) WHERE n > 1),
rep AS (SELECT r_, sum(least(8, coalesce(nx - i, 8))) AS n FROM (SELECT r_, i, lead(i) OVER (PARTITION BY r_ ORDER BY i) AS nx FROM twice) GROUP BY r_),
c AS (SELECT texts.*, len(ws) AS n_words, length(regexp_replace(t_, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(t_) - length(regexp_replace(t_, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM texts JOIN split USING (r_) LEFT JOIN rep USING (r_)),
d AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
f AS (SELECT d.*, {measures} FROM d WHERE NOT base_failed UNION ALL BY NAME SELECT d.* FROM d WHERE base_failed),
vals AS ({values}),
sketch AS (SELECT lang, source, measure, {_BIN} AS b, count(*) AS n FROM vals GROUP BY ALL),
{level('lang, source, ', 'source')},
{level('lang, ', 'lang')},
{level('', 'all')},
{fence},
judged AS (SELECT f.*, NOT base_failed AND {" AND ".join(inside)} AS kept FROM f)"""


OP1 = f"""WITH {_quality()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"""


def _headers(*pairs: tuple[str, str]) -> str:
    """The lines of a header, sorted by name; a null value gives no line."""
    return "md5(concat_ws(chr(10), " + ", ".join(f"'{k}: ' || {v}" for k, v in sorted(pairs)) + "))"


URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)\??(.*)$"
_HOST = f"regexp_replace(lower(regexp_extract(u, '{URL}', 2)), '^[^@]*@', '')"
_PORT = f"CASE WHEN lower(regexp_extract(u, '{URL}', 1)) = 'http' THEN regexp_replace({_HOST}, ':80$', '') WHEN lower(regexp_extract(u, '{URL}', 1)) = 'https' THEN regexp_replace({_HOST}, ':443$', '') ELSE {_HOST} END"

OP9 = rf"""WITH cut AS (SELECT page_id, md5(coalesce(html, '')) AS tag, CAST(strlen(html) AS VARCHAR) AS size, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
parts AS (SELECT *, regexp_matches(u, '{URL}') AS ok, {_PORT} AS h, regexp_extract(u, '{URL}', 3) AS p,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '{URL}', 4), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|fbclid|gclid)(=.*)?$'))), '&') AS q FROM cut),
named AS (SELECT page_id, tag, size, CASE WHEN ok THEN regexp_replace(h, '^www\.', '') || regexp_replace(p, '/+$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END ELSE lower(u) END AS canonical FROM parts),
full_ AS (SELECT page_id, canonical, 2 * page_id AS "at", tag, size FROM named),
again AS (SELECT page_id, canonical, CASE WHEN page_id % 7 = 3 THEN 2 * page_id - 1 ELSE 3 * page_id + 1 END AS "at", CASE WHEN page_id % 11 <> 4 THEN CASE WHEN page_id % 5 = 2 THEN md5(tag) ELSE tag END END AS tag FROM named),
joined AS (SELECT a.*, r.page_id AS r_page, r.tag AS r_tag, r.size AS r_size FROM again a ASOF LEFT JOIN full_ r ON a.canonical = r.canonical AND a."at" > r."at"),
done AS (SELECT *, CASE WHEN r_page IS NULL THEN 'missing' WHEN tag IS NULL THEN 'unverified' WHEN tag = r_tag THEN 'resolved' ELSE 'changed' END AS status FROM joined)
SELECT 2 * page_id AS record_id, 'response' AS kind, canonical, "at", NULL AS status, CAST(NULL AS BIGINT) AS response_id,
  {_headers(("etag", "tag"), ("date", 'CAST("at" AS VARCHAR)'), ("content-type", "'text/html'"), ("content-length", "size"))} AS headers_md5 FROM full_
UNION ALL SELECT 2 * page_id + 1, 'revisit', canonical, "at", status, CASE WHEN status = 'resolved' THEN 2 * r_page END,
  CASE WHEN status = 'resolved' THEN {_headers(("etag", "'W/' || tag"), ("date", 'CAST("at" AS VARCHAR)'), ("content-type", "'text/html'"), ("content-length", "r_size"))}
  ELSE {_headers(("etag", "'W/' || tag"), ("date", 'CAST("at" AS VARCHAR)'), ("content-type", "'message/http'"))} END FROM done"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Pairs by common shingles, then the least id that the links reach.
OP5 = rf"""WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) END AS s FROM words),
sig AS (SELECT md5(array_to_string(list_sort(s), chr(10))) AS k, any_value(s) AS s, min(doc_id) AS least FROM sets WHERE len(s) > 0 GROUP BY 1),
grams AS (SELECT k, len(s) AS n, unnest(s) AS g FROM sig),
shared AS (SELECT a.k AS a, b.k AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM grams a JOIN grams b ON a.g = b.g AND a.k <> b.k AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT a, b FROM shared WHERE 100 * c >= 90 * (na + nb - c)),
reach AS (SELECT k AS a, k AS b FROM sig UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_ AS (SELECT r.a AS k, min(x.least) AS component_id FROM reach r JOIN sig x ON r.b = x.k GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, CASE WHEN len(s) = 0 THEN doc_id ELSE component_id END AS component_id FROM sets LEFT JOIN least_ ON md5(array_to_string(list_sort(s), chr(10))) = k"""

#: What is read back is what was there; the formatted text has the marks and a backslash for each control string in a content.
OP8 = r"""WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
marked AS (SELECT *, replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n') AS head FROM said),
sized AS (SELECT *, length('<|im_start|><|im_end|>') + 2 + length(head) + len(regexp_extract_all(head, '<\\*\|')) + length(text) + len(regexp_extract_all(text, '<\\*\|')) AS size FROM marked)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars FROM sized GROUP BY conv_id"""
