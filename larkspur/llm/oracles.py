"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from larkspur.llm.line_rules import BOILERPLATE

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = r"[\x20\x09-\x0D]"
_WORDS = rf"[x FOR x IN regexp_split_to_array(t, '{BLANK}+') IF x <> '']"
_CHARS = rf"length(regexp_replace({{}}, '{BLANK}+', '', 'g'))"


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


LINE_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {_WORDS} AS ws FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS s FROM w, unnest(range(1, len(ws) - 6)) u(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, unnest(range(0, 8)) r(k) GROUP BY 1),
l AS (SELECT doc_id, line, concat(line, ' ') AS e, {_count("line", rf"[^\x20\x09-\x0D]+")} AS n, {_CHARS.format("line")} AS c FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
f AS (SELECT doc_id, line, n, c, n > 0 AND (
  ({_count("line", r"[|»›·•]|[\x20\x09]>[\x20\x09]")} >= greatest(2, 0.15 * n)) OR
  ({_count("e", rf"[#*$%&<>\\^~={{}}]{BLANK}")} >= greatest(2, 0.3 * n)) OR
  ({_count("e", rf"!!{BLANK}")} >= greatest(3, 0.5 * n)) OR
  (n <= 40 AND regexp_matches(concat(' ', line), '(?i)[^a-z](?:{"|".join(BOILERPLATE)})(?:[^a-z]|\z)|©')) OR
  NOT regexp_matches(line, '[.!?:;…。！？]["''”’»)\]]*{BLANK}*\z')) AS bad FROM l),
g AS (SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines, count(*) FILTER (bad) AS n_failed_lines, coalesce(sum(c) FILTER (bad), 0) AS lost FROM f GROUP BY 1),
b AS (SELECT w.doc_id, len(ws) AS n_words, {_CHARS.format("t")} AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
  n_failed_lines, lost FROM w JOIN g USING (doc_id) LEFT JOIN cov USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CASE WHEN word_chars > 0 THEN CAST(lost AS DOUBLE) / word_chars ELSE 1.0 END AS share FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND share <= 0.7 AS kept, n_failed_lines, round(share, 6) AS lost_share FROM v"""

_RULES = (("example.net/en/", "example.net", "/en/", "allow"), ("example.com/de/", "example.com", "/de/", "block"), ("org/fr/", "org", "/fr/", "allow"), ("net/", "net", "/", "block"))


def _fit(host: str, path: str, column: int) -> str:
    return "CASE " + " ".join(f"WHEN ({host} = '{r[1]}' OR ends_with({host}, '.{r[1]}')) AND starts_with({path}, '{r[2]}') THEN '{r[column]}'" for r in _RULES) + " END"


def _rest(url: str) -> str:
    return f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"


def _host(rest: str) -> str:
    return f"translate(regexp_extract({rest}, '^[^/?#]*'), '{UPPER}', '{LOWER}')"


def _clean(path: str) -> str:
    """Path without dot segments: a list is built step by step, ``..`` takes its last entry off."""
    steps = f"string_split(substr({path}, 2), '/')"
    folded = f"list_reduce(list_prepend([''], list_transform({steps}, lambda s: [s])), lambda a, s: CASE s[1] WHEN '.' THEN a WHEN '..' THEN a[1 : greatest(1, len(a) - 1)] ELSE a || s END)"
    return f"CASE WHEN {path} = '' THEN '/' WHEN {path} NOT LIKE '%/.%' THEN {path} ELSE array_to_string({folded}, '/') || CASE WHEN {steps}[-1] IN ('.', '..') THEN '/' ELSE '' END END"


def _value(name: str) -> str:
    """What an attribute of a tag says, in quotes of either kind or bare."""
    return "concat_ws('', " + ", ".join(f"regexp_extract(tag, '(?i)\\s{name}\\s*=\\s*{x}', 1)" for x in ('"([^"]*)"', "''([^'']*)''", "([^\"''\\s>]+)")) + ")"


URL_FILTER = rf"""
WITH RECURSIVE p AS (SELECT page_id, html, {_rest("url")} AS rest FROM pages),
q AS (SELECT page_id, html, {_host("rest")} AS host, regexp_extract(regexp_extract(rest, '^[^#]*'), '^[^/?]*([^?]*)', 1) AS path, regexp_extract(regexp_extract(rest, '^[^#]*'), '\?.*$') AS query FROM p),
n AS (SELECT *, CASE WHEN host = '' THEN '' ELSE host || {_clean("path")} || query END AS node FROM q),
tags AS (SELECT node, host, path, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?(?:-->|\z)', '', 'g'), '(?i)<(?:link|meta)\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>')) AS tag FROM n WHERE host <> '' AND regexp_matches(html, '(?i)canonical|refresh')),
raw AS (SELECT node, host, path, CASE
  WHEN starts_with(lower(tag), '<link') THEN CASE WHEN list_contains(string_split_regex(lower({_value("rel")}), '\s+'), 'canonical') THEN {_value("href")} END
  WHEN lower({_value("http-equiv")}) = 'refresh' THEN regexp_extract({_value("content")}, '(?i)^[^;,]*[;,]\s*url\s*=\s*["'']?([^"'']*)', 1) END AS link FROM tags),
lk AS (SELECT node, host, path, regexp_extract(trim(replace(replace(replace(replace(replace(link, '&quot;', '"'), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')), '^[^#]*') AS link FROM raw WHERE link IS NOT NULL),
m AS (SELECT node, host, path, link, lower(regexp_extract(link, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, {_rest("CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")} AS rest FROM lk WHERE link <> ''),
parts AS (SELECT node AS u, CASE
    WHEN starts_with(link, '//') OR scheme IN ('http', 'https') THEN struct_pack(h := {_host("rest")}, p := regexp_extract(rest, '^[^/?]*([^?]*)', 1), q := regexp_extract(rest, '\?.*$'))
    WHEN scheme <> '' THEN struct_pack(h := '', p := '', q := '')
    WHEN starts_with(link, '/') THEN struct_pack(h := host, p := regexp_extract(link, '^[^?]*'), q := regexp_extract(link, '\?.*$'))
    WHEN starts_with(link, '?') THEN struct_pack(h := host, p := path, q := link)
    ELSE struct_pack(h := host, p := CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^.*/') END || regexp_extract(link, '^[^?]*'), q := regexp_extract(link, '\?.*$')) END AS t FROM m),
e0 AS (SELECT u, t.h || {_clean("t.p")} || t.q AS v FROM parts WHERE t.h <> ''),
e AS (SELECT u, v FROM e0 WHERE u <> v UNION SELECT v, u FROM e0 WHERE u <> v),
bad AS (SELECT u AS node FROM e WHERE {_fit("regexp_extract(u, '^[^/?]*')", "regexp_extract(u, '^[^/?]*([^?]*)', 1)", 3)} = 'block' UNION SELECT e.v FROM bad JOIN e ON e.u = bad.node)
SELECT page_id, host, path, {_fit("host", "path", 0)} AS rule, coalesce({_fit("host", "path", 3)}, CASE WHEN node IN (SELECT node FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM n"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT doc_id, {_WORDS} AS ws FROM d),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE [array_to_string(ws[i : i + 3], ' ') FOR i IN range(1, len(ws) - 2)] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
r AS (SELECT doc_id AS s, doc_id AS t FROM d UNION SELECT r.s, e.b FROM r JOIN e ON e.a = r.t)
SELECT s AS doc_id, coalesce(n.n, 0) AS n_shingles, min(t) AS component_id FROM r LEFT JOIN n ON n.doc_id = s GROUP BY 1, 2"""

ORACLE_SQL = {"op5_line_rules": LINE_RULES, "op8_url_filter": URL_FILTER, "op10_jaccard": JACCARD}
