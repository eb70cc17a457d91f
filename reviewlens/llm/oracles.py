"""SQL for the operators that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def ngram_jaccard(words: int, percent: int) -> str:
    """Sets of word shingles, all linked pairs by their shared shingles, and what each document reaches."""
    last = words - 1
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE
    WHEN len(words) >= {words} THEN list_distinct(list_transform(range(1, len(words) - {last} + 1), lambda i: array_to_string(words[i:i + {last}], ' ')))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE CAST([] AS VARCHAR[]) END AS g
  FROM w
), n AS (SELECT doc_id, len(g) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS x FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b USING (x) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * i >= {percent} * (na.n + nb.n - i)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM n
  UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r
)
SELECT doc_id, n AS n_shingles, min(r) AS component_id FROM n JOIN reach USING (doc_id) GROUP BY doc_id, n
"""


def _host(rest: str) -> str:
    return f"translate(regexp_extract({rest}, '^[^/?#]*'), {_UPPER}, {_LOWER})"


def _rule(host: str, path: str) -> str:
    def fits(domain: str, start: str) -> str:
        return f"(({host} = '{domain}' OR ends_with({host}, '.{domain}')) AND starts_with({path}, '{start}'))"

    return (
        f"CASE WHEN {fits('example.net', '/en/')} THEN 'example.net/en/' WHEN {fits('example.com', '/de/')} THEN 'example.com/de/' "
        f"WHEN {fits('org', '/fr/')} THEN 'org/fr/' WHEN {fits('net', '/')} THEN 'net/' END"
    )


def _verdict(rule: str) -> str:
    return f"CASE WHEN {rule} IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN {rule} IN ('net/', 'example.com/de/') THEN 'block' END"


def url_rules() -> str:
    """Rules by page; declared aliases by walking the links."""
    rest = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    path = "regexp_extract(rest, '^[^/?#]*([^?#]*)', 1)"
    more = "regexp_extract(rest, '^[^/?#]*([^#]*)', 1)"
    parts = f"{_host('rest')} AS host, {path} AS path, {_host('rest')} || CASE WHEN {more} = '' THEN '/' ELSE {more} END AS node"
    return f"""
WITH RECURSIVE own AS (
  SELECT page_id, url, html, coalesce(rest, '') AS rest FROM (SELECT page_id, url, html, {rest} AS rest FROM pages)
), page AS (SELECT page_id, url, html, {parts} FROM own),
tags AS (
  SELECT url, host, path, node, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\b[^>]*>')) AS tag FROM page WHERE contains(url, '://')
), named AS (
  SELECT url, path, node, CASE
    WHEN regexp_matches(tag, '(?i)^<link\\b') AND regexp_matches(tag, '(?i)\\brel\\s*=\\s*["'']?canonical\\b')
      THEN regexp_extract(tag, '(?i)\\bhref\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1)
    WHEN regexp_matches(tag, '(?i)^<meta\\b') AND regexp_matches(tag, '(?i)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')
      THEN regexp_extract(tag, '(?i)\\burl\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1) END AS target
  FROM tags
), placed AS (
  SELECT url, node, CASE WHEN contains(target, '://') THEN target WHEN starts_with(target, '//') THEN 'http:' || target
    WHEN starts_with(target, '/') THEN site || target ELSE site || CASE WHEN folder = '' THEN '/' ELSE folder END || target END AS goal
  FROM (SELECT *, regexp_extract(url, '^(?s:.*?)://[^/?#]*') AS site, regexp_extract(path, '^.*/') AS folder FROM named WHERE target <> '')
), goals AS (SELECT node AS a, url, goal, substr(goal, instr(goal, '://') + 3) AS rest FROM placed),
edges AS (SELECT a, url, goal, {parts.replace("AS node", "AS b").replace(" AS host", " AS goal_host").replace(" AS path", " AS goal_path")} FROM goals),
ends AS (
  SELECT page.node, {_verdict(_rule('page.host', 'page.path'))} AS v FROM page JOIN edges ON edges.a = page.node
  UNION ALL SELECT b, {_verdict(_rule('goal_host', 'goal_path'))} FROM edges
), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(node, r) AS (SELECT node, node FROM ends UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r),
inherited AS (
  SELECT reach.node, CASE WHEN max(CASE WHEN v = 'allow' THEN 1 END) = 1 THEN 'allow' WHEN max(CASE WHEN v = 'block' THEN 1 END) = 1 THEN 'block' END AS v
  FROM reach JOIN ends ON ends.node = reach.r GROUP BY reach.node
), ruled AS (SELECT page_id, url, host, path, node, {_rule('host', 'path')} AS rule FROM page)
SELECT page_id, host, path, rule, coalesce({_verdict('rule')}, v, 'allow') AS verdict FROM ruled LEFT JOIN inherited ON inherited.node = ruled.node AND contains(url, '://')
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": ngram_jaccard(4, 85), "op3_url_rules": url_rules()}
