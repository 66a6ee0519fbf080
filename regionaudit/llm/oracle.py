"""SQL (DuckDB) for the queries that SQL can express: texts only, nothing is computed here."""

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JOIN = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text=_FOLD)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) m ON m.x = d.doc_id
"""

URL_FILTERS = r"""
WITH rules(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
rest AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
fits AS (SELECT DISTINCT p.host, p.path, r.host || r.path AS rule, r.verdict FROM parts p JOIN rules r ON ('.' || p.host) LIKE ('%.' || r.host) AND starts_with(p.path, r.path)),
best AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fits GROUP BY host, path)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""

def quality_rules() -> str:
    from . import quality_rules as q

    tests = []
    for r in q.RULES:
        bad = " OR ".join([f"100 * {r.count} < {r.least} * {r.of}"] * (r.least is not None) + [f"100 * {r.count} > {r.most} * {r.of}"] * (r.most is not None))
        tests.append(f"(({bad}) AND n_words >= {r.words})")
    stops = ", ".join(f"'{w}'" for w in q.STOP_WORDS)
    spaces = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format(text="coalesce(text, '')")} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(translate(x, {spaces}, '')) > 0) AS lines FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 6, 1))) AS t(i)),
rep AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM win JOIN (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1) USING (doc_id, g)),
cov AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM rep GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(translate(text, {spaces}, ''))::BIGINT AS word_chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(w, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop_words, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}')))::BIGINT AS n_alphabetic
      FROM d LEFT JOIN cov USING (doc_id)),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({' OR '.join(tests)}) AS kept FROM j
"""


SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 34], ' ')) AS g FROM d, unnest(range(1, greatest(len(w) - 33, 1))) AS t(i)),
rep AS (SELECT DISTINCT doc_id, i + k AS i FROM win JOIN (SELECT g FROM win GROUP BY g HAVING count(*) > 1) USING (g), unnest(range(35)) AS u(k)),
gone AS (SELECT doc_id, list(i) AS gone FROM rep GROUP BY doc_id),
pos AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM pos ANTI JOIN rep USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(len(gone.gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLE: dict[str, str] = {
    "op1_ngram_jaccard_join": NGRAM_JOIN,
    "op2_url_filters": URL_FILTERS,
    "op7_quality_rules": quality_rules(),
    "op8_substring_dedup": SUBSTRING_DEDUP,
}
