"""DuckDB SQL of the queries that SQL can express, written from their contracts."""

from __future__ import annotations

from .secrets import BASE, RULES, plain

REPEATS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM starts),
counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS p FROM counted WHERE n > 1),
words AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS p, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS line, count(*) AS n
         FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.line, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""

#: Every order is replayed over every document: the first filter of the order that a document fails removes it.
FILTER_AUDIT = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY x) AS first FROM t),
d AS (SELECT part, doc_id,
        CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]+', '', 'g')) > 2 * length(x) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS failed,
        EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND l.quality = 1) AS good,
        EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND l.toxic = 1) AS toxic
      FROM w),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || e.f || g.f AS filter_order FROM letters a, letters b, letters c, letters e, letters g
           WHERE len(list_distinct([a.f, b.f, c.f, e.f, g.f])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS f FROM orders, range(1, 6) r(step)),
fates AS (SELECT part, failed, filter_order, list_min(list_transform(string_split(failed, ''), lambda c: strpos(filter_order, c))) AS place,
                 count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
          FROM d, orders WHERE failed <> '' GROUP BY ALL),
parts AS (SELECT part, count(*) AS total FROM d GROUP BY part),
per AS (SELECT p.part, s.filter_order, s.step, s.f, p.total,
          coalesce(sum(n) FILTER (place <= step), 0) AS gone, coalesce(sum(n) FILTER (place = step), 0) AS removed,
          coalesce(sum(n) FILTER (place < step AND contains(failed, f)), 0) AS redundant,
          coalesce(sum(n) FILTER (failed = f), 0) AS unique_fails,
          coalesce(sum(good) FILTER (place = step), 0) AS good_lost, coalesce(sum(toxic) FILTER (place = step), 0) AS toxic_lost
        FROM parts p CROSS JOIN steps s LEFT JOIN fates x ON x.part = p.part AND x.filter_order = s.filter_order
        GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(total - gone AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM per
"""


def _matches(rank: int, rule) -> str:
    """Spans of one rule: what lies between matches, and the matches, add up to their places."""
    p = plain(rule.pattern).replace("'", "''")
    return f"""
SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind,
       list_sum(list_transform(b[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS start,
       length(m[k]) AS n, length(g[k]) AS own, {rule.least} AS least
FROM (SELECT *, unnest(generate_series(1, len(m))) AS k
      FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {rule.group}) AS g,
                   string_split_regex(text, '{p}') AS b FROM documents WHERE text IS NOT NULL))"""


SECRETS = f"""
WITH found AS ({" UNION ALL ".join(_matches(i, r) for i, r in enumerate(RULES))}),
spans AS (SELECT doc_id, rank, kind, start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT) AS s
          FROM found WHERE own >= least),
per AS (SELECT doc_id, {", ".join(f"count(*) FILTER (rank = {i}) AS n_{k}" for i, k in enumerate(BASE))},
               string_agg(s, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}) AS base,
               string_agg(s, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN per USING (doc_id)
"""
