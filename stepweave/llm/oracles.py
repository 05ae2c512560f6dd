"""DuckDB SQL for the queries that SQL can express, over whole tables. The others are tested against brute force."""

from __future__ import annotations

from .quality import AFTER, BARS, BOILERPLATE, ENDS, MARKS, SYMBOLS, LineRules
from .urls import BLOCKED_HOSTS

WHITE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


MIX = f"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
    CASE WHEN length(text) > 0 THEN greatest(0.1::DOUBLE, 1.0::DOUBLE - 5.0::DOUBLE * length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) / length(text)) ELSE 0.1::DOUBLE END AS weight FROM documents),
  k AS (SELECT *, -ln((('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE) / weight AS key FROM d),
  s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
  t AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w, source_size * 2.0::DOUBLE AS most FROM s),
  l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM t),
  m AS (SELECT *, most <= level * w AS filled FROM l),
  n AS (SELECT *, max(CASE WHEN NOT filled THEN level END) OVER () AS own FROM m),
  p AS (SELECT source, source_size, CASE WHEN filled OR own IS NULL THEN most ELSE least(most, own * w) END AS target FROM n),
  q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM p),
  r AS (SELECT k.doc_id, k.size, q.source_size, q.target, q.epochs, q.target - q.epochs * q.source_size AS rest,
      sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM k JOIN q ON k.source IS NOT DISTINCT FROM q.source)
  SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN e <= rest OR (e - size < rest AND e - rest <= rest - (e - size)) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r"""

NEAR = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("text")}, '{WORD}') AS w FROM documents),
  g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
  c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
  e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
  duo AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  reach AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, duo.b FROM reach r JOIN duo ON duo.a = r.u),
  m AS (SELECT v, min(u) AS component_id FROM reach GROUP BY v)
  SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.v = d.doc_id"""

LEAKS = f"""WITH b AS (SELECT item_id, regexp_extract_all({LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
  win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + 9], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
  sizes AS (SELECT DISTINCT n FROM win),
  d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
  own AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
  hit AS (SELECT own.doc_id, own.i, own.n, win.item_id FROM own JOIN win ON own.s = win.s AND own.n = win.n),
  cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
  it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY 1)
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)"""

SUBSTRINGS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
  w AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 100)) AS x, md5_number_lower(substr(h, 2 * i + 1, 100)) AS y FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d)),
  f AS (SELECT x, y, min(doc_id) AS least FROM w GROUP BY 1, 2 HAVING count(*) > 1),
  r AS (SELECT w.doc_id, w.i FROM w JOIN f ON w.x = f.x AND w.y = f.y WHERE w.doc_id > f.least),
  o AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM r),
  z AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM o),
  s AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM z GROUP BY 1, 2),
  k AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM s UNION ALL SELECT d.doc_id, coalesce(max(b), 0), any_value(n) FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id),
  p AS (SELECT k.doc_id, string_agg(substr(h, (2 * f + 1)::BIGINT, (2 * (t - f))::BIGINT), '' ORDER BY f) AS kept FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY 1),
  c AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM s GROUP BY 1)
  SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(p.kept)) AS kept_sha256
  FROM d LEFT JOIN c ON c.doc_id = d.doc_id JOIN p ON p.doc_id = d.doc_id"""


def url_sql(rules) -> str:
    own = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    hosts = ", ".join(f"('{h}')" for h in BLOCKED_HOSTS)
    return f"""WITH r(h, p, v) AS (VALUES {own}), b(h) AS (VALUES {hosts}),
  u AS (SELECT page_id, {LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
  f AS (SELECT page_id, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.v, length(r.h || r.p)) AS v FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p) GROUP BY 1),
  x AS (SELECT DISTINCT page_id FROM u JOIN b ON u.host = b.h OR ends_with(u.host, '.' || b.h))
  SELECT u.page_id, host, path, rule, coalesce(v, CASE WHEN x.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM u LEFT JOIN f ON f.page_id = u.page_id LEFT JOIN x ON x.page_id = u.page_id"""


def quality_sql(rules: LineRules = LineRules()) -> str:
    count = lambda c, chars: f"(length({c}) - length(regexp_replace({c}, '[{chars}]', '', 'g')))"
    n = f"len(regexp_extract_all(l, '{WORD}'))"
    symbols, bars, marks = count("l", SYMBOLS), count("l", BARS), count("l", MARKS)
    after = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || '\"''”’»)]'"
    assert AFTER == " \t\n\x0b\x0c\r\"'”’»)]"
    noisy = f"({symbols} > {rules.symbols_per_word} * {n} OR ({bars} >= {rules.separators} AND {bars} > {rules.separators_per_word} * {n}) OR ({n} >= {rules.min_words} AND {marks} > {rules.marks_per_word} * {n}))"
    phrase = f"len(list_filter({_list(BOILERPLATE)}, lambda x: contains(lower(l), x))) > 0"
    good = f"(list_contains({_list(ENDS)}, right(rtrim(l, {after}), 1)) OR {n} < {rules.min_words}) AND NOT {noisy} AND NOT {phrase}"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM documents),
  g AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
  h AS (SELECT doc_id, s FROM g GROUP BY 1, 2 HAVING count(*) > 1),
  c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT g.doc_id, unnest([i, i + 1, i + 2]) AS p FROM g JOIN h ON g.doc_id = h.doc_id AND g.s = h.s) GROUP BY 1),
  e AS (SELECT doc_id, l FROM (SELECT doc_id, unnest(lines) AS l FROM d)),
  k AS (SELECT doc_id, sum(length(l)) AS whole, coalesce(sum(length(l)) FILTER ({good}), 0) AS good FROM e GROUP BY 1),
  b AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
      coalesce(1.0::DOUBLE - good::DOUBLE / whole::DOUBLE, 0) <= {rules.max_lost} AS fine FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND fine AS kept FROM b"""
