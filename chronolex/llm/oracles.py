"""DuckDB SQL of the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
 b AS (SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
 wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS phrase FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
 grams AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
 hits AS (SELECT g.doc_id, g.i, g.n, item_id FROM grams g JOIN wins ON wins.n = g.n AND wins.phrase = g.phrase),
 hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
 items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit ON hit.doc_id = w.doc_id LEFT JOIN items ON items.doc_id = w.doc_id"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 link AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
 edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
 reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = w.doc_id"""

REPEATS = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
 win AS (SELECT doc_id, i, md5(substring(h, 2 * i + 1, 200)) AS m FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
 gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, min((doc_id, i)) OVER (PARTITION BY m) AS first FROM win) WHERE (doc_id, i) > first),
 runs AS (SELECT doc_id, min(i) AS s, max(i) + 100 AS e FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, (i - lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) > 100)::INT AS fresh FROM gone)) GROUP BY doc_id, run),
 cuts AS (SELECT doc_id, list(s ORDER BY s) AS s, list(e ORDER BY s) AS e, sum(e - s) AS n FROM runs GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(len(s), 0)::BIGINT AS n_spans,
 sha256(unhex(CASE WHEN s IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(s) + 2), lambda k: substring(h, 2 * (CASE WHEN k = 1 THEN 0 ELSE e[k - 1] END) + 1, 2 * ((CASE WHEN k > len(s) THEN length(h) // 2 ELSE s[k] END) - (CASE WHEN k = 1 THEN 0 ELSE e[k - 1] END)))), '') END)) AS kept_sha256
FROM d LEFT JOIN cuts ON cuts.doc_id = d.doc_id"""

WORDS = "regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')"

INTERACTIONS = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
 w AS (SELECT doc_id, part, x, {WORDS} AS w FROM d),
 l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
 f AS (SELECT doc_id, part, {{'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * len(regexp_extract_all(x, '[A-Z]')) > 2 * length(x),
  'D': regexp_matches(x, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false)}} AS f FROM w),
 letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
 orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
 fails AS (SELECT doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  list_filter(['A', 'B', 'C', 'D', 'E'], lambda k: CASE k WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END) AS failed
  FROM f LEFT JOIN l USING (doc_id)),
 gone AS (SELECT part, good, toxic, failed, filter_order, coalesce(list_min(list_transform(failed, lambda k: instr(filter_order, k))), 6) AS gone FROM fails, orders),
 counts AS (SELECT part, filter_order, step::INT AS step, sum((gone > step)::INT)::BIGINT AS kept, sum((gone = step)::INT)::BIGINT AS removed,
  sum((gone < step AND list_contains(failed, filter_order[step]))::INT)::BIGINT AS redundant, sum((failed = [filter_order[step]])::INT)::BIGINT AS unique_fails,
  sum((gone = step AND good)::INT)::BIGINT AS good_lost, sum((gone = step AND toxic)::INT)::BIGINT AS toxic_lost
  FROM gone, (SELECT unnest(range(1, 6)) AS step) GROUP BY ALL)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM counts"""

_RECENT = "updated_at DESC NULLS LAST, t DESC, client_id"
_TRUSTED = "fresh DESC, t DESC, updated_at DESC NULLS LAST, client_id"


def _first(column: str, order: str) -> str:
    return f"first({{'v': {column}, 'k': client_id}} ORDER BY {order}, {column} DESC) FILTER (WHERE {column} IS NOT NULL)"


def _filled(column: str) -> str:
    return f"CASE WHEN NOT regexp_full_match({column}, '[\\x20\\x09-\\x0D]*') THEN {column} END AS {column}"


GOLDEN = f"""
WITH c AS (SELECT coalesce(master_id, client_id) AS cluster_id, client_id, updated_at, CASE source WHEN 'store' THEN 4 WHEN 'crm' THEN 3 WHEN 'partner' THEN 2 WHEN 'web' THEN 1 ELSE 0 END AS t,
  {_filled("name")}, {_filled("email")}, {_filled("segment")}, {_filled("city")}, nation_id, CASE WHEN isfinite(balance) THEN balance END AS balance FROM clients),
 r AS (SELECT *, NOT (updated_at IS NULL OR epoch_us(max(updated_at) OVER (PARTITION BY cluster_id)) - epoch_us(updated_at) > 10 * 24 * 3600000000) AS fresh FROM c),
 one AS (SELECT cluster_id, count(*) AS n_records, sum((NOT fresh)::INT)::BIGINT AS n_stale, {_first("name", "length(name) DESC, " + _TRUSTED)} AS name, {_first("email", _TRUSTED)} AS email, {_first("segment", _RECENT)} AS segment,
  first({{'city': city, 'nation_id': nation_id, 'k': client_id}} ORDER BY (city IS NOT NULL)::INT + (nation_id IS NOT NULL)::INT DESC, {_RECENT}) AS place FROM r GROUP BY cluster_id),
 money AS (SELECT r.cluster_id, first({{'v': balance, 'k': client_id}} ORDER BY coalesce(r.segment = one.segment.v, false) DESC, {_RECENT}, balance DESC) FILTER (WHERE balance IS NOT NULL) AS balance
  FROM r JOIN one ON r.cluster_id IS NOT DISTINCT FROM one.cluster_id GROUP BY r.cluster_id)
SELECT one.cluster_id, n_records, n_stale, name.v AS name, email.v AS email, segment.v AS segment, place.city AS city, place.nation_id AS nation_id, floor(100 * balance.v + 0.5)::BIGINT AS balance_cents,
 name.k AS name_from, email.k AS email_from, segment.k AS segment_from, balance.k AS balance_from, CASE WHEN place.city IS NOT NULL OR place.nation_id IS NOT NULL THEN place.k END AS address_from
FROM one JOIN money ON one.cluster_id IS NOT DISTINCT FROM money.cluster_id"""
