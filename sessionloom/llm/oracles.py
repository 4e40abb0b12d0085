"""SQL for the queries that DuckDB can answer over whole tables."""

from __future__ import annotations

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BASE32 = "array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + " + " + ".join(f"{1 << (4 - b)} * CAST(substr(bits, 5 * i + {b + 1}, 1) AS INT)" for b in range(5)) + ", 1) FOR i IN range(32)], '')"


def url_filters(rules: tuple[tuple[str, str], ...]) -> str:
    values = ", ".join(f"('{r}', '{v}')" for r, v in rules)
    return f"""WITH r AS (SELECT rule, verdict, split_part(rule, '/', 1) AS rh, substr(rule, strpos(rule, '/')) AS rp FROM (VALUES {values}) AS t(rule, verdict)),
      u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
      h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
      m AS (SELECT page_id, arg_max({{'r': rule, 'v': verdict}}, length(rule)) AS b FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1)
      SELECT h.page_id, host, path, b.r AS rule, coalesce(b.v, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)"""


SUFFIX_DEDUP = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  w AS (SELECT doc_id, unnest(range(CAST(length(h) // 2 - 99 AS BIGINT))) AS p, unnest([substr(h, 2 * i + 1, 200) FOR i IN range(CAST(length(h) // 2 - 99 AS BIGINT))]) AS k FROM d WHERE length(h) >= 200),
  f AS (SELECT k, min((doc_id, p)) AS first FROM w GROUP BY 1 HAVING count(*) > 1),
  g AS (SELECT doc_id, p FROM w JOIN f USING (k) WHERE (doc_id, p) > first),
  s AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS n FROM g),
  q AS (SELECT doc_id, p, sum(n) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM s),
  r AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM q GROUP BY 1, 2),
  t AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM r GROUP BY 1)
  SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
    sha256(CASE WHEN spans IS NULL THEN from_hex(h) ELSE from_hex(array_to_string([substr(h, 2 * (CASE WHEN i = 1 THEN 0 ELSE ends[i - 1] END) + 1, 2 * ((CASE WHEN i > len(starts) THEN length(h) // 2 ELSE starts[i] END) - (CASE WHEN i = 1 THEN 0 ELSE ends[i - 1] END))) FOR i IN range(1, len(starts) + 2)], '')) END) AS kept_sha256
  FROM d LEFT JOIN t USING (doc_id)"""

WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
  b AS (SELECT *, CAST(CAST(from_hex(sha1(html)) AS BIT) AS VARCHAR) AS bits FROM p)
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM b"""

DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
  bk AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest([array_to_string(w[i:i + least(10, len(w)) - 1], ' ') FOR i IN range(1, CAST(len(w) - least(10, len(w)) + 2 AS BIGINT))]) AS k FROM b WHERE len(w) > 0),
  ns AS (SELECT DISTINCT n FROM bk),
  dk AS (SELECT doc_id, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, CAST(len(w) - n + 2 AS BIGINT))]) AS k FROM d, ns WHERE len(w) >= n),
  h AS (SELECT doc_id, n, i, item_id FROM dk JOIN bk USING (n, k)),
  c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
  it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN it USING (doc_id)"""

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + least(5, len(w)) - 1], ' ') FOR i IN range(1, CAST(len(w) - least(5, len(w)) + 2 AS BIGINT))]) AS g FROM d WHERE len(w) > 0),
  n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS whole FROM s GROUP BY 1),
  c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
  l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE shared * 10 >= 8 * (a.n + b.n - shared)),
  reach AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM reach r JOIN l ON r.y = l.x),
  k AS (SELECT x AS doc_id, least(x, min(y)) AS class_id FROM reach GROUP BY 1), m AS (SELECT x AS doc_id, count(*) AS n_links FROM l GROUP BY 1), e AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY whole) AS copy_of FROM n)
  SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(copy_of, doc_id) AS copy_of, coalesce(n_links, 0) AS n_links FROM d LEFT JOIN k USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN e USING (doc_id)"""

NEAREST = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
  p AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce([q.x[i] * c.x[i] FOR i IN range(1, 65)], lambda a, b: a + b) AS score FROM e q, e c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p QUALIFY rank <= 20"""


CONTROL_TURN = "</s>[INST] ok [/INST]"
_CONTROLS = ("[INST]", "[/INST]", "</s>", "<s>")
_ESCAPED = "length({0}) + length({0}) - length(replace({0}, '\\', ''))" + "".join(f" + 2 * ((length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)})" for c in _CONTROLS)
CHAT = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '{CONTROL_TURN}'), (-1, 1, 'assistant', '{CONTROL_TURN}')),
  o AS (SELECT *, sha256(role || chr(10) || text) AS tie, {_ESCAPED.format("role")} + {_ESCAPED.format("text")} + {sum(map(len, _CONTROLS[:3]))} AS size FROM t)
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, tie)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, tie) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars FROM o GROUP BY conv_id"""

COLLOCATIONS = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_FOLD}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
  w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
  g AS (SELECT lang, unnest([{{'k': k, 'phrase': array_to_string(w[i:i + k - 1], ' ')}} FOR i IN range(1, CAST(len(w) - k + 2 AS BIGINT))]) AS x FROM w, (VALUES (1), (2), (3)) AS ks(k) WHERE len(w) >= k),
  c AS (SELECT lang, x.k AS k, x.phrase AS phrase, count(*) AS f FROM g GROUP BY ALL),
  n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE k = 1 GROUP BY 1),
  d AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM c WHERE k > 1 AND f >= 10),
  s AS (SELECT lang, k, phrase, a, ws, j, array_to_string(ws[1:j], ' ') AS x, array_to_string(ws[j + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM d)),
  r AS (SELECT s.lang, s.phrase, a, ws, j, cl.f AS l, cr.f AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(cl.f AS HUGEINT) * cr.f) AS BIGINT) AS score
    FROM s JOIN c cl ON cl.lang = s.lang AND cl.phrase = x JOIN c cr ON cr.lang = s.lang AND cr.phrase = y),
  b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
  t AS (SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest([1, 2]) AS i FROM d WHERE k = 3) GROUP BY ALL),
  e AS (SELECT b.* FROM b LEFT JOIN t USING (lang, phrase) WHERE NOT coalesce(100 * longer >= 50 * a, false))
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM e JOIN n USING (lang) QUALIFY rank <= 2000"""


def centroids(k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1) -> str:
    def nearest(n: int) -> str:
        far = "list_sum(list_transform(list_zip(v, x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        return f"""a{n} AS (SELECT i, vec_id, v, arg_min(c, {{'d': d, 'c': c}}) AS c, min(d) AS d FROM (SELECT i, vec_id, v, c, CAST({far} AS BIGINT) AS d FROM e, c{n}) GROUP BY ALL)"""

    parts = [
        f"e AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS x FROM (SELECT v, sha256('{seed}:' || vec_id) AS h FROM e ORDER BY h, v LIMIT {k}))",
    ]
    for n in range(rounds):
        parts.append(nearest(n))
        parts.append(f"m{n} AS (SELECT c, p, CAST(sum(z) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(range(1, {dim} + 1)) AS p, unnest(v) AS z FROM a{n}) GROUP BY ALL)")
        parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c, coalesce(y, x) AS x FROM c{n} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY p) AS y FROM m{n} GROUP BY 1) USING (c))")
    parts.append(nearest(rounds))
    return f"""WITH {", ".join(parts)} SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(x, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"""
