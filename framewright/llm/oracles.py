"""DuckDB SQL of the numbered queries that SQL can express over whole tables.

Texts are split at ASCII white space only, and only A-Z are lowered, as the queries' contracts say.
"""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"


def _components(nodes: str, edges: str) -> str:
    """(node, component): the smallest node reachable, of tables nodes (node) and symmetric edges (u, v)."""
    return f"""reach(node, c) AS (SELECT node, node FROM {nodes} UNION SELECT e.v, r.c FROM reach r JOIN {edges} e ON e.u = r.node),
comp AS (SELECT node, min(c) AS component FROM reach GROUP BY node)"""


OP3 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(l) < 3 THEN array_to_string(l, ' ') ELSE l[i] || ' ' || l[i + 1] || ' ' || l[i + 2] END AS g
  FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 2, 1) + 1)) AS i FROM w WHERE len(l) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT u, v FROM k JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 85 * (a.n + b.n - k)),
sym AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
nodes AS (SELECT doc_id AS node FROM documents),
{_components('nodes', 'sym')}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component AS component_id, d.doc_id = component AS kept
FROM documents d JOIN comp ON comp.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

_VECTORS = """f AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT vec_id, v FROM f WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda a: a IS NULL OR NOT isfinite(a))) = 0
  AND len(list_filter(v, lambda a: a <> 0)) > 0)"""

OP5 = f"""WITH {_VECTORS},
s AS (SELECT q.vec_id AS query_id, b.vec_id, list_dot_product(b.v, q.v) AS score FROM x q JOIN x b ON q.vec_id % 20 = 0 AND b.vec_id <> q.vec_id AND len(q.v) = len(b.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

OP6 = f"""WITH RECURSIVE {_VECTORS},
u AS (SELECT vec_id, list_transform(v, lambda a: a / sqrt(list_dot_product(v, v))) AS v FROM x),
sym AS (SELECT a.vec_id AS u, b.vec_id AS v FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) >= 0.95),
nodes AS (SELECT vec_id AS node FROM embeddings),
{_components('nodes', 'sym')}
SELECT e.vec_id, (SELECT count(*) FROM sym WHERE sym.u = e.vec_id) AS n_links, component AS component_id, e.vec_id = component AS kept
FROM embeddings e JOIN comp ON comp.node = e.vec_id"""


_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _found(kind: int, name: str, pattern: str, group: int, least: int) -> str:
    """(doc_id, kind, name, start, end) of the matches whose group has so many characters: what lies between matches gives their places."""
    return f"""SELECT doc_id, {kind} AS kind, '{name}' AS name, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS a,
    length(hits[i]) AS n FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM
    (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS hits, regexp_extract_all(text, '{pattern}', {group}) AS own, string_split_regex(text, '{pattern}') AS gaps FROM t))
    WHERE length(own[i]) >= {least}"""


#: All spans are of the base kinds: the tables hold no encoded key, which a test of them says.
OP4 = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({_found(0, 'assign', _ASSIGN, 2, 6)} UNION ALL {_found(1, 'access', 'AKIA[A-Z0-9]+', 0, 20)} UNION ALL {_found(2, 'hex', '[0-9a-f]+', 0, 24)}),
g AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  string_agg(name || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, kind) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, 0::BIGINT AS n_confirmed,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN g USING (doc_id)"""


def op10(path: str) -> str:
    """Greedy longest match, a piece a round, over distinct words as hexadecimal digits of their bytes."""
    return rf"""WITH RECURSIVE byte AS (SELECT b, CASE WHEN b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255 THEN chr(CAST(b AS INT))
    ELSE chr(CAST(256 + row_number() OVER (PARTITION BY b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255 ORDER BY b) - 1 AS INT)) END AS c
  FROM (SELECT unnest(range(256)) AS b)),
shown AS (SELECT map(list(c), list(printf('%02X', b))) AS m FROM byte),
names AS (SELECT unnest(json_keys(content, '$.model.vocab')) AS name FROM read_text('{path}')),
pieces AS (SELECT array_to_string(list_transform(string_split(name, ''), lambda c: m[c]), '') AS h, len(name) AS k, list_transform(string_split(name, ''), lambda c: m[c]) AS l FROM names, shown),
vocab AS (SELECT DISTINCT h[1:2] = '20' AS initial, CASE WHEN h[1:2] = '20' THEN h[3:] ELSE h END AS h FROM pieces WHERE NOT list_contains(list_transform(l, lambda c: c IS NULL), true)),
longest AS (SELECT max(len(h)) AS n FROM vocab),
tokens AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS w FROM documents),
words AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM tokens),
step(w, left_over, n) AS (
  SELECT w, h, 0 FROM words
  UNION ALL
  SELECT s.w, s.left_over[p.k + 1 :], s.n + 1 FROM step s JOIN LATERAL (SELECT max(len(v.h)) AS k FROM vocab v, (SELECT unnest(range(0, least(len(s.left_over), (SELECT n FROM longest)) + 1, 2)) AS k) z
    WHERE v.initial = (s.n = 0) AND v.h = s.left_over[1 : z.k]) p ON p.k IS NOT NULL WHERE s.left_over <> ''),
counts AS (SELECT w, max(n) FILTER (WHERE left_over = '') AS n FROM step GROUP BY w)
SELECT d.doc_id, count(t.w) AS n_words, CAST(coalesce(sum(coalesce(c.n, 1)) FILTER (WHERE t.w IS NOT NULL), 0) AS BIGINT) AS n_tokens,
  count(t.w) FILTER (WHERE c.n IS NULL) AS n_unknown
FROM documents d LEFT JOIN tokens t ON t.doc_id = d.doc_id LEFT JOIN counts c ON c.w = t.w GROUP BY d.doc_id"""


def _floor_mean(total: str, n: str) -> str:
    """floor(total / n) of whole numbers."""
    return f"({total} - (({total} % {n}) + {n}) % {n}) // {n}"


def op11(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds in whole numbers; a distance and its centroid's number are one key, distance * 64 + number, so that the least key wins."""
    parts = [
        """x AS MATERIALIZED (SELECT vec_id, generate_subscripts(embedding, 1) AS pos, CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda a: a IS NULL OR NOT isfinite(a))) = 0)""",
        f"""f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k FROM (SELECT DISTINCT vec_id FROM x) QUALIFY k < {k}),
c0 AS MATERIALIZED (SELECT k, pos, v FROM f JOIN x USING (vec_id))""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, min(d * 64 + k) AS key FROM (SELECT vec_id, k, CAST(sum((x.v - c.v) * (x.v - c.v)) AS BIGINT) AS d
  FROM x JOIN c{r} c USING (pos) GROUP BY vec_id, k) GROUP BY vec_id)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.k, c.pos, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN
  (SELECT k, pos, CAST({_floor_mean('s', 'n')} AS BIGINT) AS v FROM (SELECT key % 64 AS k, pos, CAST(sum(v) AS BIGINT) AS s, count(*) AS n
  FROM a{r} JOIN x USING (vec_id) GROUP BY 1, 2)) m USING (k, pos))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(key % 64 AS INT) AS cluster, key // 64 AS distance, CAST(sum(key // 64) OVER (PARTITION BY key % 64) AS BIGINT) AS cluster_inertia,
  CAST(sum(key // 64) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN (SELECT k, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256 FROM c{rounds} GROUP BY k) h ON h.k = key % 64"""


def op12(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """For a table whose vectors have one length."""
    steps = [
        f"""x AS MATERIALIZED (SELECT vec_id, (pos - 1) // (n // {parts}) AS part, pos, v FROM (SELECT vec_id, len(embedding) AS n, generate_subscripts(embedding, 1) AS pos,
  CAST(floor(4096 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda a: a IS NULL OR NOT isfinite(a))) = 0))""",
        f"""f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT DISTINCT vec_id FROM x) QUALIFY e < {entries}),
c0 AS MATERIALIZED (SELECT e, part, pos, v FROM f JOIN x USING (vec_id))""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, part, min(d * 256 + e) AS key FROM (SELECT vec_id, x.part, e, CAST(sum((x.v - c.v) * (x.v - c.v)) AS BIGINT) AS d
  FROM x JOIN c{r} c USING (pos) GROUP BY vec_id, x.part, e) GROUP BY vec_id, part)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.e, c.part, c.pos, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN
  (SELECT e, pos, CAST({_floor_mean('s', 'n')} AS BIGINT) AS v FROM (SELECT key % 256 AS e, pos, CAST(sum(v) AS BIGINT) AS s, count(*) AS n
  FROM a{r} JOIN x USING (vec_id, part) GROUP BY 1, 2)) m USING (e, pos))""")
    return "WITH " + ",\n".join(steps) + f""",
z AS (SELECT vec_id, string_agg(lpad(lower(to_hex(key % 256)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(key // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, e, pos)) FROM c{rounds}) AS codebooks_sha256
FROM z JOIN embeddings USING (vec_id)"""


OP13 = """WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM r"""

ORACLES = {
    "op3_near_dedup": OP3, "op4_secret_scan": OP4, "op5_nearest_neighbours": OP5, "op6_embedding_dedup": OP6,
    "op11_centroid_clusters": op11(), "op12_vector_codes": op12(), "op13_warc": OP13,
}
