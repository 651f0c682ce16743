"""SQL twins of the operators that SQL can express, for DuckDB over the given tables."""

from __future__ import annotations

from millrace.llm.license_scan import TEMPLATES

WARC = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
last AS (SELECT html, max(page_id) AS page_id FROM p GROUP BY html)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
         ((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN p.page_id = last.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> last.page_id THEN last.page_id END AS refers_to, url
FROM p JOIN last USING (html)
"""
EMBEDDING_PAIRS = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
pairs AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM component LEFT JOIN degree USING (vec_id)
"""
JACCARD_JOIN = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
),
sets AS MATERIALIZED (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
                             ELSE list_distinct(list_transform(range(len(w) - 4), lambda i: w[i + 1 : i + 5])) END) AS shingle
  FROM words
),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
pairs AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common.n >= 80 * (x.n + y.n - common.n)
),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""
SUFFIX_DEDUP = r"""
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS MATERIALIZED (SELECT doc_id, unnest(range(length(h) // 2 - 49)) AS pos, h FROM bytes WHERE length(h) >= 100),
hashed AS MATERIALIZED (SELECT doc_id, pos, md5_number(substr(h, CAST(2 * pos + 1 AS INTEGER), 100)) AS w FROM windows),
firsts AS (SELECT w, min(doc_id) AS first_id FROM hashed GROUP BY w HAVING min(doc_id) <> max(doc_id)),
hits AS (SELECT doc_id, pos FROM hashed JOIN firsts USING (w) WHERE first_id < doc_id),
marked AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 50 THEN 0 ELSE 1 END AS fresh FROM hits),
spans AS (
  SELECT doc_id, min(pos) AS low, max(pos) + 50 AS high
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM marked) GROUP BY doc_id, span
),
gaps AS (
  SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS since FROM spans
),
kept AS (
  SELECT doc_id, sum(high - low) AS n_removed, count(*) AS n_spans, max(high) AS last,
         string_agg(substr(h, CAST(2 * since + 1 AS INTEGER), CAST(2 * (low - since) AS INTEGER)), '' ORDER BY low) AS head
  FROM gaps JOIN bytes USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS INTEGER)))) AS kept_sha256
FROM bytes LEFT JOIN kept USING (doc_id)
"""


_SQUARES = "CAST(list_sum(list_transform(list_zip({x}, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"


def _moved(n: int, keys: str) -> str:
    """Floored means of the members found in ``a{n}``, and the entries without any as they were."""
    return f"""s{n} AS (SELECT {keys}, pos, CAST(sum(v) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS n FROM (
  SELECT {keys}, unnest(x) AS v, unnest(range(len(x))) AS pos FROM a{n}) GROUP BY ALL),
m{n} AS (SELECT {keys}, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY pos) AS moved FROM s{n} GROUP BY ALL),
c{n + 1} AS MATERIALIZED (SELECT {keys}, coalesce(moved, c) AS c FROM c{n} LEFT JOIN m{n} USING ({keys}))"""


def _vector_codes(rounds: int = 6) -> str:
    near = f"min({_SQUARES.format(x='p.x')} * 16 + entry)"
    assign = lambda n: (
        f"a{n} AS MATERIALIZED (SELECT vec_id, part, any_value(p.x) AS x, {near} % 16 AS entry, {near} // 16 AS d FROM p JOIN c{n} USING (part) GROUP BY vec_id, part)"
    )
    steps = ",\n".join(f"{assign(n)},\n{_moved(n, 'part, entry')}" for n in range(rounds))
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
p AS MATERIALIZED (SELECT vec_id, part, x[part * len(x) // 8 + 1 : (part + 1) * len(x) // 8] AS x FROM v, range(8) AS r(part)),
c0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16)
),
{steps},
{assign(rounds)},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id
),
labels AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM coded JOIN v USING (vec_id) GROUP BY label)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256
FROM coded JOIN v USING (vec_id) JOIN labels ON v.label IS NOT DISTINCT FROM labels.label
"""


def _centroid_clusters(rounds: int = 3) -> str:
    near = f"min({_SQUARES.format(x='v.x')} * 16 + cluster)"
    assign = lambda n: (
        f"a{n} AS MATERIALIZED (SELECT vec_id, any_value(v.x) AS x, {near} % 16 AS cluster, {near} // 16 AS distance FROM v, c{n} GROUP BY vec_id)"
    )
    steps = ",\n".join(f"{assign(n)},\n{_moved(n, 'cluster')}" for n in range(rounds))
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster, x AS c FROM v QUALIFY cluster < 16
),
{steps},
{assign(rounds)},
sums AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, cluster_inertia, CAST((SELECT sum(cluster_inertia) FROM sums) AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN sums USING (cluster) JOIN c{rounds} USING (cluster)
"""


VECTOR_CODES = _vector_codes()
CENTROID_CLUSTERS = _centroid_clusters()


def _literal(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _template_rows() -> str:
    rows = []
    for n, t in enumerate(TEMPLATES):
        lead = f" {t.text} ".partition(f" {t.key} ")[0].count(" ")
        rows.append(f"({n}, '{t.label}', {str(t.base).lower()}, {_literal(t.key.split())}, {_literal(t.text.split())}, {lead})")
    return ", ".join(rows)


LICENSE_SCAN = rf"""
WITH t(n, label, base, key, whole, lead) AS (VALUES {_template_rows()}),
words AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
),
places AS (
  SELECT doc_id, w, t.*, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + len(key)] = key)) AS pos
  FROM words, t WHERE list_has_all(w, key)
),
found AS (
  SELECT doc_id, label, base, pos, len(list_filter(range(len(whole)), lambda j: pos - lead + j >= 0 AND w[pos - lead + j + 1] = whole[j + 1])) / len(whole) AS score
  FROM places
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, count(*) FILTER (base) AS n_base, min(pos) FILTER (base) AS first_word, max(pos) FILTER (base) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(score), 0.0) AS score
FROM words LEFT JOIN found USING (doc_id) GROUP BY doc_id, w
"""
