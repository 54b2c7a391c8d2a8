"""The queries of this subpackage, each over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

from . import centroids, fingerprints, fixity, jaccard, licences, mixing, packing, quality, secrets, sharding, tokens, toxicity, trie
from .common import documents

QUERIES = {
    "op1_document_fingerprints": lambda spark, d: fingerprints.document_fingerprints(documents(spark, d)),
    "op2_license_scans": lambda spark, d: licences.scan(documents(spark, d)),
    "op3_quality_rules": lambda spark, d: quality.judged(documents(spark, d)),
    "op4_jaccard_join": lambda spark, d: jaccard.near_duplicates(documents(spark, d)),
    "op5_sharding": lambda spark, d: sharding.sharded(documents(spark, d)),
    "op6_best_fit_packing": lambda spark, d: packing.packed(documents(spark, d)),
    "op7_token_files": lambda spark, d: tokens.token_table(documents(spark, d)),
    "op8_toxicity": lambda spark, d: toxicity.scored(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
    "op9_warc_fixity": lambda spark, d: fixity.audited(spark.read.parquet(f"{d}/pages.parquet")),
    "op10_mixing": lambda spark, d: mixing.mixed(documents(spark, d)),
    "op11_conversation_trie": lambda spark, d: trie.trie(spark.read.parquet(f"{d}/conversations.parquet")),
    "op12_centroid_clusters": lambda spark, d: centroids.clustered(spark.read.parquet(f"{d}/embeddings.parquet")),
    "op13_secret_scans": lambda spark, d: secrets.scanned(documents(spark, d)),
}

_SPACE = r"[^\x20\x09-\x0D]+"


def _clusters(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds unrolled, one pair of tables for each."""

    def nearest(i: int) -> str:
        near = f"SELECT row, q, c, list_sum(list_transform(list_zip(q, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{i}"
        return f"a{i} AS MATERIALIZED (SELECT row, any_value(q) AS q, min((d, c))[2] AS c, min(d) AS d FROM ({near}) GROUP BY row)"

    steps = []
    for i in range(rounds):
        means = f"SELECT c, j, (s - ((s % n) + n) % n) // n AS x FROM (SELECT c, j, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT c, unnest(range(1, 65)) AS j, unnest(q) AS x FROM a{i}) GROUP BY 1, 2)"
        steps += [nearest(i), f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(x, m) AS m FROM c{i} LEFT JOIN (SELECT c, list(x::BIGINT ORDER BY j) AS x FROM ({means}) GROUP BY c) USING (c))"]
    between = ",\n".join([*steps, nearest(rounds)])
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), q) - 1 AS c, q AS m FROM v QUALIFY c < {k}),
{between}
SELECT vec_id::BIGINT AS vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (row) JOIN c{rounds} USING (c)
"""


ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_SPACE}')) AS lines FROM documents),
t AS (SELECT doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM t) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(0, 3) x(k) GROUP BY 1),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, length(text) - length(replace(text, '!', '')) AS n_shouts
    FROM d LEFT JOIN c USING (doc_id)),
b AS (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
    + 8 * (n_lines >= 4 AND 2 * n_dup_lines > n_lines)::BIGINT + 16 * (5 * n_shouts > n_words)::BIGINT
    + 32 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits & 31 = 0 AS kept, fail_bits FROM b
""",
    "op11_conversation_trie": rf"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM
    (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(flatten(list_transform(string_split(conv_id::VARCHAR, ''),
    lambda a: [ascii(a)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, (x & 1) * 3988292384) END, 4294967295::BIGINT)) % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, p, role, text FROM c JOIN t ON t.conv_id = c.base AND p <= h
    UNION ALL SELECT c.conv_id, 1, p, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND p > h),
k AS (SELECT conv_id, list(md5(length(role) || ':' || role || text) ORDER BY own, p) AS path FROM r GROUP BY 1),
w AS (SELECT DISTINCT md5(length(role) || ':' || role || text) AS turn, len(regexp_extract_all(text, '{_SPACE}')) AS words FROM t),
m AS (SELECT conv_id, path, len(path) AS n, unnest(range(0, len(path) + 1)) AS depth FROM (SELECT conv_id, coalesce(path, []) AS path FROM c LEFT JOIN k USING (conv_id))),
n AS (SELECT path[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth) AS ends FROM m GROUP BY 1, 2),
ch AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * coalesce(words, 0) AS saved FROM n LEFT JOIN ch USING (node) LEFT JOIN w ON w.turn = n.node[depth]),
u AS (SELECT node[1:i] AS node, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
    FROM (SELECT *, unnest(range(0, depth + 1)) AS i FROM v) GROUP BY 1)
SELECT v.conv_id::BIGINT AS conv_id, v.depth::BIGINT AS depth, above.conv_id::BIGINT AS parent_conv_id, v.n_convs::BIGINT AS n_convs, v.n_children::BIGINT AS n_children,
    n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN u USING (node) LEFT JOIN n above ON v.depth > 0 AND above.node = v.node[1:v.depth - 1]
""",
    "op12_centroid_clusters": _clusters(),
}
