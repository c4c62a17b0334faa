"""DuckDB SQL for the queries that SQL can express.

The others need a tokenizer (op2), 64-bit XXH hashes (op4), boosted trees
(op5), a learned model (op6), CRC32 (op8), markup (op9) or logarithms whose
last digit decides ties (op1); tests compare them with brute force, exact
round trips or held-out accuracy.
"""

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINE_DEDUP = f"""
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM texts),
k AS (SELECT *, translate(trim(line, {_SPACES}), '{_UPPER}', '{_LOWER}') AS key FROM l),
shared AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key
           HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT k.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM k LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

TOP_K = """
WITH v AS (SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""


def _shingles(table: str, key: str) -> str:
    return (f"SELECT DISTINCT {key}, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(1, len(w) - 4) + 1)]) "
            f"AS s FROM (SELECT {key}, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {table})")


DECONTAMINATION = f"""
WITH d AS ({_shingles('documents', 'doc_id')}), i AS (SELECT * FROM ({_shingles('benchmark', 'item_id')}) WHERE s <> ''),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
hits AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(n_item AS INTEGER) AS n_item, CAST(n_shared AS INTEGER) AS n_shared,
       CAST(n_shared AS DOUBLE) / CAST(n_item AS DOUBLE) AS containment
FROM hits JOIN n USING (item_id) WHERE n_shared >= 0.8e0 * n_item - 1e-9
"""

ORACLE_SQL = {
    "op3_line_dedup": LINE_DEDUP,
    "op7_exact_top_k": TOP_K,
    "op10_benchmark_decontamination": DECONTAMINATION,
}
