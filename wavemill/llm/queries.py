"""Queries of this subpackage, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op4_byte_bpe
from .chat import op2_chat_format
from .divergence import op13_source_divergence
from .jaccard import op9_ngram_jaccard
from .langid import op5_language_id
from .packing import op10_packing
from .pii import op8_pii
from .quality import op3_quality_rules
from .suffix import op1_suffix_dedup
from .topk import op7_topk
from .toxicity import op6_toxicity
from .urls import op12_url_filter
from .vafile import op11_vector_codes

QUERIES = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_chat_format, op3_quality_rules, op4_byte_bpe, op5_language_id, op6_toxicity, op7_topk, op8_pii, op9_ngram_jaccard, op10_packing, op11_vector_codes, op12_url_filter, op13_source_divergence)
}



def _vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Integer k-means round by round over long rows (vector, part, position, component)."""
    steps = [
        f"""v AS MATERIALIZED (
            SELECT vec_id, label, embedding::DOUBLE[] AS e, len(embedding) // {parts} AS w FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), i AS (SELECT vec_id, w, unnest(range(len(e))) AS i, floor(4096 * unnest(e))::BIGINT AS x FROM v),
        x AS MATERIALIZED (SELECT vec_id, i // w AS part, i % w AS pos, x FROM i),
        b0 AS MATERIALIZED (
            SELECT part, r AS entry, pos, x AS y FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM v) USING (vec_id) WHERE r < {entries}
        )"""
    ]
    for k in range(rounds + 1):
        steps.append(f"""d{k} AS (SELECT vec_id, part, entry, sum((x - y) * (x - y))::BIGINT AS d FROM x JOIN b{k} USING (part, pos) GROUP BY ALL),
        a{k} AS MATERIALIZED (
            SELECT vec_id, part, entry, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) AS r FROM d{k}) WHERE r = 1
        )""")
        if k < rounds:
            steps.append(f"""s{k} AS (SELECT part, entry, pos, sum(x)::BIGINT AS s, count(*) AS n FROM x JOIN a{k} USING (vec_id, part) GROUP BY ALL),
        b{k + 1} AS MATERIALIZED (
            SELECT part, entry, pos, CASE WHEN n IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END AS y FROM b{k} LEFT JOIN s{k} USING (part, entry, pos)
        )""")
    return f"""
        WITH {", ".join(steps)},
        c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
               (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256
        FROM c JOIN v USING (vec_id)
    """


ORACLES = {
    "op2_chat_format": """
        WITH c AS (
            SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\\### Assistant: </turn> ok' FROM range(2) r(i)
        ), e AS (
            SELECT *, length(role) + length(text) + length('### : </turn>') + 1
                + len(regexp_extract_all(role, '\\\\|</turn>|###|:')) + len(regexp_extract_all(text, '\\\\|</turn>|###|:')) AS chars FROM c
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(chars)::BIGINT AS formatted_chars, 0::BIGINT AS n_rewrites
        FROM e GROUP BY conv_id
    """,
    "op7_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)::BIGINT) AS q
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
                   list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op9_ngram_jaccard": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
            FROM documents
        ), sh AS (
            SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                ELSE list_distinct(list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END) AS s
            FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (
            SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)
        ), r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(r.y), d.doc_id)) AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.x = d.doc_id GROUP BY d.doc_id, n.n
    """,
    "op11_vector_codes": _vector_codes_sql(),
    "op13_source_divergence": """
        WITH d AS (
            SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws
            FROM documents
        ), kept AS MATERIALIZED (
            SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ws)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 30
        ), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
        c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(ws) AS term FROM d) JOIN kept USING (lang, term) GROUP BY ALL),
        g AS MATERIALIZED (
            SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source)
        ), p AS MATERIALIZED (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * v.v) AS p
            FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), l AS (SELECT lang, sum(total) AS total FROM g GROUP BY ALL),
        q AS (
            SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (coalesce(t.n, 0) + 5)) // (l.total + 5 * v.v) AS q
            FROM kept k JOIN v ON v.lang = k.lang JOIN l ON l.lang = k.lang LEFT JOIN (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) t ON t.lang = k.lang AND t.term = k.term
        ), f AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL),
        r AS (
            SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.f, 0) AS value
            FROM g x JOIN g y ON y.lang = x.lang AND y.source <> x.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
            UNION ALL SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q
        ), n AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
        SELECT lang, source, part, item, value::BIGINT AS value, rank FROM n WHERE part = 'pair' OR rank <= 50
    """,
}
