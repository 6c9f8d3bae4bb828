"""SQL for the queries that SQL can express."""


def product_code_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The codebook rounds one after the other, as tables of the nearest entry and of the entries."""
    near = """
        near{k} AS MATERIALIZED (
            SELECT r, part, min({{'d': d, 'e': entry}}) AS best FROM (
                SELECT a.r, a.part, b.entry,
                       list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
                FROM parts a JOIN book{k} b USING (part)
            ) GROUP BY r, part
        )"""
    book = """
        book{n} AS MATERIALIZED (
            SELECT part, entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN (
                SELECT part, entry, list(s // n - CAST(s % n < 0 AS BIGINT) ORDER BY i) AS v FROM (
                    SELECT part, best.e AS entry, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n
                    FROM near{k} JOIN parts USING (r, part), (SELECT unnest(range(1, size + 1)) AS i FROM width)
                    GROUP BY part, best.e, i
                ) GROUP BY part, entry
            ) m USING (part, entry)
        )"""
    steps = [near.format(k=0)]
    for k in range(rounds):
        steps += [book.format(k=k, n=k + 1), near.format(k=k + 1)]
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, * FROM (
                SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                FROM embeddings
                WHERE embedding IS NOT NULL
                  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            )
        ),
        width AS (SELECT CAST(max(len(v)) // {parts} AS BIGINT) AS size FROM kept),
        parts AS MATERIALIZED (
            SELECT r, part, v[part * size + 1 : part * size + size] AS v
            FROM kept, width, (SELECT unnest(range({parts})) AS part)
        ),
        book0 AS MATERIALIZED (SELECT part, r - 1 AS entry, v FROM parts WHERE r <= {entries}),
        {",".join(steps)},
        coded AS (
            SELECT r, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' ORDER BY part) AS code,
                   CAST(sum(best.d) AS BIGINT) AS error
            FROM near{rounds} GROUP BY r
        ),
        digest AS (
            SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds}
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM kept JOIN coded USING (r), digest
    """

LLM_ORACLES = {
    "op8_exact_dedup": """
        WITH t AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)
    """,
    "op7_threshold_top": """
        WITH c AS (
            SELECT vec_id, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS d FROM embeddings
        ),
        q AS (SELECT vec_id, d, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS v FROM c),
        s AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(sum(a.v * b.v) AS BIGINT) AS score
            FROM q a JOIN q b ON a.d = b.d AND a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id GROUP BY a.vec_id, b.vec_id
        ),
        r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                   vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op11_fill_middle": """
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                   sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
            FROM documents
        ),
        d AS (
            SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS p,
                   CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS q, CAST('0x' || h[17:24] AS BIGINT) % 100 AS shape,
                   CAST('0x' || h[25:32] AS BIGINT) % 100 AS form
            FROM t
        ),
        c AS (
            SELECT doc_id, text, n,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR shape >= 90
                        THEN 'plain' WHEN form < 20 THEN 'spm' ELSE 'psm' END AS form,
                   array_to_string(u[1:least(p, q)], '') AS pre, array_to_string(u[least(p, q) + 1:greatest(p, q)], '') AS mid,
                   array_to_string(u[greatest(p, q) + 1:], '') AS suf
            FROM d
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid
                      ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM c
    """,
    "op13_vector_codes": product_code_sql(),
}
