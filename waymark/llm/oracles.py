"""SQL for DuckDB with the rows of those operator queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _components(links: str) -> str:
    """CTE `component` (id, component_id) of the symmetric links (a, b)."""
    return f"reach(a, b) AS (SELECT a, b FROM {links} UNION SELECT r.a, l.b FROM reach r JOIN {links} l ON r.b = l.a), component AS (SELECT a AS id, least(a, min(b)) AS component_id FROM reach GROUP BY a)"


ORACLE_SQL = {
    "op2_minhash": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
        both_ AS (SELECT p.doc_id AS a, q.doc_id AS b, p.n AS na, q.n AS nb, count(*) AS k FROM e p JOIN e q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM both_ WHERE 100 * k >= 85 * (na + nb - k)), {_components('links')}
        SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept FROM s LEFT JOIN component ON id = doc_id""",
    "op3_decontaminate": f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, w, least(len(w), 13) AS n FROM (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
        bw AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS x FROM b),
        dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM b))),
        m AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, x)),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
        t AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM m GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op7_pq": f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
        u AS (SELECT vec_id, label, list_transform(x, lambda e: e / sqrt(list_inner_product(x, x))) AS x FROM v WHERE list_inner_product(x, x) > 0 AND isfinite(list_inner_product(x, x))),
        links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.label = q.label AND p.vec_id <> q.vec_id WHERE list_inner_product(p.x, q.x) >= 0.98), {_components('links')},
        counts AS (SELECT a AS id, count(*) AS n FROM links GROUP BY 1)
        SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
        FROM embeddings LEFT JOIN component c ON c.id = vec_id LEFT JOIN counts k ON k.id = vec_id""",
    # The pages of the tables have their text in one article element of headings and paragraphs.
    "op11_extract": """WITH a AS (SELECT page_id, url, regexp_replace(split_part(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)', 1), '</article>', 1), '<[^>]*$', '') AS x FROM pages),
        b AS (SELECT page_id, url, list_transform(string_split_regex(x, '</?(?:p|h1)>'), lambda t: regexp_replace(replace(t, '<br>', ' '), '</?b>', '', 'g')) AS b FROM a),
        c AS (SELECT page_id, url, list_transform(b, lambda t: trim(regexp_replace(regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '[\\s]+', ' ', 'g'))) AS c FROM b),
        d AS (SELECT page_id, url, coalesce(array_to_string(list_filter(c, lambda t: t <> ''), chr(10)), '') AS text FROM c)
        SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d""",
}
