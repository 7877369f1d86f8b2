"""DuckDB SQL for the queries that SQL can express: exact definitions, without fingerprints, hashes or anchors."""

from __future__ import annotations

#: Every window of 50 words by its text; a word goes where a window that covers it also starts in a smaller id. Null ids are the largest.
SUBSTRING = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
    SELECT r, id, i, array_to_string(w[i : i + 49], ' ') AS words
    FROM (SELECT r, id, w, unnest(range(1, len(w) - 48)) AS i FROM d)
), least_id AS (
    SELECT words, min(id) AS least FROM win GROUP BY words
), bad AS (
    SELECT r, i FROM win JOIN least_id USING (words) WHERE least < id
), gone AS (
    SELECT DISTINCT r, i + j AS p FROM bad, range(50) AS t(j)
), places AS (
    SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
    SELECT r, string_agg(x, ' ' ORDER BY p) AS line, count(*) AS n FROM places ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

#: Every item-sized window that shares a shingle with an item, compared with all items of its size.
DECONTAMINATION = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, w, len(w) AS nw
    FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM (SELECT DISTINCT doc_id, text FROM documents))
), items AS (
    SELECT row_number() OVER () AS t, item_id, w, len(w) AS n, least(len(w), 5) AS k
    FROM (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE item_id IS NOT NULL)
    WHERE len(w) > 0
), item_grams AS (
    SELECT t, n, k, i - 1 AS q, array_to_string(w[i : i + k - 1], ' ') AS g
    FROM (SELECT t, n, k, w, unnest(range(1, n - k + 2)) AS i FROM items)
), doc_grams AS (
    SELECT r, nw, k, i - 1 AS p, array_to_string(w[i : i + k - 1], ' ') AS g
    FROM (SELECT r, nw, k, w, unnest(range(1, nw - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM items))
), starts AS (
    SELECT DISTINCT r, n, greatest(0, least(p - q, nw - n)) AS start
    FROM doc_grams JOIN (SELECT DISTINCT n, k, q, g FROM item_grams) USING (k, g)
), windows AS (
    SELECT r, n, start, w[start + 1 : start + n] AS w, least(least(n, nw), 5) AS k FROM starts JOIN docs USING (r)
), window_grams AS (
    SELECT r, n, start, size, g, count(*) AS c
    FROM (
        SELECT r, n, start, len(w) - k + 1 AS size, array_to_string(w[i : i + k - 1], ' ') AS g
        FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM windows)
    )
    GROUP BY r, n, start, size, g
), common AS (
    SELECT r, n, start, size, t, sum(least(c, item_c)) AS shared
    FROM window_grams JOIN (SELECT t, n, g, count(*) AS item_c FROM item_grams GROUP BY t, n, g) USING (n, g)
    GROUP BY r, n, start, size, t
), found AS (
    SELECT doc_id, item_id, start, shared / (size + (items.n - k + 1) - shared) AS similarity
    FROM common JOIN items USING (t) JOIN docs USING (r)
)
SELECT doc_id, item_id, count(DISTINCT start) AS n_windows, max(similarity) AS similarity, CAST(arg_max(start, (similarity, -start)) AS INTEGER) AS start
FROM found WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""
