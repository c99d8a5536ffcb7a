"""DuckDB SQL for the operators that SQL can express: plain statements of the results, quadratic or
byte by byte where that is simplest, for the small tables that they are compared on."""

from __future__ import annotations

#: Words of a text as the operators take them.
WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH items AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS.format("text")} AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS phrase, least(len(w), 13) AS n
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM items WHERE len(w) > 0)
), docs AS (
    SELECT row_number() OVER () AS r, doc_id, {WORDS.format("text")} AS w FROM documents
), places AS (
    SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), found AS (
    SELECT p.r, p.i, p.n, w.item FROM places p JOIN windows w ON p.phrase = w.phrase AND p.n = w.n
), hit AS (
    SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS at FROM found) GROUP BY r
), named AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

JACCARD = f"""
WITH RECURSIVE docs AS (
    SELECT row_number() OVER () AS r, doc_id, {WORDS.format("text")} AS w FROM documents
), grams AS (
    SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END)) AS g
    FROM docs WHERE len(w) > 0
), classes AS (
    SELECT g, min(doc_id) AS class_id, count(*) AS size FROM grams GROUP BY g
), numbered AS (
    SELECT row_number() OVER () AS c, g, class_id, size FROM classes
), flat AS (
    SELECT c, len(g) AS n, unnest(g) AS x FROM numbered
), held AS (
    SELECT c, n, x FROM flat WHERE x IN (SELECT x FROM flat GROUP BY x HAVING count(*) > 1)
), linked AS (
    SELECT a.c AS a, b.c AS b FROM held a JOIN held b ON a.x = b.x AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9
), counts AS (
    SELECT a AS c, sum(size) AS links FROM linked JOIN numbered ON numbered.c = linked.b GROUP BY a
), reach(c, d) AS (
    SELECT c, c FROM numbered UNION SELECT reach.c, linked.b FROM reach JOIN linked ON linked.a = reach.d
), clusters AS (
    SELECT reach.c, min(numbered.class_id) AS cluster_id FROM reach JOIN numbered ON numbered.c = reach.d GROUP BY reach.c
)
SELECT grams.doc_id, class_id, CAST(size - 1 + coalesce(links, 0) AS BIGINT) AS n_links, cluster_id
FROM grams JOIN numbered USING (g) JOIN clusters USING (c) LEFT JOIN counts USING (c)
UNION ALL
SELECT doc_id, doc_id, 0, doc_id FROM docs WHERE len(w) = 0
"""

#: Bytes are pairs of hexadecimal digits here.
REPEATS = """
WITH docs AS (
    SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), places AS (
    SELECT r, i, md5_number(substring(h, 2 * i + 1, 200)) AS x FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM docs WHERE len(h) >= 200)
), again AS (
    SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY x ORDER BY r, i) AS k FROM places) WHERE k > 1
), runs AS (
    SELECT r, i, sum(CASE WHEN i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run
    FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM again)
), spans AS (
    SELECT r, min(i) AS s, max(i) + 100 AS e FROM runs GROUP BY r, run
), gaps AS (
    SELECT r, s, e, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY s) AS since, lead(s) OVER (PARTITION BY r ORDER BY s) AS next FROM spans
), kept AS (
    SELECT g.r, sum(e - s) AS n_removed, count(*) AS n_spans,
        string_agg(substring(h, 2 * since + 1, 2 * (s - since)) || CASE WHEN next IS NULL THEN substring(h, 2 * e + 1) ELSE '' END, '' ORDER BY s) AS h
    FROM gaps g JOIN docs USING (r) GROUP BY g.r
)
SELECT doc_id, CAST(len(docs.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, docs.h))) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""

INFILL = """
WITH drawn AS (
    SELECT doc_id, text, n, CAST('0x' || substring(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substring(x, 9, 8) AS BIGINT) AS h2,
        CAST('0x' || substring(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substring(x, 25, 8) AS BIGINT) AS h4
    FROM (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents)
), cuts AS (
    SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
), parts AS (
    SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(prefix || middle || suffix) AS restored_sha256
FROM parts
"""

#: One assignment to codebook {0}, and the means that make codebook {1}.
CODES_ROUND = """
, d{0} AS MATERIALIZED (
    SELECT p.r, p.part, p.x, b.entry, list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.c) + list_inner_product(b.c, b.c) AS d FROM parts p JOIN b{0} b ON p.part = b.part
), a{0} AS MATERIALIZED (
    SELECT r, part, any_value(x) AS x, min(struct_pack(d := d, entry := entry)) AS best FROM d{0} GROUP BY r, part
), m{0} AS (
    SELECT part, entry, list(floor(total / n) ORDER BY pos) AS c
    FROM (SELECT part, best.entry AS entry, pos, sum(x[pos]) AS total, count(*) AS n FROM a{0}, (SELECT unnest(range(1, width + 1)) AS pos FROM sizes) GROUP BY ALL) GROUP BY part, entry
), b{1} AS MATERIALIZED (
    SELECT part, entry, coalesce(m{0}.c, b{0}.c) AS c FROM b{0} LEFT JOIN m{0} USING (part, entry)
)
"""

CODES = (
    """
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), sizes AS (
    SELECT greatest(1, CAST(ceil(max(len(v)) / 4) AS BIGINT)) AS width FROM kept
), parts AS MATERIALIZED (
    SELECT r, part, list_transform(list_resize(v, 4 * width, 0.0)[part * width + 1 : (part + 1) * width], lambda x: CAST(x AS DOUBLE)) AS x
    FROM kept, sizes, (SELECT unnest(range(0, 4)) AS part)
), b0 AS MATERIALIZED (
    SELECT part, r - 1 AS entry, x AS c FROM parts WHERE r <= 256
)
"""
    + "".join(CODES_ROUND.format(k, k + 1) for k in range(4))
    + """
, d AS (
    SELECT p.r, p.part, b.entry, list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.c) + list_inner_product(b.c, b.c) AS d FROM parts p JOIN b4 b ON p.part = b.part
), a AS (
    SELECT r, part, min(struct_pack(d := d, entry := entry)) AS best FROM d GROUP BY r, part
), coded AS (
    SELECT r, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a GROUP BY r
), digest AS (
    SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b4
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), digest
"""
)

SQL = {
    "op11_vectorcodes": CODES,
    "op13_infill": INFILL,
    "op1_decontamination": DECONTAMINATION,
    "op2_jaccardjoin": JACCARD,
    "op3_suffixdedup": REPEATS,
}
