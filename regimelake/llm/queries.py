"""Queries of this subpackage and the SQL that they are checked against."""

from __future__ import annotations

from . import bpe, conversations, html_extraction, near_dedup, packing, quality, sharding, spelling, substring_dedup, token_counts, toxicity, vectors

QUERIES = {
    f.__name__: f
    for f in (
        bpe.op1_byte_bpe, packing.op2_best_fit_packing, vectors.op3_exact_top_k, substring_dedup.op4_substring_dedup, toxicity.op5_toxicity,
        vectors.op6_nearest_neighbours, token_counts.op7_token_counts, near_dedup.op8_minhash_near_dedup, sharding.op9_sharding, html_extraction.op10_html_extraction,
        conversations.op11_conversation_repair, spelling.op12_spelling_variants, quality.op13_quality,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE_SQL = {
    "op3_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op4_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
        h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
        m AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h),
        g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM h JOIN m USING (h) WHERE least < doc_id),
        x AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
        k AS (SELECT x.doc_id, count(*) AS n_words, count(g.i) AS n_removed, coalesce(string_agg(w[x.i], ' ' ORDER BY x.i) FILTER (WHERE g.i IS NULL), '') AS kept
              FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY x.doc_id)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op8_minhash_near_dedup": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        t AS (SELECT string_agg(g, chr(10) ORDER BY g) AS t, doc_id FROM s GROUP BY doc_id),
        c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS rep FROM t),
        r AS (SELECT s.doc_id, g, n FROM s JOIN n USING (doc_id) JOIN c USING (doc_id) WHERE rep = s.doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
        k AS (SELECT rep AS a, rep AS b FROM c WHERE rep = doc_id UNION SELECT k.a, e.b FROM k JOIN e ON k.b = e.a),
        m AS (SELECT a AS rep, min(b) AS least FROM k GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least, doc_id) AS component_id, coalesce(least, doc_id) = doc_id AS kept
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN m USING (rep)""",
    "op9_sharding": """
        WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM (SELECT unnest(range(256)) AS i))),
        crc AS (SELECT DISTINCT text, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda a, x: xor(a // 256, t[CAST(xor(a, x) % 256 AS INTEGER) + 1])), 4294967295) AS c
                FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents), tab),
        d AS (SELECT doc_id, octet_length(encode(coalesce(d.text, ''))) + 16 AS size, c AS text_crc32, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % 8192 AS vslot FROM documents d JOIN crc ON crc.text = coalesce(d.text, '')),
        one AS (SELECT CAST(i AS INTEGER) AS vslot, CAST(i % 40 AS INTEGER) AS shard FROM (SELECT unnest(range(8192)) AS i)),
        two AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5(vslot || ':40'), 1, 8) AS BIGINT), vslot) AS turn, count(*) OVER (PARTITION BY shard) / CAST(41 AS DOUBLE) AS share FROM one),
        grown AS (SELECT vslot, CASE WHEN turn <= floor((shard + 1) * share) - floor(shard * share) THEN 40 ELSE shard END AS grown_shard FROM two)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY vslot, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard, vslot, CAST(sum(size) OVER (PARTITION BY vslot) AS BIGINT) AS slot_bytes, 1 AS map_version
        FROM d JOIN one USING (vslot) JOIN grown USING (vslot)""",
    "op11_conversation_repair": """
        WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM (SELECT unnest(range(256)) AS i))),
        h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
              xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda a, x: xor(a // 256, t[CAST(xor(a, x) % 256 AS INTEGER) + 1])), 4294967295) % 20 AS h FROM conversations, tab),
        d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS c FROM h WHERE h <> 0),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, c) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, c) AS again,
              rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS e FROM d),
        f AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS r, CASE WHEN e = '' THEN 'b' WHEN again > 1 THEN 'd' WHEN right(e, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
              lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM n),
        x AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
              count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) + 1 AS i FROM f GROUP BY conv_id),
        -- The cheapest edits from row i on, after nothing, system, user and assistant: what they cost, their initials, the turns that they leave.
        v AS (SELECT conv_id, i, [{'c': 0, 'a': '', 's': ''}, {'c': 4, 'a': 'II', 's': chr(10) || 'user:' || chr(10) || 'assistant:'}, {'c': 2, 'a': 'I', 's': chr(10) || 'assistant:'}, {'c': 0, 'a': '', 's': ''}] AS v FROM x
              UNION ALL
              SELECT conv_id, i, [list_min([w[1], {'c': w[3].c + 2, 'a': 'I' || w[3].a, 's': u || w[3].s}, {'c': w[4].c + 4, 'a': 'II' || w[4].a, 's': u || b || w[4].s}]), list_min([w[2], {'c': w[3].c + 2, 'a': 'I' || w[3].a, 's': u || w[3].s}, {'c': w[4].c + 4, 'a': 'II' || w[4].a, 's': u || b || w[4].s}]),
                                  list_min([w[3], {'c': w[4].c + 2, 'a': 'I' || w[4].a, 's': b || w[4].s}]), list_min([w[4], {'c': w[3].c + 2, 'a': 'I' || w[3].a, 's': u || w[3].s}])]
              FROM (SELECT conv_id, i, chr(10) || 'user:' AS u, chr(10) || 'assistant:' AS b, list_transform([1, 2, 3, 4], lambda q: list_min([
                        {'c': v[q].c + 3, 'a': 'D' || v[q].a, 's': v[q].s},
                        {'c': CASE WHEN k[q] > 0 AND fault NOT IN ('b', 'd') THEN v[k[q]].c + CAST(fault = 't' AS INTEGER) ELSE 1000000000 END, 'a': 'K' || v[greatest(k[q], 1)].a, 's': chr(10) || role || ':' || text || v[greatest(k[q], 1)].s},
                        {'c': CASE WHEN fault NOT IN ('b', 'd') THEN v[o[q]].c + 2 + CAST(fault = 't' AS INTEGER) ELSE 1000000000 END, 'a': 'R' || v[o[q]].a, 's': chr(10) || CASE WHEN o[q] = 3 THEN 'user:' ELSE 'assistant:' END || text || v[o[q]].s}])) AS w
                    FROM (SELECT f.conv_id, f.i, v.v, f.role, f.text, f.fault, [3, 3, 4, 3] AS o, CASE f.r WHEN 's' THEN [2, 0, 0, 0] WHEN 'u' THEN [3, 3, 0, 3] WHEN 'a' THEN [0, 0, 4, 0] ELSE [0, 0, 0, 0] END AS k FROM v JOIN f ON v.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = v.i - 1))),
        z AS (SELECT x.*, v.v[1] AS z FROM x JOIN v ON x.conv_id IS NOT DISTINCT FROM v.conv_id AND v.i = 1)
        SELECT p.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(z.c, 0) AS BIGINT) AS cost, coalesce(z.a, '') AS audit, sha256(coalesce(substr(z.s, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) p LEFT JOIN z ON p.conv_id IS NOT DISTINCT FROM z.conv_id""",
    "op12_spelling_variants": """
        WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM (SELECT unnest(range(256)) AS i))),
        r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
        g AS (SELECT id, run, count(*) AS n FROM r GROUP BY id, run),
        c AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda a, x: xor(a // 256, t[CAST(xor(a, x) % 256 AS INTEGER) + 1])), 4294967295) AS h FROM g, tab),
        w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM c),
        v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        d AS (SELECT word, n, length(word) AS l, i, substr(word, 1, i - 1) || ' ' || substr(word, i + 1) AS other_here, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
        e AS (SELECT a.word, b.word AS other, b.n FROM d a JOIN d b ON a.l = b.l AND a.i = b.i AND a.other_here = b.other_here AND a.word <> b.word
              UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.less = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.less = v.word),
        b AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS best, max(n) AS best_n FROM e GROUP BY word),
        f AS (SELECT v.word, CASE WHEN best_n >= 2 * n THEN best END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n FROM v LEFT JOIN b USING (word)),
        u AS (SELECT word, word AS root FROM f UNION ALL SELECT u.word, f.form FROM u JOIN f ON u.root = f.word WHERE f.form IS NOT NULL),
        z AS (SELECT u.word, u.root FROM u JOIN f ON u.root = f.word WHERE f.form IS NULL)
        SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z USING (word)""",
}
