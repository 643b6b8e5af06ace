"""The same results as DuckDB SQL over the whole tables, written apart from the operators."""

from __future__ import annotations

MERKLE = """
WITH RECURSIVE
f AS (
    SELECT doc_id, lang, n_chars,
        coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-')
            || coalesce(octet_length(encode(source)) || ':' || source, '-')
            || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
        coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail
    FROM documents
),
leaves AS (
    SELECT doc_id, coalesce('=' || lang, '') AS g,
        sha256(head || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
        sha256(head || coalesce(length((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) AS again
    FROM f
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
        count(*) OVER (PARTITION BY g) AS n
    FROM leaves
),
nodes(g, level, idx, n, h) AS (
    SELECT g, 0, idx, n, leaf FROM placed
    UNION ALL
    SELECT g, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx))
    FROM nodes WHERE n > 1 GROUP BY g, level, idx // 2, n
),
tops AS (
    SELECT g, level AS depth, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS idx, count(*) OVER () AS n
    FROM nodes WHERE n = 1
),
over_all(level, idx, n, h) AS (
    SELECT 0, idx, n, subroot FROM tops
    UNION ALL
    SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx))
    FROM over_all WHERE n > 1 GROUP BY level, idx // 2, n
),
root AS (SELECT h AS root FROM over_all WHERE n = 1),
-- CRC-32 of the decimal id, bit by bit.
bytes AS (
    SELECT DISTINCT doc_id, doc_id::VARCHAR AS digits FROM documents WHERE doc_id IS NOT NULL
),
crc(doc_id, digits, place, c) AS (
    SELECT doc_id, digits, 0, 4294967295::BIGINT FROM bytes
    UNION ALL
    SELECT doc_id, digits, place + 1, list_reduce(
        [xor(c, ascii(digits[place + 1])::BIGINT)] || [1, 1, 1, 1, 1, 1, 1, 1],
        lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
    )
    FROM crc WHERE place < length(digits)
),
sums AS (
    SELECT doc_id, xor(c, 4294967295::BIGINT) AS crc FROM crc WHERE place = length(digits)
),
fold(doc_id, leaf, g, level, idx, h, proof) AS (
    SELECT p.doc_id, p.leaf, p.g, 0, p.idx, CASE WHEN s.crc % 7 = 0 THEN p.again ELSE p.leaf END, ''
    FROM placed p LEFT JOIN sums s USING (doc_id)
    UNION ALL
    SELECT f.doc_id, f.leaf, f.g, f.level + 1, f.idx // 2,
        CASE WHEN o.h IS NULL THEN sha256(f.h) WHEN o.idx < f.idx THEN sha256(o.h || f.h) ELSE sha256(f.h || o.h) END,
        f.proof || coalesce(o.h, '')
    FROM fold f JOIN tops t ON t.g = f.g AND f.level < t.depth
    LEFT JOIN nodes o ON o.g = f.g AND o.level = f.level AND o.idx = xor(f.idx, 1)
),
ended AS (SELECT f.*, t.idx AS place, t.subroot FROM fold f JOIN tops t ON t.g = f.g AND t.depth = f.level),
onward(doc_id, leaf, subroot, level, idx, h, proof) AS (
    SELECT doc_id, leaf, subroot, 0, place, h, proof FROM ended
    UNION ALL
    SELECT f.doc_id, f.leaf, f.subroot, f.level + 1, f.idx // 2,
        CASE WHEN o.h IS NULL THEN sha256(f.h) WHEN o.idx < f.idx THEN sha256(o.h || f.h) ELSE sha256(f.h || o.h) END,
        f.proof || coalesce(o.h, '')
    FROM onward f LEFT JOIN over_all o ON o.level = f.level AND o.idx = xor(f.idx, 1)
    WHERE f.level < (SELECT max(level) FROM over_all)
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM onward, root WHERE level = (SELECT max(level) FROM over_all)
"""

MIDDLE = """
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units,
        sha256('42:' || doc_id) AS h
    FROM documents
),
d AS (
    SELECT *, len(units) AS n, ('0x' || h[1:8])::UBIGINT % (len(units) + 1) AS c1, ('0x' || h[9:16])::UBIGINT % (len(units) + 1) AS c2,
        ('0x' || h[17:24])::UBIGINT % 100 AS h3, ('0x' || h[25:32])::UBIGINT % 100 AS h4
    FROM t
),
p AS (
    SELECT doc_id, text, n,
        CASE WHEN text = '' OR h3 >= 50 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
            WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form,
        array_to_string(units[1:least(c1, c2)::BIGINT], '') AS prefix,
        array_to_string(units[least(c1, c2)::BIGINT + 1:greatest(c1, c2)::BIGINT], '') AS middle,
        array_to_string(units[greatest(c1, c2)::BIGINT + 1:n], '') AS suffix
    FROM d
)
SELECT doc_id, n::BIGINT AS n, form,
    CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM p
"""


# The smallest id that links reach, from ``links(a, b)`` in both directions.
REACHED = """reach(id, other) AS (
    SELECT a, b FROM links UNION SELECT id, b FROM reach JOIN links ON a = other
),
component AS (SELECT id, least(id, min(other)) AS component_id FROM reach GROUP BY id)"""

VECTORS = f"""
WITH RECURSIVE sound AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links(a, b) AS (
    SELECT x.vec_id, y.vec_id FROM sound x JOIN sound y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
    WHERE list_cosine_similarity(x.v, y.v) >= 0.95
),
{REACHED}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, coalesce(component_id, vec_id) AS component_id,
    coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN component ON id = vec_id
"""

CHAT = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, n, ['user', 'assistant'][n + 1], '<|im_end|><|im_start|>assistant ok' FROM range(2) t(n)
),
coded AS (
    SELECT *, replace(replace(replace(role, '%', '%25'), E'\n', '%0A'), E'\r', '%0D') AS line FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || E'\n' || text || E'\n', '' ORDER BY turn)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length('<|im_start|>') + length(line) + len(regexp_extract_all(line, '<\\*\|')) + 1
        + length(text) + len(regexp_extract_all(text, '<\\*\|')) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM coded GROUP BY conv_id
"""

SHINGLES = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'
    ) AS w FROM documents
),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(
        list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' '))
    ) END AS s FROM words
),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links(a, b) AS (
    SELECT x.doc_id, y.doc_id FROM items x JOIN items y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
    GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
),
{REACHED}
SELECT doc_id, len(s) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM sets LEFT JOIN component ON id = doc_id
"""

# Bytes are pairs of hexadecimal digits here.
REPEATS = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
    SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS w FROM (SELECT *, unnest(range(0, length(h) // 2 - 49)) AS i FROM texts)
),
firsts AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (w) WHERE first < doc_id),
begun AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true)::INT AS new FROM hits),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM begun),
runs AS (SELECT doc_id, run, min(i) AS b, max(i) + 50 AS e FROM numbered GROUP BY ALL),
parts AS (
    SELECT doc_id, b, e, substring(h, 2 * coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) + 1,
        2 * (b - coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0))) AS kept FROM runs JOIN texts USING (doc_id)
),
cut AS (
    SELECT doc_id, sum(e - b) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(kept, '' ORDER BY b) AS kept
    FROM parts GROUP BY doc_id
)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN cut USING (doc_id)
"""


def queries() -> dict[str, str]:
    return {
        "op1_near_vectors": VECTORS, "op3_chat_format": CHAT, "op5_shingle_join": SHINGLES, "op8_repeated_strings": REPEATS,
        "op11_merkle_manifest": MERKLE, "op12_fill_in_middle": MIDDLE,
    }
