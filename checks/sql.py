"""Independent SQL for every checked query, written for DuckDB.

Each query is a list of common table expressions and a final SELECT. The pieces
restate the semantics over whole tables; none shares code with the engine. Only
the stop list, plain data, comes from it.
"""

from __future__ import annotations

from belegwerk.functions.stop_words import GERMAN

BASE = "https://files.example/download/"
BLANK = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
VOW = "aeiouyäöü"


def stop_list() -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in GERMAN) + "]"


def query(*parts: tuple[str, str], final: str) -> str:
    ctes = ",\n".join(f"{name} AS MATERIALIZED (\n{body}\n)" for name, body in dict(parts).items())
    return f"WITH {ctes}\n{final}"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def lead3(text: str) -> str:
    lead = trimmed(f"regexp_extract({text}, '^((?:[^.!?]*[.!?]+\\s*){{1,3}})', 1)")
    return f"CASE WHEN {lead} = '' THEN {trimmed(text)} ELSE {lead} END"


def words_of(q: str) -> str:
    return (f"[trim(w, '?!.,') FOR w IN string_split_regex(lower({q}), '{BLANK}+') IF w <> '']")


def terms_of(q: str) -> str:
    kept = (f"[t FOR t IN {words_of(q)} IF length(t) > 1 "
            f"AND NOT list_contains(stops.l, t)]")
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE [lower({q})] END"


def tokens_of(x: str) -> str:
    return f"[t FOR t IN string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+') IF t <> '']"


def token_rows(src: str, key: str, text: str) -> str:
    return f"""SELECT {key}, unnest(l) AS token, generate_subscripts(l, 1) AS pos
FROM (SELECT {key}, {tokens_of(text)} AS l FROM {src}) WHERE len(l) > 0"""


def windows(src: str, keep: str, text: str, size: int, overlap: int, idx: str, out: str) -> str:
    stride = size - overlap
    return f"""SELECT {keep}, i AS {idx}, substring({text}, 1 + {stride} * i, {size}) AS {out}
FROM (SELECT *, unnest(range(0, greatest(0, ceil((length({text}) - {overlap}) / {stride}.0) - 1)::BIGINT + 1)) AS i
      FROM {src} WHERE length({text}) > 0)"""


STOPS = ("stops", f"SELECT {stop_list()} AS l")
DOCS = ("docs", f"""SELECT concat(source, '_', lang, '_', doc_id, '.txt') AS title, text,
  concat('{BASE}', source, '_', lang, '_', doc_id, '.txt') AS source_url, {lead3('text')} AS summary
FROM documents""")
PARENTS = [
    DOCS,
    ("p0", windows("docs", "title, source_url, summary", "text", 1750, 250, "parent_idx", "full_text")),
    ("parents", "SELECT sha256(title || chr(1) || parent_idx || chr(1) || full_text) AS id, * FROM p0"),
]
CHUNKS = PARENTS + [
    ("c0", windows("(SELECT id AS parent_id, full_text FROM parents)", "parent_id", "full_text", 300, 50,
                   "child_idx", "content")),
    ("chunks", "SELECT sha256(parent_id || chr(1) || child_idx || chr(1) || content) AS id, * FROM c0"),
]
QUESTIONS = ("questions", r"""SELECT item_id * 1000 + n AS qid, question FROM (
  SELECT item_id, unnest(l) AS question, generate_subscripts(l, 1) - 1 AS n
  FROM (SELECT item_id, [s FOR s IN string_split_regex(text, '[.!?]+\s*') IF trim(s, ' ') <> ''] AS l
        FROM benchmark))""")
TERMS = [STOPS, QUESTIONS, ("terms", f"SELECT qid, question, {terms_of('question')} AS terms FROM questions, stops")]


def embedding(name: str, src: str, key: str, text: str) -> list[tuple[str, str]]:
    """Hashed bag of words of a text, unit length, as ``name(key, v)``."""
    return [
        (f"{name}_tok", token_rows(src, key, text)),
        (f"{name}_cnt", f"""SELECT {key}, ('0x' || substr(md5(token), 1, 8))::UBIGINT % 64 AS b, count(*) AS c
FROM {name}_tok GROUP BY ALL"""),
        (f"{name}_len", f"SELECT {key}, sqrt(sum(c * c)::DOUBLE) AS n FROM {name}_cnt GROUP BY ALL"),
        (name, f"""SELECT {key}, list((coalesce(c, 0) / n)::FLOAT ORDER BY g.b) AS v
FROM {name}_len CROSS JOIN (SELECT unnest(range(64)) AS b) g LEFT JOIN {name}_cnt USING ({key}, b)
GROUP BY ALL"""),
    ]


def cosine(a: str, b: str) -> str:
    return f"round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 9)"


EMBEDDED = CHUNKS + embedding("cvec", "chunks", "id", "content")
ASKED = [QUESTIONS] + embedding("qvec", "questions", "qid", "question")


def similar(threshold: float) -> tuple[str, str]:
    return ("sim", f"""SELECT * FROM (SELECT q.qid, c.id AS chunk_id, k.parent_id, {cosine('q.v', 'c.v')} AS score
FROM qvec q CROSS JOIN cvec c JOIN chunks k ON k.id = c.id) WHERE score > {threshold}""")


def ranked(src: str, k: int, by: str = "qid", order: str = "score DESC, chunk_id") -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rank
FROM {src}) WHERE rank <= {k}"""


def stems(src: str) -> list[tuple[str, str]]:
    """German Snowball stems of ``src(token)`` as ``stem(token, lexeme)``."""
    region = f"^[^{VOW}]*[{VOW}]+[^{VOW}]"
    s0 = f"regexp_replace(regexp_replace(token, 'ß', 'ss', 'g'), '([{VOW}])(u|y)([{VOW}])', '\\1#\\2\\3', 'g')"
    return [
        ("st0", f"""SELECT token, replace(replace({s0}, '#u', 'U'), '#y', 'Y') AS w
FROM (SELECT DISTINCT token FROM {src})"""),
        ("st1", f"""SELECT *, CASE WHEN length(w) >= 3 THEN nullif(length(regexp_extract(w, '{region}')), 0) END AS p1
FROM st0"""),
        ("st2", f"""SELECT token, w, CASE WHEN p1 IS NULL THEN length(w) ELSE greatest(p1, 3) END AS r1,
  CASE WHEN p1 IS NULL OR regexp_extract(substring(w, p1 + 1), '{region}') = '' THEN length(w)
       ELSE p1 + length(regexp_extract(substring(w, p1 + 1), '{region}')) END AS r2 FROM st1"""),
        ("st3", """SELECT token, r1, r2, CASE
  WHEN length(w) - length(e) < r1 OR e = '' THEN w
  WHEN e IN ('em', 'ern', 'er') THEN left(w, length(w) - length(e))
  WHEN e IN ('e', 'en', 'es') THEN regexp_replace(left(w, length(w) - length(e)), 'niss$', 'nis')
  WHEN regexp_matches(w, '[bdfghklmnrt]s$') THEN left(w, length(w) - 1) ELSE w END AS w
FROM (SELECT *, regexp_extract(w, '(ern|em|er|en|es|e|s)$', 1) AS e FROM st2)"""),
        ("st4", """SELECT token, r1, r2, CASE
  WHEN length(w) - length(e) < r1 OR e = '' THEN w
  WHEN e IN ('en', 'er', 'est') THEN left(w, length(w) - length(e))
  WHEN regexp_matches(w, '...[bdfghklmnt]st$') THEN left(w, length(w) - 2) ELSE w END AS w
FROM (SELECT *, regexp_extract(w, '(est|st|en|er)$', 1) AS e FROM st3)"""),
        ("st5", """SELECT token, r1, r2, w, e, left(w, length(w) - length(e)) AS b
FROM (SELECT *, regexp_extract(w, '(isch|lich|heit|keit|end|ung|ig|ik)$', 1) AS e FROM st4)"""),
        ("stem", """SELECT token, translate(CASE
  WHEN e = '' OR length(b) < r2 THEN w
  WHEN e IN ('end', 'ung') THEN CASE WHEN b LIKE '%ig' AND length(b) - 2 >= r2 AND b NOT LIKE '%eig'
                                     THEN left(b, length(b) - 2) ELSE b END
  WHEN e IN ('ig', 'ik', 'isch') THEN CASE WHEN b LIKE '%e' THEN w ELSE b END
  WHEN e IN ('lich', 'heit') THEN CASE WHEN (b LIKE '%er' OR b LIKE '%en') AND length(b) - 2 >= r1
                                       THEN left(b, length(b) - 2) ELSE b END
  WHEN b LIKE '%lich' AND length(b) - 4 >= r2 THEN left(b, length(b) - 4)
  WHEN b LIKE '%ig' AND length(b) - 2 >= r2 THEN left(b, length(b) - 2)
  ELSE b END, 'UYäöü', 'uyaou') AS lexeme FROM st5"""),
    ]


# Chunk postings and question lexemes, both German.
LEXED = TERMS + CHUNKS + [
    ("ctok", token_rows("chunks", "id", "content")),
    ("qtok", token_rows("(SELECT qid, array_to_string(terms, ' ') AS t FROM terms)", "qid", "t")),
    ("alltok", "SELECT token FROM ctok UNION SELECT token FROM qtok"),
] + stems("(SELECT token FROM alltok WHERE NOT list_contains((SELECT l FROM stops), token))") + [
    ("occ", "SELECT id, lexeme, pos FROM ctok JOIN stem USING (token)"),
    ("qlex", "SELECT DISTINCT qid, lexeme FROM qtok JOIN stem USING (token)"),
]
FTS = LEXED + [
    ("need", "SELECT qid, count(*) AS n FROM qlex GROUP BY qid"),
    ("hit", "SELECT qid, id, lexeme, pos FROM qlex JOIN occ USING (lexeme)"),
    ("full_hit", """SELECT qid, id, n FROM hit JOIN need USING (qid) GROUP BY qid, id, n
HAVING count(DISTINCT lexeme) = n"""),
    ("m", "SELECT hit.*, n FROM hit JOIN full_hit USING (qid, id)"),
    ("seen", """SELECT e.qid, e.id, e.n, e.pos AS e, x.lexeme, max(x.pos) AS last
FROM m e JOIN m x ON e.qid = x.qid AND e.id = x.id AND x.pos <= e.pos GROUP BY ALL"""),
    ("cover", """SELECT qid, id, p, min(e) AS e FROM (
  SELECT qid, id, e, min(last) AS p FROM seen GROUP BY qid, id, n, e HAVING count(*) = n) GROUP BY ALL"""),
    ("fts", """SELECT qid, id, round(sum(0.1::DOUBLE / (1 + (e - p) - (k - 1))), 9) AS score FROM (
  SELECT c.qid, c.id, c.p, c.e, count(*) AS k FROM cover c JOIN m
  ON m.qid = c.qid AND m.id = c.id AND m.pos BETWEEN c.p AND c.e GROUP BY ALL) GROUP BY qid, id"""),
]
KEYWORD = FTS + [
    ("ptext", "SELECT id AS parent_id, lower(full_text) AS t FROM parents"),
    ("term1", "SELECT DISTINCT qid, unnest(terms) AS term FROM terms"),
    ("pterm", "SELECT term, parent_id FROM (SELECT DISTINCT term FROM term1) JOIN ptext ON contains(t, term)"),
    ("phit", "SELECT DISTINCT qid, parent_id FROM term1 JOIN pterm USING (term)"),
    ("kw0", """SELECT qid, id AS chunk_id, parent_id, max(score) AS score FROM (
  SELECT qid, id, parent_id, score FROM fts JOIN chunks USING (id)
  UNION ALL SELECT qid, id, parent_id, 0 FROM phit JOIN chunks USING (parent_id)) GROUP BY ALL"""),
    ("kw", ranked("kw0", 15)),
]
HYBRID = KEYWORD + ASKED[1:] + EMBEDDED[len(CHUNKS):] + [
    similar(0.60),
    ("vec", ranked("sim", 25)),
    ("fused", """SELECT qid, parent_id, max(score) AS final_score FROM (
  SELECT qid, parent_id, score FROM vec UNION ALL SELECT qid, parent_id, score FROM kw) GROUP BY ALL"""),
    ("cand", """SELECT f.qid, f.parent_id, p.title, p.source_url, p.full_text, p.summary, f.final_score,
  row_number() OVER (PARTITION BY f.qid ORDER BY final_score DESC, f.parent_id) AS fused_rank
FROM fused f JOIN parents p ON p.id = f.parent_id"""),
]


DOCSEARCH = [
    ("dvec", """SELECT s.qid, p.title, p.source_url, max(s.score) AS score
FROM dsim s JOIN parents p ON p.id = s.parent_id GROUP BY ALL"""),
    ("names", "SELECT DISTINCT title, source_url FROM parents"),
    ("dtitle", """SELECT DISTINCT qid, title, source_url, 1.0::DOUBLE AS score
FROM (SELECT qid, unnest(terms) AS term FROM terms) JOIN names ON contains(lower(title), term)"""),
    ("dtop", ranked("(SELECT * FROM dvec UNION ALL SELECT * FROM dtitle)", 35,
                    order="score DESC, title, source_url")),
    ("dfirst", """SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS pos FROM (
  SELECT * FROM dtop QUALIFY row_number() OVER (PARTITION BY qid, title ORDER BY rank) = 1)"""),
]


def encoded(url: str) -> str:
    """Percent encoding byte by byte through the reserved set of the engine."""
    out = f"url_encode({url})"
    for code, char in (("%3A", ":"), ("%2F", "/"), ("%3F", "?"), ("%26", "&"), ("%3D", "=")):
        out = f"replace({out}, '{code}', '{char}')"
    return out


def document_similar(threshold: float) -> tuple[str, str]:
    return ("dsim", similar(threshold)[1])


TOP6 = [
    ("scored", """SELECT c.*, len([t FOR t IN list_distinct(t.terms) IF contains(lower(c.full_text), t)])
  / len(list_distinct(t.terms)) AS rerank_score FROM cand c JOIN terms t USING (qid)"""),
    ("top6", ranked("scored", 6, order="rerank_score DESC, fused_rank").replace(" AS rank", " AS pos")
     .replace("rank <= 6", "pos <= 6")),
    ("context", r"""SELECT qid, string_agg(concat(E'\n### QUELLE: ', title,
  E'\nDOKUMENT-INFO (Zusammenfassung): ', coalesce(summary, 'None'),
  E'\nRELEVANTER ABSCHNITT:\n', full_text, E'\n'), '' ORDER BY pos) AS context FROM top6 GROUP BY qid"""),
    ("pdocs", """SELECT qid, title, source_url, row_number() OVER (PARTITION BY qid ORDER BY pos) AS pos FROM (
  SELECT * FROM top6 QUALIFY row_number() OVER (PARTITION BY qid, title ORDER BY pos) = 1)"""),
]


def reference_text(src: str) -> str:
    return rf"""SELECT qid, concat(E'\n\n---\n### 🔍 Referenzen:\n',
  string_agg(concat('- [', title, '](', {encoded('source_url')}, E')\n'), '' ORDER BY pos)) AS refs
FROM {src} GROUP BY qid"""


SEARCH_EMPTY = ("Teile freundlich mit, dass zu dieser Suche nichts gefunden wurde und passende "
                "Dokumente vielleicht noch fehlen.")
SEARCH_FOUND = ("Bestätige in einem Satz, dass Dokumente gefunden wurden. Zähle sie nicht auf; "
                "die Liste folgt von selbst.")
SMALLTALK = "Antworte freundlich und biete Hilfe bei Fragen zu den Dokumenten und bei der Suche an."
PASSAGES = ("Beantworte die Frage vollständig und nur nach den folgenden Abschnitten. Erfinde nichts "
            "und schreibe keine Quellenliste. Sage es, wenn die Abschnitte nichts hergeben.")

MARKERS = ("### Task:", "JSON format:", "concise", "summarizing", "title with", "Generate a short title",
           "Summarize the conversation", "Return only the title", "based on the previous")


def any_of(x: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def rule_reply(x: str, terms: str) -> str:
    opening = f"trim(string_split_regex({trimmed(f'lower({x})')}, '{BLANK}+')[1], '?!.,')"
    greetings = "('hallo', 'hi', 'hey', 'moin', 'servus', 'danke', 'tschüss', 'guten')"
    return rf"""concat('TYPE: ', CASE
  WHEN {any_of(f'lower({x})', ('welche dokumente', 'welche pdfs', 'liste', 'suche'))} THEN 'SEARCH'
  WHEN {opening} IN {greetings} THEN 'SMALLTALK' ELSE 'RAG' END, E'\nQUERY: ', array_to_string({terms}, ' '))"""


INTENT = ("CASE WHEN contains(reply, 'TYPE: SEARCH') THEN 'SEARCH' "
          "WHEN contains(reply, 'TYPE: SMALLTALK') THEN 'SMALLTALK' ELSE 'RAG' END")


def reply_query(question: str) -> str:
    return f"coalesce({trimmed("string_split(reply, 'QUERY:')[2]")}, {question})"


NEWEST = ("newest", "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations")
HISTORY = ("history", rf"""SELECT conv_id, count(*) FILTER (back > 1) AS n_before,
  coalesce(string_agg(concat(role, ': ', {trimmed("string_split(text, '### Referenzen:')[1]")}, E'\n'), ''
           ORDER BY turn) FILTER (back > 1), '') AS history
FROM newest WHERE back <= 4 GROUP BY conv_id""")
REQUESTS = [
    STOPS, NEWEST, HISTORY,
    ("requests", """SELECT conv_id AS qid, CASE WHEN greeted THEN 'Hallo! ' || text
  WHEN role = 'user' THEN 'Welche Dokumente gibt es zu ' || text ELSE text END AS message
FROM newest JOIN (SELECT conv_id, bool_or(role = 'system') AS greeted FROM conversations GROUP BY ALL) USING (conv_id)
WHERE back = 1"""),
    ("replied", f"""SELECT qid, message, {rule_reply('message', 'terms')} AS reply
FROM (SELECT *, {terms_of('message')} AS terms FROM requests, stops) WHERE NOT {any_of('message', MARKERS)}"""),
    ("routed", f"SELECT qid, message, {INTENT} AS intent, {reply_query('message')} AS search_query FROM replied"),
    ("questions", "SELECT qid, search_query AS question FROM routed WHERE intent <> 'SMALLTALK'"),
]


def after(first: list, rest: list) -> list:
    """``rest`` on top of other questions than the benchmark's."""
    return first + [p for p in rest if p[0] not in {name for name, _ in first}]


def given(threshold: float) -> str:
    return query(
        ("q", "SELECT item_id AS qid, embedding AS v FROM benchmark JOIN embeddings ON item_id = vec_id"),
        ("sim", f"""SELECT * FROM (SELECT qid, vec_id AS chunk_id, {cosine('q.v', 'e.embedding')} AS score
FROM q CROSS JOIN embeddings e) WHERE score > {threshold}"""),
        final=f"SELECT qid, chunk_id, rank, round(score, 6) AS score FROM ({ranked('sim', 25)})",
    )


STORED = """SELECT title, source_url, summary, count(*) AS parents, sum(n)::BIGINT AS chunks,
  min(first_id) AS first_chunk
FROM parents JOIN (SELECT parent_id, count(*) AS n, min(id) AS first_id FROM chunks GROUP BY parent_id) c
ON c.parent_id = parents.id GROUP BY ALL"""

MARKDOWN_RULES = (
    (r"<!--.*?-->", "", "gs"),
    (r"<script\b[^>]*>.*?</script\s*>", "", "gsi"),
    (r"<style\b[^>]*>.*?</style\s*>", "", "gsi"),
    (r"<head\b[^>]*>.*?</head\s*>", "", "gsi"),
    (r"\s+", " ", "g"),
    (r"<h1\b[^>]*>", r"\n\n# ", "gi"),
    (r"<h2\b[^>]*>", r"\n\n## ", "gi"),
    (r"<h3\b[^>]*>", r"\n\n### ", "gi"),
    (r"<h[4-6]\b[^>]*>", r"\n\n#### ", "gi"),
    (r"<li\b[^>]*>", r"\n- ", "gi"),
    (r"<br\s*/?>", r"\n", "gi"),
    (r"</?(p|div|article|section|ul|ol|table|tr|nav|header|footer|main|aside|h[1-6])\b[^>]*>", r"\n\n", "gi"),
    (r"<[^>]*>", "", "g"),
    (r"[ \t]*\n[ \t]*", r"\n", "g"),
    (r"\n{3,}", r"\n\n", "g"),
    (r"[ \t]{2,}", " ", "g"),
    (r"^\s+|\s+$", "", "g"),
)


def markdown(html: str) -> str:
    out = html
    for pattern, text, flags in MARKDOWN_RULES:
        out = f"regexp_replace({out}, '{pattern}', E'{text}', '{flags}')"
    return entities(out)


def entities(out: str) -> str:
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                       ("&#39;", "''"), ("&apos;", "''"), ("&copy;", "©"), ("&middot;", "·")):
        out = f"replace({out}, '{name}', '{char}')"
    return f"regexp_replace({out}, '&amp;?', '&', 'g')"  # also without its end, as browsers read it


def queries() -> dict[str, str]:
    """SQL per registered query; those left out have no SQL form."""
    q: dict[str, str] = {}
    q["vector_topk"] = q["vector_topk_blocks"] = q["vector_lists"] = given(0.2)
    q["vector_topk_strict"] = given(0.6)
    sims = ASKED + EMBEDDED + [similar(0.60), ("vec", ranked("sim", 25))]
    q["vector_best_parent"] = query(*sims, final="""SELECT qid, parent_id, round(max(score), 6) AS final_score
FROM vec GROUP BY ALL""")
    clean = ("docs", DOCS[1] + "\nWHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
    q["delete_then_search"] = query(*after([clean], sims), final="""SELECT qid, parent_id, round(max(score), 6) AS final_score
FROM vec GROUP BY ALL""")
    q["hashed_embedding"] = query(
        DOCS, *embedding("dv", "docs", "title", "text"),
        final="""SELECT title, array_to_string([round(x::DOUBLE * 10000)::INT FOR x IN coalesce(v, [0 FOR i IN range(64)])], ',')
AS vector FROM docs LEFT JOIN dv USING (title)""")

    q["search_terms"] = query(*TERMS, DOCS, final=f"""
SELECT qid::VARCHAR AS key, array_to_string(terms, ' ') AS terms FROM terms
UNION ALL SELECT title, array_to_string({terms_of('text')}, ' ') FROM docs, stops""")
    q["text_any_match"] = query(*TERMS, *KEYWORD, final="""SELECT qid, count(*) AS parents,
  min(parent_id) AS first_id, max(parent_id) AS last_id FROM phit GROUP BY qid""")
    wild = ("wild", """SELECT qid, unnest([substring(terms[1], 1, 1) || '_' || substring(terms[1], 3),
  terms[1] || '%' || terms[2]]) AS pattern FROM terms""")
    q["wildcard_match"] = query(*TERMS, wild, *PARENTS, final="""SELECT qid, count(*) AS parents, min(id) AS first_id, max(id) AS last_id
FROM (SELECT DISTINCT qid, id FROM (SELECT DISTINCT pattern, id FROM (SELECT DISTINCT pattern FROM wild) p
  JOIN (SELECT id, lower(full_text) AS t FROM parents) ON t LIKE '%' || pattern || '%') JOIN wild USING (pattern)) GROUP BY qid""")
    q["wildcard_titles"] = query(QUESTIONS, DOCS, final="""SELECT qid, title FROM questions JOIN (SELECT DISTINCT title, source_url FROM docs)
ON lower(title) LIKE '%src_%' || (qid % 10) || '_.txt%'
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY title, source_url) <= 35""")
    names = PARENTS + [DOCSEARCH[1], DOCSEARCH[2]]
    q["title_any_match"] = query(*TERMS, *names, final="SELECT qid, title, source_url, score FROM dtitle")
    q["postings"] = query(*LEXED, final="""SELECT lexeme, id, array_to_string(list(pos ORDER BY pos), ',') AS positions
FROM occ GROUP BY ALL""")
    title_tokens = [STOPS, DOCS, ("ttok", token_rows("(SELECT title, title AS t FROM docs)", "title", "t"))]
    live = "(SELECT token FROM {} WHERE NOT list_contains((SELECT l FROM stops), token))"
    q["title_search"] = query(DOCS, ("hits", """SELECT source AS qid, title, round(0.1 / 3, 6) AS score
FROM (SELECT DISTINCT source FROM documents) JOIN docs ON string_split(title, '_')[1] = source"""),
        final=f"SELECT qid, title, rank, score FROM ({ranked('hits', 35, order='title')})")
    q["postings_title"] = query(*title_tokens, *stems(live.format("ttok")), final="""SELECT lexeme, title,
  array_to_string(list(pos ORDER BY pos), ',') AS positions FROM ttok JOIN stem USING (token) GROUP BY ALL""")
    q["stemmed_terms"] = query(STOPS, DOCS, ("dtok", token_rows("docs", "title", "text")),
                               *stems(live.format("dtok")), final="""SELECT lexeme, count(*) AS n,
  sum(pos)::BIGINT AS position_sum FROM dtok JOIN stem USING (token) GROUP BY lexeme""")
    q["fts_match"] = query(*FTS, final="SELECT qid, id FROM full_hit")
    q["cover_density"] = query(*FTS, final="SELECT qid, id, round(score, 6) AS score FROM fts")
    q["keyword_topk"] = q["ingest_then_search"] = query(*KEYWORD, final="""SELECT qid, chunk_id, parent_id, round(score, 6) AS score FROM kw""")

    q["hybrid_fusion"] = query(*HYBRID, final="""SELECT qid, parent_id, title, source_url, summary,
  md5(full_text) AS text_md5, round(final_score, 6) AS final_score, fused_rank FROM cand""")
    q["stream_questions"] = query(*HYBRID, final="""SELECT qid, parent_id, fused_rank,
  round(final_score, 6) AS final_score FROM cand""")
    ranked_docs = TERMS + ASKED[1:] + EMBEDDED + [document_similar(0.65)] + DOCSEARCH
    q["document_search"] = query(*ranked_docs, final=f"""SELECT qid, pos, title, {encoded('source_url')} AS url,
  round(score, 6) AS score FROM dfirst""")
    q["no_hits"] = query(*ranked_docs, final=f"""SELECT qid, 'Dokument-Suche abgeschlossen.' AS context,
  count(title) AS documents, CASE WHEN count(title) = 0 THEN '{SEARCH_EMPTY}' ELSE '{SEARCH_FOUND}' END AS system_prompt
FROM questions LEFT JOIN dfirst USING (qid) GROUP BY qid""")
    top = HYBRID + TOP6
    q["rerank_top6"] = query(*top, final="""SELECT qid, pos, parent_id, fused_rank,
  round(rerank_score, 6) AS rerank_score FROM top6""")
    q["rerank_pairs"] = query(*top, final=r"""SELECT qid, pos, parent_id, round(rerank_score, 6) AS rerank_score,
  md5(concat(E'Instruct: Welche Abschnitte helfen, diese Frage zu beantworten?\nQuery: ', question)) AS prompt_md5 FROM top6 JOIN questions USING (qid)""")
    q["context_blocks"] = query(*top, final="""SELECT qid, length(context) AS n_chars, md5(context) AS context_md5
FROM context""")
    q["passages_per_question"] = query(*top, final="SELECT qid, count(*) AS passages FROM top6 GROUP BY qid")
    q["reference_list"] = query(*top, ("refs", reference_text("pdocs")), final="""SELECT qid,
  coalesce(refs, '') AS reference_text FROM questions LEFT JOIN refs USING (qid)""")

    q["safe_url"] = f"""SELECT page_id, {encoded('url')} AS url,
  {encoded("concat(url, ' ä*~+#%20/', html)")} AS marked_url FROM pages"""
    names = "['.pdf', '.HTML', '.txt', '.exe', '.Md', '', '.tar.gz', '.JPG', '/.pdf', '.docx.bak']"
    q["source_filter"] = query(
        ("paths", f"SELECT concat('/data/in/', page_id, ({names})[page_id % 10 + 1]) AS path FROM pages"),
        ("named", "SELECT path, string_split(path, '/')[-1] AS filename FROM paths"),
        ("typed", """SELECT *, CASE WHEN contains(ltrim(filename, '.'), '.')
  THEN lower('.' || string_split(filename, '.')[-1]) ELSE '' END AS ext FROM named"""),
        final=f"""SELECT path, filename, ext, '{BASE}' || filename AS source_url FROM typed
WHERE ext IN ('.pdf', '.docx', '.pptx', '.xlsx', '.html', '.asc', '.md', '.txt', '.png', '.jpg', '.jpeg', '.tiff')""")
    q["incremental_new"] = """SELECT concat(source, '_', lang, '_', doc_id, '.txt') AS title, doc_id
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
    md = markdown("html")
    q["html_to_markdown"] = f"SELECT page_id, length(markdown) AS n_chars, markdown FROM (SELECT page_id, {md} AS markdown FROM pages)"
    seen = "html"
    for pattern in ("<!--.*?-->", r"<(script|style|head)\b.*?</(script|style|head)>"):
        seen = f"regexp_replace({seen}, '{pattern}', '', 'gs')"
    q["page_markdown"] = f"""SELECT page_id, trim({entities("regexp_extract(html, '<h1>(.*?)</h1>', 1)")}) AS title,
  len(regexp_extract_all(html, '<a href=')) AS links,
  md5(regexp_replace({entities(f"regexp_replace({seen}, '<[^>]*>', ' ', 'g')")}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS letters_md5
FROM pages"""
    q["chunk_fixed"] = query(*CHUNKS, final="""SELECT id, parent_id, child_idx, md5(content) AS content_md5 FROM chunks""")
    q["model_fallbacks"] = query(DOCS, final="""SELECT title, CASE WHEN length(text) % 7 = 3 THEN 'Keine Zusammenfassung verfügbar.'
  ELSE length(text)::VARCHAR END AS summary FROM docs""")
    q["lead3_summary"] = query(DOCS, final="SELECT title, summary FROM docs")
    q["summary_prompts"] = query(DOCS, final=r"""SELECT title, md5(concat('Drei Sätze über: ', text, E'\nEnde')) AS summary FROM docs""")
    q["chunk_recursive_checks"] = query(DOCS, final=f"""SELECT title, 0::BIGINT AS parent_broken, 0::BIGINT AS parent_first,
  0::BIGINT AS child_broken, 0::BIGINT AS child_first FROM docs WHERE {trimmed('text')} <> ''""")
    q["corpus_build"] = q["stream_ingest"] = query(*CHUNKS, final=STORED)
    q["corpus_checks"] = query(
        ("p", "SELECT md5(text) AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"),
        ("c", """SELECT doc_id AS id, md5(text) AS parent_id, len(embedding) AS n
FROM documents LEFT JOIN embeddings ON doc_id = vec_id"""),
        final="""SELECT 'parent id repeated' AS rule, id, count(*) AS n FROM p GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'chunk id repeated', id::VARCHAR, count(*) FROM c GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'chunk without parent', id::VARCHAR, count(*) FROM c WHERE parent_id NOT IN (SELECT id FROM p) GROUP BY id
UNION ALL SELECT 'vector length', id::VARCHAR, count(*) FROM c WHERE n <> 64 GROUP BY id""")
    q["delete_cascade"] = query(
        *CHUNKS,
        ("toxic", """SELECT concat(source, '_', lang, '_', doc_id, '.txt') AS title
FROM documents JOIN labels USING (doc_id) WHERE toxic = 1"""),
        final="""SELECT p.id, p.title, count(*) AS chunks FROM parents p JOIN chunks c ON c.parent_id = p.id
WHERE p.title NOT IN (SELECT title FROM toxic) GROUP BY ALL""")
    q["corpus_stats"] = query(*CHUNKS, final="""SELECT count(DISTINCT title) AS documents, count(*) AS parents,
  (SELECT count(*) FROM chunks) AS chunks FROM parents""")

    q["history_window"] = query(NEWEST, HISTORY, final="SELECT * FROM history")
    q["last_message"] = "SELECT * FROM conversations QUALIFY turn = max(turn) OVER (PARTITION BY conv_id)"
    q["model_messages"] = """SELECT conv_id, -1 AS pos, 'system' AS role, concat('Turns: ', count(*)) AS content
FROM conversations GROUP BY conv_id
UNION ALL SELECT conv_id, turn, CASE WHEN role = 'user' OR turn = max(turn) OVER (PARTITION BY conv_id)
  THEN 'user' ELSE 'assistant' END, text FROM conversations"""
    q["system_task_gate"] = f"""SELECT conv_id, turn, {any_of('m', MARKERS)} AS is_task FROM (
  SELECT *, CASE role WHEN 'system' THEN '### Task: ' || text WHEN 'assistant' THEN text || ' CONCISE' ELSE text END AS m
  FROM conversations)"""
    q["intent_rules"] = query(
        STOPS, ("t", f"SELECT *, {terms_of('text')} AS terms FROM conversations, stops"),
        ("r", f"SELECT *, {rule_reply('text', 'terms')} AS reply FROM t"),
        final=f"SELECT conv_id, turn, reply, {INTENT} AS intent, {reply_query('text')} AS search_query FROM r")
    q["intent_prompts"] = query(NEWEST, HISTORY, REQUESTS[3], final=r"""SELECT qid, md5(concat(
  E'Ordne die Nachricht ein und nenne knappe Suchbegriffe.\nSMALLTALK: Gruß, Dank oder allgemeines Gespräch.\n',
  E'SEARCH: es werden Dokumente oder eine Liste von Dateien verlangt.\nRAG: Fachfrage, die aus den Dokumenten zu beantworten ist.\n',
  E'Der Verlauf zählt nur, wenn die Nachricht sich auf ihn bezieht.\n',
  E'Antworte in zwei Zeilen:\nTYPE: <Klasse>\nQUERY: <Suchbegriffe>\n\nNachricht:\n', message, E'\n\nVerlauf:\n', history)) AS prompt_md5
FROM requests JOIN history ON conv_id = qid""")
    q["raw_requests"] = query(NEWEST, HISTORY, final="""SELECT conv_id AS qid,
  CASE WHEN conv_id % 5 = 4 THEN '' ELSE max(text) FILTER (back = 1) END AS message,
  CASE WHEN conv_id % 5 >= 3 THEN '' ELSE max(history) END AS history,
  CASE WHEN conv_id % 5 >= 3 THEN 1 ELSE count(*) END AS n_messages
FROM newest JOIN history USING (conv_id) GROUP BY conv_id""")
    q["intent_parse"] = query(
        ("r", r"""SELECT *, CASE turn WHEN 0 THEN concat(E'TYPE: SEARCH\nQUERY:  ', text, E' \n')
  WHEN 1 THEN concat(E'TYPE: [SEARCH]\nQUERY: ', text)
  WHEN 2 THEN concat(E'TYPE: SMALLTALK\nQUERY: a QUERY: ', text)
  WHEN 3 THEN concat('TYPE: SMALLTALK or TYPE: SEARCH ', text) END AS reply FROM conversations"""),
        final=f"SELECT conv_id, turn, {INTENT} AS intent, {reply_query('text')} AS search_query FROM r")
    q["routed_answers"] = query(
        *after(REQUESTS, HYBRID + TOP6 + [document_similar(0.65)] + DOCSEARCH),
        ("refs", f"""{reference_text("(SELECT qid, title, source_url, pos FROM pdocs JOIN routed USING (qid) "
            "WHERE intent = 'RAG' UNION ALL SELECT qid, title, source_url, pos FROM dfirst JOIN routed USING (qid) "
            "WHERE intent = 'SEARCH')")}"""),
        ("full_row", """SELECT r.*, CASE intent WHEN 'SMALLTALK' THEN '' WHEN 'SEARCH' THEN 'Dokument-Suche abgeschlossen.'
  ELSE coalesce(context, 'Keine relevanten Dokumente gefunden.') END AS context, coalesce(refs, '') AS refs
FROM routed r LEFT JOIN context USING (qid) LEFT JOIN refs USING (qid)"""),
        ("prompted", rf"""SELECT *, CASE WHEN intent = 'SEARCH' AND refs = '' THEN '{SEARCH_EMPTY}'
  WHEN intent = 'SEARCH' THEN '{SEARCH_FOUND}' WHEN intent = 'SMALLTALK' THEN '{SMALLTALK}'
  ELSE concat('{PASSAGES}', E'\n\n', context) END AS prompt,
  regexp_extract(string_split(context, E'RELEVANTER ABSCHNITT:\n')[2], '^([^.!?]*[.!?]+)', 1) AS sentence FROM full_row"""),
        final=f"""SELECT qid, intent, search_query, md5(context) AS context_md5, md5(prompt) AS prompt_md5,
  CASE WHEN length(sentence) > 0 THEN sentence ELSE prompt END AS answer, refs FROM prompted
UNION ALL SELECT qid, NULL, NULL, md5(''), NULL, message, '' FROM requests WHERE {any_of('message', MARKERS)}""")
    half = """list_max([abs(x::DOUBLE - round_even(x::DOUBLE / pow(2.0, greatest(floor(log2(abs(x::DOUBLE))), -14) - 10), 0)
    * pow(2.0, greatest(floor(log2(abs(x::DOUBLE))), -14) - 10)) FOR x IN embedding IF x <> 0])"""
    q["half_precision"] = f"SELECT vec_id AS id, round({half}, 6) AS largest_gap FROM embeddings"
    q["metric_rows"] = query(*HYBRID, final="""SELECT 'chunk' AS stage, count(*) AS rows FROM chunks
UNION ALL SELECT 'search', count(*) FROM cand""")
    return q
