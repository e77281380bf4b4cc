"""The same results in SQL for an independent engine (DuckDB's dialect), for the queries SQL can express."""

from __future__ import annotations

from ..functions.text import ABBREVIATIONS, REUSE_STOP_WORDS, STOP_WORDS
from ..operators.audit import OTHER_NUMBERS
from ..operators.similar import RELATIONSHIPS, STRENGTHS, STRONGEST
from .corpus import ALIASES

# Fixed values, told here once more so that the operator's own are checked; \b is that of RE2, ASCII as in the original.
ABOUT_THE_SEARCH = [
    r"^(i|we)\s+(could not|couldn't|did not|didn't|cannot|can't|was unable to|found no)\b",
    r"^(no|none of the|nothing in the)\s+(passage|passages|retrieved|search|result|results|text)\b",
    r"^the\s+(passages?|retrieved passages?|search|results?)\s+(do|does|did)\s+not\b",
    r"^(no|nothing)\b[^.]{0,30}\b(was|were)\s+(found|retrieved)\b",
]
TO_THE_READER = [
    r"^if you (mean|meant|want|would like|are looking|had)\b",
    r"\b(let me know|tell me|give me|say the word|ask me)\b",
    r"^(would you|do you|shall i|want me to|i can (search|look|check))\b",
]

SP = r"[\s\x0b\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NOT_REUSE = r"[^a-z0-9''\s\x0b\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words) -> str:
    return "[" + ", ".join(map(q, words)) + "]"


def trim_(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def squash(x: str) -> str:
    return trim_(f"regexp_replace({x}, '{SP}+', ' ', 'g')")


def tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(translate(lower({x}), '‘’', ''''''), '[a-z0-9'']+'), lambda t: length(t) > 1 AND NOT list_contains({listed(STOP_WORDS)}, t))"


def n_words(x: str) -> str:
    return f"(CASE WHEN coalesce(length({trim_(x)}), 0) = 0 THEN 0 ELSE len(regexp_split_to_array({trim_(x)}, '{SP}+')) END)"


def title_words(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def quote_words(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


def reuse_words(x: str) -> str:
    return squash(f"regexp_replace(translate(lower({x}), '‘’', ''''''), '{NOT_REUSE}', ' ', 'g')")


def parts(x: str) -> str:
    """Pieces at every terminator with white space, abbreviations not yet glued."""
    return f"string_split(regexp_replace({x}, '([.!?][”’\"'')\\]]{{0,3}}){SP}+', '\\1' || chr(1), 'g'), chr(1))"


ABBREVIATION = r"(?i)(?:^|[\s\x0b\x{00A0}(\"''“‘\[])(?:" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\.$"


def glued(source: str, keys: str, text: str) -> str:
    """keys, n, piece: sentences of ``text`` in ``source``, a piece after an abbreviation glued to the one before."""
    return f"""
  g1 AS (SELECT {keys}, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT {keys}, {parts(text)} AS p FROM {source})),
  g2 AS (SELECT *, CASE WHEN coalesce(regexp_matches(lag(piece) OVER (PARTITION BY {keys} ORDER BY i), '{ABBREVIATION}'), false) THEN 0 ELSE 1 END AS fresh FROM g1),
  g3 AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY i) AS n FROM g2),
  glued AS (SELECT {keys}, n, string_agg(piece, ' ' ORDER BY i) AS piece FROM g3 GROUP BY {keys}, n)"""


C = "c AS (SELECT DISTINCT ON (id) id, book_id, chapter_index, chunk_index, chapter_title, text, embedding FROM chunks)"
S = "s AS (SELECT DISTINCT ON (book_id, chapter_index) * FROM sections)"
K = "k AS (SELECT DISTINCT ON (id) * FROM cases)"
FB = "f AS (SELECT DISTINCT ON (id) * FROM feedback)"
TH = "th AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, title DESC NULLS LAST) AS _n FROM threads) WHERE _n = 1)"
WORDS = f"coalesce(list_sum(list_transform(paragraphs, lambda p: {n_words('p')})), 0)::BIGINT"
NUMERAL = r"(?i)(^|[^A-Za-z0-9_])([IVXLC]+|\d+)([^A-Za-z0-9_]|$)"

INDEX = f"""{C},
  ct AS (SELECT id, book_id, coalesce({tokens('text')}, []) AS tk FROM c),
  st AS (SELECT count(*) AS n, coalesce(avg(len(tk)), 0) AS avg_len FROM ct),
  po AS (SELECT id, book_id, len, term, count(*) AS tf FROM (SELECT id, book_id, len(tk) AS len, unnest(tk) AS term FROM ct) GROUP BY ALL),
  te AS (SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM po GROUP BY term), st)"""


def query_terms(scoped: bool = False, aliases: bool = False) -> str:
    scope = "book_id" if scoped else "NULL::VARCHAR"
    typed = f"SELECT DISTINCT id AS query_id, {scope} AS scope, unnest({tokens('query_text')}) AS term FROM k"
    if not aliases:
        return f"SELECT *, 1.0::DOUBLE AS weight FROM ({typed})"
    pairs = ", ".join(f"({q(a)}, {q(b)})" for g in ALIASES for a in g for b in g if a != b)
    more = f"SELECT DISTINCT t.query_id, t.scope, al.alias AS term FROM ({typed}) t JOIN (VALUES {pairs}) al(term, alias) USING (term)"
    return f"SELECT *, 1.0::DOUBLE AS weight FROM ({typed}) UNION ALL SELECT m.*, 0.3::DOUBLE FROM ({more}) m ANTI JOIN ({typed}) t ON t.query_id = m.query_id AND t.term = m.term"


def bm25(terms: str, k: int, name: str = "hits") -> str:
    return f"""
  {name}_s AS (SELECT query_id, id, round(sum(weight * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
     FROM po JOIN ({terms}) qt USING (term) JOIN te USING (term), st WHERE scope IS NULL OR scope = book_id GROUP BY query_id, id),
  {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM {name}_s) WHERE rank <= {k})"""


USABLE = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
UNIT = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))"
V = f"v AS (SELECT DISTINCT ON (id) id, book_id, chapter_index, {UNIT} AS vector FROM chunks WHERE {USABLE})"

ARMS = f"""{INDEX}, {K}, {V}, {bm25(query_terms(), 24, 'sparse')},
  qv AS (SELECT query_id, list(x ORDER BY pos) AS vector FROM (
     SELECT query_id, pos, round(avg(x), 6) AS x FROM (SELECT query_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM sparse JOIN v USING (id) WHERE rank <= 3) GROUP BY query_id, pos) GROUP BY query_id),
  dense_s AS (SELECT query_id, v.id, round(list_dot_product(qv.vector, v.vector), 6) AS score FROM qv, v),
  dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM dense_s) WHERE rank <= 24),
  rrf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank ASC NULLS LAST, sparse_rank ASC NULLS LAST)::INTEGER AS rank FROM (
     SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, round(coalesce(1.0::DOUBLE / (10 + a.rank), 0) + coalesce(1.0::DOUBLE / (10 + b.rank), 0), 6) AS score, a.rank - 1 AS dense_rank, b.rank - 1 AS sparse_rank
     FROM dense a FULL JOIN sparse b ON a.query_id = b.query_id AND a.id = b.id)) WHERE rank <= 8)"""

LISTS = f"""{INDEX}, {K}, {bm25(query_terms(), 12, 'l0')}, {bm25(query_terms(aliases=True), 12, 'l1')}, {bm25(query_terms(scoped=True), 12, 'l2')},
  lists AS (SELECT u.*, c.book_id, c.chapter_index FROM (SELECT query_id, id, rank - 1 AS rank, 0 AS list_no FROM l0 UNION ALL SELECT query_id, id, rank - 1, 1 FROM l1 UNION ALL SELECT query_id, id, rank - 1, 2 FROM l2) u JOIN c USING (id))"""

RUNS = f"list_filter(string_split({reuse_words('text')}, ' '), lambda w: w <> '')"
SHINGLES = f"""{C}, cw AS (SELECT id, book_id, {RUNS} AS w FROM c),
  sh0 AS (SELECT id, book_id, CASE WHEN len(w) >= 8 THEN list_transform(range(1, len(w) - 6), lambda i: w[i:i+7]) ELSE [] END AS runs FROM cw),
  sh1 AS (SELECT id, book_id, list_transform(list_filter(runs, lambda r: len(list_distinct(list_filter(r, lambda x: NOT list_contains({listed(REUSE_STOP_WORDS)}, x)))) >= 4), lambda r: array_to_string(r, ' ')) AS ph FROM sh0),
  sh2 AS (SELECT id, book_id, unnest(ph) AS phrase, generate_subscripts(ph, 1) AS place FROM sh1),
  sh AS (SELECT id, book_id, phrase, min(place) AS place FROM sh2 GROUP BY id, book_id, phrase),
  sz AS (SELECT id, count(*) AS size FROM sh GROUP BY id)"""


def reuse(condition: str, least: int) -> str:
    return f"""WITH {SHINGLES} SELECT a_id, b_id, shared, round(shared / (sa.size + sb.size - shared), 4) AS jaccard, longest FROM (
  SELECT a.id AS a_id, b.id AS b_id, count(*) AS shared, first(a.phrase ORDER BY length(a.phrase) DESC, a.place) AS longest FROM sh a JOIN sh b USING (phrase) WHERE a.id < b.id AND {condition} GROUP BY a.id, b.id) p
  JOIN sz sa ON sa.id = a_id JOIN sz sb ON sb.id = b_id WHERE shared >= {least}"""


SPANS = """list_concat(regexp_extract_all(answer, '“([^”]{8,400})”', 1), regexp_extract_all(answer, '"([^"\\s][^"]{6,398}[^"\\s])"', 1))"""
LONG_SPANS = """list_concat(regexp_extract_all(answer, '“([^”]{16,300})”', 1), regexp_extract_all(answer, '"([^"\\s][^"]{14,298}[^"\\s])"', 1))"""
ANSWERS = f"""{FB}, fi AS (SELECT id AS answer_id, answer, coalesce(from_json(cited_ids, '["VARCHAR"]'), []) AS ids FROM f),
  a AS (SELECT answer_id, answer, list_filter(ids, lambda x, i: i % 2 = 1) AS retrieved, list_filter(ids, lambda x, i: i % 2 = 0) AS prior FROM fi)"""
CITES = r"regexp_extract_all(answer, '\[([a-z_]+:\d+:\d+)\]', 1)"
HITS = f"""{INDEX}, {K}, {bm25(query_terms(), 8)},
  hit AS (SELECT h.query_id, h.rank, coalesce(len(list_filter(k.any_of, lambda t: contains(translate(lower(c.text), '‘’', ''''''), translate(lower(t), '‘’', '''''')))) > 0, false) AS hit FROM hits h JOIN k ON k.id = h.query_id JOIN c ON c.id = h.id),
  res AS (SELECT k.id AS query_id, k.case_type AS kind, k.goal, (first IS NOT NULL)::INTEGER AS found, coalesce(round(1.0::DOUBLE / first, 6), 0) AS rr FROM k LEFT JOIN (SELECT query_id, min(rank) AS first FROM hit WHERE hit GROUP BY query_id) USING (query_id))""".replace("LEFT JOIN (SELECT query_id, min(rank) AS first FROM hit WHERE hit GROUP BY query_id) USING (query_id)", "LEFT JOIN (SELECT query_id AS qi, min(rank) AS first FROM hit WHERE hit GROUP BY query_id) ON qi = k.id")


def votes(terms: str, name: str) -> str:
    return f"""{bm25(terms, 8, name)},
  {name}_v AS (SELECT k.id AS case_id, (max(CASE WHEN len(list_filter(k.any_of, lambda t: contains(translate(lower(c.text), '‘’', ''''''), translate(lower(t), '‘’', '''''')))) > 0 THEN 1 END) IS NOT NULL)::INTEGER AS vote
     FROM k LEFT JOIN {name} h ON h.query_id = k.id LEFT JOIN c ON c.id = h.id GROUP BY k.id)"""


TWO = f"""{V}, nm AS (SELECT book_id, row_number() OVER (ORDER BY count(*) DESC, book_id) AS side FROM v GROUP BY book_id),
  va AS (SELECT v.* FROM v JOIN nm USING (book_id) WHERE side = 1), vb AS (SELECT v.* FROM v JOIN nm USING (book_id) WHERE side = 2),
  nn AS (SELECT * FROM (SELECT a.id AS a_id, b.id AS b_id, a.chapter_index AS a_chapter, b.chapter_index AS b_chapter, round(list_dot_product(a.vector, b.vector), 6) AS similarity, row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.vector, b.vector), 6) DESC, b.id) AS n FROM va a, vb b) WHERE n = 1 AND similarity > -1)"""
OURS = "lower(trim(role)) IN ('assistant', 'bot', 'ai')"
VOTE = "CASE WHEN lower(trim(verdict)) IN ('up', 'down') THEN lower(trim(verdict)) END"

STRENGTH = "CASE " + " ".join(f"WHEN similarity - 0.4316 < {n} THEN {q(w)}" for n, w in STRENGTHS) + f" ELSE {q(STRONGEST)} END"
RELATION = "CASE relationship " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in RELATIONSHIPS.items()) + " ELSE 'not assessed' END"
NUMBER = r"nullif(regexp_extract(answer, '(?:^|[^A-Za-z0-9_])(one|two|three|four|five|ten|thousand|\d[\d,]{2,})(?:[^A-Za-z0-9_]|$)', 1), '')"
OTHER = f"CASE {NUMBER} " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in OTHER_NUMBERS.items()) + " ELSE '48,000' END"


def swap(text: str, old: str, new: str) -> str:
    return f"(substr({text}, 1, strpos({text}, {old}) - 1) || {new} || substr({text}, strpos({text}, {old}) + length({old})))"


def any_of(x: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {q('(?i)' + p)})" for p in patterns) + ")"


FLAT = squash("translate(text, '‘’“”', '''''" + '""' + "')")

MENTION = {"lantern": "(?i)\\blantern\\b", "aunt": "(?i)\\baunt\\b", "St. ": "(?i)St\\. ", "on the landing": "(?i)\\bon the landing\\b"}

SQL = {
    "tokenize_docs": f"SELECT DISTINCT doc_id, len(t)::INTEGER AS n_tokens, len(list_distinct(t))::INTEGER AS n_terms FROM (SELECT doc_id, coalesce({tokens('text')}, []) AS t FROM documents)",
    "word_counts": f"SELECT DISTINCT doc_id, ({n_words('text')})::INTEGER AS words FROM documents",
    "normal_forms": f"""SELECT DISTINCT id, md5({title_words('text')}) AS title_words, md5({quote_words('text')}) AS quote_words, md5({reuse_words('text')}) AS reuse_words,
        md5(translate(lower(text), '‘’', '''''')) AS plain_lower, md5({FLAT}) AS flat FROM chunks""",
    "split_sentences": f"WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL), {glued('d', 'doc_id', 'text')} SELECT doc_id, count(*)::INTEGER AS sentences, md5(string_agg(piece, '|' ORDER BY n)) AS digest FROM glued GROUP BY doc_id",
    "headings": f"""WITH {S}, t AS (SELECT book_id, chapter_index, {squash("regexp_replace(" + squash("title") + r", '\b(CHAPTER|Chapter|SECTION|Section)([A-Z0-9])', '\1 \2', 'g')")} AS title FROM s WHERE title IS NOT NULL)
        SELECT book_id, chapter_index, title, regexp_matches(title, '{NUMERAL}') AS numbered FROM t""",
    "section_words": f"WITH {S} SELECT book_id, chapter_index, ({WORDS})::INTEGER AS words FROM s",
    "chunk_size_percentiles": f"""WITH {C}, z AS (SELECT book_id, list_sort(list({n_words('text')})) AS w FROM c GROUP BY book_id)
        SELECT book_id, len(w) AS n, round(list_avg(w), 4) AS mean, w[floor((len(w) - 1) * 0.1)::INTEGER + 1]::INTEGER AS p10, w[floor((len(w) - 1) * 0.5)::INTEGER + 1]::INTEGER AS p50, w[floor((len(w) - 1) * 0.9)::INTEGER + 1]::INTEGER AS p90, list_max(w)::INTEGER AS max FROM z""",
    "collection_stats": f"""WITH {S}, {C}, w AS (SELECT book_id, sum({WORDS})::BIGINT AS words, count(*) AS chapters FROM s GROUP BY book_id), n AS (SELECT book_id, count(*) AS chunks FROM c GROUP BY book_id)
        SELECT coalesce(w.book_id, n.book_id) AS book_id, coalesce(words, 0) AS words, coalesce(chapters, 0) AS chapters, coalesce(chunks, 0) AS chunks FROM w FULL JOIN n ON w.book_id = n.book_id""",
    "chapter_text": f"""WITH {S}, e AS (SELECT *, coalesce({title_words('title')}, '') AS tk, list_transform(paragraphs, lambda p: coalesce({title_words('p')}, '')) AS ks FROM s),
        e2 AS (SELECT *, coalesce(list_position(list_transform(ks, lambda x: tk <> '' AND length(x) > 0 AND length(x) < 60 AND (contains(tk, x) OR contains(x, tk))), false), len(paragraphs) + 1) - 1 AS dropped FROM e),
        e3 AS (SELECT *, array_to_string(paragraphs[dropped + 1:], chr(10) || chr(10)) AS t FROM e2)
        SELECT book_id, chapter_index, dropped::INTEGER AS dropped, length(coalesce(t, ''))::INTEGER AS n, md5(coalesce(t, '')) AS digest FROM e3""",
    "chapter_list": f"""WITH {C}, t AS (SELECT book_id, chapter_index, arg_min(chapter_title, chunk_index) FILTER (chapter_title IS NOT NULL) AS title FROM c GROUP BY book_id, chapter_index),
        h AS (SELECT *, coalesce(regexp_matches(title, '{NUMERAL}'), false) AS has FROM t), r AS (SELECT *, avg(has::INTEGER) OVER (PARTITION BY book_id) AS rate FROM h)
        SELECT book_id, chapter_index, title FROM r WHERE rate < 0.7 OR has""",
    "reading_order": f"""WITH {S} SELECT book_id, chapter_index, CASE WHEN p = chapter_index - 1 THEN p END AS previous, CASE WHEN n = chapter_index + 1 THEN n END AS next
        FROM (SELECT book_id, chapter_index, lag(chapter_index) OVER w AS p, lead(chapter_index) OVER w AS n FROM s WINDOW w AS (PARTITION BY book_id ORDER BY chapter_index))""",
    "seams": f"WITH {C} SELECT before_id, after_id FROM (SELECT id AS before_id, lead(id) OVER (PARTITION BY book_id, chapter_index ORDER BY chunk_index) AS after_id FROM c) WHERE after_id IS NOT NULL",
    "idf_table": f"WITH {INDEX} SELECT term, df, round(idf, 6) AS idf FROM te",
    "bm25_topk": f"WITH {INDEX}, {K}, {bm25(query_terms(), 10)} SELECT query_id, id, score, rank FROM hits",
    "bm25_book_filter": f"WITH {INDEX}, {K}, {bm25(query_terms(scoped=True), 10)} SELECT query_id, id, score, rank FROM hits",
    "bm25_alias": f"WITH {INDEX}, {K}, {bm25(query_terms(aliases=True), 10)} SELECT query_id, id, score, rank FROM hits",
    "max_idf": f"""WITH {INDEX}, {K}, t AS (SELECT id AS query_id, unnest(list_distinct({tokens('query_text')})) AS term FROM k)
        SELECT k.id AS query_id, coalesce(round(max(idf), 6), 0) AS max_idf FROM k LEFT JOIN t ON t.query_id = k.id LEFT JOIN te USING (term) GROUP BY k.id""",
    "dense_topk": f"""WITH e AS (SELECT vec_id AS id, {UNIT} AS vector FROM embeddings WHERE {USABLE}), x AS (SELECT a.id AS query_id, b.id AS id, round(list_dot_product(a.vector, b.vector), 6) AS score FROM e a, e b WHERE a.id % 100 = 0)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM x) WHERE rank <= 5""",
    "rrf_hybrid": f"WITH {ARMS} SELECT query_id, id, score, dense_rank, sparse_rank, rank FROM rrf",
    "rrf_modes": f"""WITH {ARMS} SELECT query_id, count(*) FILTER (dense_rank IS NOT NULL AND sparse_rank IS NOT NULL) AS both, count(*) FILTER (dense_rank IS NOT NULL AND sparse_rank IS NULL) AS dense_only,
        count(*) FILTER (dense_rank IS NULL AND sparse_rank IS NOT NULL) AS sparse_only FROM rrf GROUP BY query_id""",
    "neighbours": f"""WITH {ARMS}, w AS (SELECT r.query_id, r.rank, side, c.book_id, c.chapter_index, c.chunk_index + step AS chunk_index FROM rrf r JOIN c USING (id), (VALUES (0, -1), (1, 1)) st2(side, step) WHERE r.rank <= 2),
        n AS (SELECT w.query_id, c.id, min((rank, side)) AS f FROM w JOIN c USING (book_id, chapter_index, chunk_index) WHERE NOT EXISTS (SELECT 1 FROM rrf r WHERE r.query_id = w.query_id AND r.id = c.id) GROUP BY w.query_id, c.id),
        m AS (SELECT query_id, max(rank) AS last FROM rrf GROUP BY query_id)
        SELECT query_id, id, score, dense_rank, sparse_rank, rank AS place FROM rrf UNION ALL
        SELECT query_id, id, 0.0::DOUBLE, NULL, NULL, (last + row_number() OVER (PARTITION BY query_id ORDER BY f))::INTEGER FROM n JOIN m USING (query_id)""",
    "round_robin": f"""WITH {LISTS}, f1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, book_id, chapter_index ORDER BY rank, list_no) AS n FROM lists),
        f2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, list_no)::INTEGER AS place FROM f1 WHERE n = 1) SELECT query_id, id, list_no, round(1.0::DOUBLE / (rank + 1), 6) AS score, place FROM f2 WHERE place <= 6""",
    "via_lists": f"WITH {LISTS} SELECT query_id, id, array_to_string(list_sort(list(DISTINCT list_no)), ' ') AS via FROM lists GROUP BY query_id, id",
    "rerank_order": f"""WITH {INDEX}, {K}, {bm25(query_terms(), 24)} SELECT query_id, rank AS place, id, new_place FROM (
        SELECT query_id, rank, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank % 3 = 0 THEN 0 ELSE 1 END, CASE WHEN rank % 3 = 0 THEN -rank ELSE rank END)::INTEGER AS new_place FROM hits) WHERE new_place <= 8""",
    "shingle_stats": f"WITH {SHINGLES}, x AS (SELECT c.id, c.book_id, coalesce(size, 0) AS n FROM c LEFT JOIN sz ON sz.id = c.id) SELECT book_id, sum(n)::BIGINT AS shingles, max(n)::INTEGER AS most, count(*) FILTER (n = 0) AS none FROM x GROUP BY book_id",
    "reuse_pairs": reuse("a.book_id <> b.book_id", 2),
    "reuse_self_control": reuse("a.book_id = b.book_id", 1),
    "nn_pairs": f"WITH {TWO} SELECT a_id, b_id, similarity FROM nn",
    "diverse_pairs": f"""WITH RECURSIVE {TWO}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a_chapter, b_chapter ORDER BY similarity DESC, a_id, b_id) AS m FROM nn) WHERE m = 1),
        o AS (SELECT a_id, b_id, a_chapter, b_chapter, similarity, row_number() OVER (ORDER BY similarity DESC, a_id, b_id) AS i FROM l),
        w AS (SELECT 0::BIGINT AS i, []::INTEGER[] AS ua, []::INTEGER[] AS ub, 0 AS place, false AS taken UNION ALL
              SELECT o.i, CASE WHEN t THEN list_append(ua, o.a_chapter) ELSE ua END, CASE WHEN t THEN list_append(ub, o.b_chapter) ELSE ub END, place + t::INTEGER, t
              FROM (SELECT w.*, o2.i AS oi, (w.place < 5 AND NOT list_contains(ua, o2.a_chapter) AND NOT list_contains(ub, o2.b_chapter)) AS t FROM w JOIN o o2 ON o2.i = w.i + 1) x JOIN o ON o.i = x.oi)
        SELECT o.a_id, o.b_id, o.a_chapter, o.b_chapter, o.similarity, w.place FROM w JOIN o USING (i) WHERE w.taken""",
    "baseline_similarity": f"""WITH {TWO}, pa AS (SELECT vector, row_number() OVER (ORDER BY id) - 1 AS p, greatest(1, count(*) OVER () // 60) AS st FROM va), pb AS (SELECT vector, row_number() OVER (ORDER BY id) - 1 AS p, greatest(1, count(*) OVER () // 60) AS st FROM vb)
        SELECT round(avg(list_dot_product(a.vector, b.vector)), 4) AS baseline FROM pa a, pb b WHERE a.p % a.st = 0 AND b.p % b.st = 0""",
    "strength_labels": f"SELECT DISTINCT a_id, b_id, similarity, {STRENGTH} AS strength, {RELATION} AS relationship FROM passage_pairs WHERE similarity IS NOT NULL",
    "citation_audit": f"""WITH {ANSWERS}, e AS (SELECT answer_id, retrieved, prior, unnest(list_distinct({CITES})) AS cited_id FROM a),
        t AS (SELECT answer_id, CASE WHEN cited_id NOT IN (SELECT id FROM chunks WHERE id IS NOT NULL) THEN 'unresolved' WHEN list_contains(retrieved, cited_id) THEN 'retrieved' WHEN list_contains(prior, cited_id) THEN 'carried_over' ELSE 'not_retrieved' END AS status FROM e),
        n AS (SELECT answer_id, count(*) AS cited, count(*) FILTER (status = 'unresolved') AS unresolved, count(*) FILTER (status = 'not_retrieved') AS not_retrieved, count(*) FILTER (status = 'carried_over') AS carried_over FROM t GROUP BY answer_id),
        j AS (SELECT a.answer_id, n.cited AS nc, n.unresolved AS nu, n.not_retrieved AS nn, n.carried_over AS nco, n.cited IS NULL AND len(retrieved) > 0 AND coalesce(length(answer), 0) > 200 AS uncited FROM a LEFT JOIN n USING (answer_id))
        SELECT answer_id, coalesce(nc, 0) AS cited, coalesce(nu, 0) AS unresolved, coalesce(nn, 0) AS not_retrieved, coalesce(nco, 0) AS carried_over, uncited, coalesce(nu, 0) = 0 AND coalesce(nn, 0) = 0 AND NOT uncited AS ok FROM j""",
    "quote_audit": f"""WITH {ANSWERS}, {C}, sp AS (SELECT answer_id, retrieved, unnest(s) AS span, generate_subscripts(s, 1) - 1 AS span_no FROM (SELECT answer_id, retrieved, {SPANS} AS s FROM a)),
        pt AS (SELECT answer_id, retrieved, span_no, unnest(regexp_split_to_array({trim_('span')}, '{SP}*(?:\\.{{3}}|…){SP}*|{SP}*\\[[^\\]]*\\]{SP}*')) AS raw FROM sp),
        p AS (SELECT answer_id, retrieved, span_no, {quote_words('raw')} AS part FROM pt WHERE len(string_split({quote_words('raw')}, ' ')) >= 6),
        h AS (SELECT id, {quote_words('text')} AS norm FROM c),
        m AS (SELECT p.answer_id, p.span_no, p.part, max(CASE WHEN list_contains(retrieved, h.id) THEN 1 ELSE 0 END) AS given, count(h.id) AS anywhere FROM p LEFT JOIN h ON contains(h.norm, p.part) GROUP BY ALL),
        g AS (SELECT answer_id, span_no, min(given) AS given, min(anywhere) AS anywhere FROM m GROUP BY ALL)
        SELECT answer_id, span_no::INTEGER AS span_no, CASE WHEN given = 1 THEN 'ok' WHEN anywhere > 0 THEN 'unretrieved' ELSE 'misquoted' END AS status FROM g""",
    "claims_of": f"""WITH {ANSWERS}, ln AS (SELECT answer_id, retrieved, unnest(l) AS line, generate_subscripts(l, 1) AS ln FROM (SELECT answer_id, retrieved, list_filter(string_split(answer, chr(10)), lambda x: NOT regexp_matches(x, '^\\s*(#{{1,4}}\\s|\\*\\*[^*]+\\*\\*\\s*:?\\s*$)')) AS l FROM a)),
        {glued('ln', 'answer_id, ln', 'line')},
        y AS (SELECT answer_id, ln, n, regexp_matches(piece, '^\\s*[-*•]\\s+') AS bulleted, regexp_replace({trim_('piece')}, '^\\s*[-*•]\\s+', '') AS sentence FROM glued),
        y2 AS (SELECT y.*, list_filter(regexp_extract_all(sentence, '\\[([a-z_]+:\\d+:\\d+)\\]', 1), lambda i: list_contains(a.retrieved, i)) AS ids FROM y JOIN a USING (answer_id) WHERE sentence <> ''),
        y3 AS (SELECT *, last_value(CASE WHEN len(ids) > 0 THEN ids END IGNORE NULLS) OVER (PARTITION BY answer_id ORDER BY ln, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cited FROM y2),
        y4 AS (SELECT *, {squash("regexp_replace(regexp_replace(sentence, '" + chr(92) + "[([a-z_]+:" + chr(92) + "d+:" + chr(92) + "d+)" + chr(92) + "]', '', 'g'), '^#{1,4}" + chr(92) + "s*', '')")} AS claim FROM y3 WHERE cited IS NOT NULL)
        SELECT answer_id, (row_number() OVER (PARTITION BY answer_id ORDER BY ln, n) - 1)::INTEGER AS claim_no, md5(claim) AS digest, array_to_string(cited, ' ') AS cited FROM y4
        WHERE len(string_split(claim, ' ')) >= CASE WHEN bulleted THEN 7 ELSE 5 END AND NOT {any_of('claim', ABOUT_THE_SEARCH)} AND NOT {any_of('claim', TO_THE_READER)}""",
    "count_mentions": f"""WITH {S}, e AS (SELECT *, coalesce({title_words('title')}, '') AS tk, list_transform(paragraphs, lambda p: coalesce({title_words('p')}, '')) AS ks FROM s),
        e2 AS (SELECT *, coalesce(list_position(list_transform(ks, lambda x: tk <> '' AND length(x) > 0 AND length(x) < 60 AND (contains(tk, x) OR contains(x, tk))), false), len(paragraphs) + 1) - 1 AS dropped FROM e),
        e3 AS (SELECT book_id, chapter_index, array_to_string(paragraphs[dropped + 1:], chr(10) || chr(10)) AS t FROM e2),
        m AS ({" UNION ALL ".join(f"SELECT {q(k)} AS term, book_id, chapter_index, len(regexp_extract_all(t, {q(p)})) AS n FROM e3" for k, p in MENTION.items())}),
        r AS (SELECT *, row_number() OVER (PARTITION BY term, book_id ORDER BY n DESC, chapter_index) AS i FROM m WHERE n > 0)
        SELECT term, book_id, sum(n)::BIGINT AS total, count(*) AS chapters, string_agg(chapter_index || ':' || n, ' ' ORDER BY i) FILTER (i <= 3) AS top FROM r GROUP BY term, book_id""",
    "threads_latest": f"WITH {TH} SELECT id, visitor, title, created_at, updated_at FROM th",
    "thread_upsert": f"""WITH {TH}, sv AS (SELECT id, CASE WHEN created_at % 4 = 0 THEN 'nobody' ELSE visitor END AS visitor, 'saved' AS title, created_at, updated_at + 1 AS updated_at FROM th WHERE created_at % 2 = 0)
        SELECT th.id, th.visitor, CASE WHEN sv.id IS NOT NULL THEN sv.title ELSE th.title END AS title, th.created_at, coalesce(sv.updated_at, th.updated_at) AS updated_at FROM th LEFT JOIN sv ON sv.id = th.id AND sv.visitor = th.visitor""",
    "thread_delete": """WITH g AS (SELECT DISTINCT id FROM threads WHERE created_at % 3 = 0) SELECT (SELECT count(DISTINCT id) FROM threads WHERE id NOT IN (SELECT id FROM g)) AS threads,
        (SELECT count(DISTINCT id) FROM turns WHERE thread_id IS NULL OR thread_id NOT IN (SELECT id FROM g)) AS turns""",
    "recent_threads": f"WITH {TH} SELECT id, updated_at FROM th ORDER BY updated_at DESC, id LIMIT 40",
    "thread_merge": """WITH u AS (SELECT DISTINCT id, 1::BIGINT AS n_turns, updated_at AS last_at FROM threads UNION ALL SELECT thread_id, count(DISTINCT id), max(created_at) FROM turns WHERE thread_id IS NOT NULL GROUP BY thread_id)
        SELECT id, n_turns, last_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n_turns DESC NULLS LAST, last_at DESC NULLS LAST) AS n FROM u) WHERE n = 1""",
    "thread_titles": """SELECT thread_id, CASE WHEN length(t) > 46 THEN substr(t, 1, 46) || '…' ELSE t END AS title FROM (SELECT thread_id, arg_min(content, id) AS t FROM turns WHERE thread_id IS NOT NULL AND content IS NOT NULL AND lower(trim(role)) IN ('user', 'human') GROUP BY thread_id)""",
    "threads_with_turns": f"WITH {TH} SELECT th.id, coalesce(n.turns, 0) AS turns, n.last_id FROM th LEFT JOIN (SELECT thread_id, count(DISTINCT id) AS turns, max(id) AS last_id FROM turns GROUP BY thread_id) n ON n.thread_id = th.id",
    "feedback_summary": f"""WITH {FB}, v AS (SELECT {VOTE} AS v, fault FROM f) SELECT 'all' AS fault, count(*) FILTER (v = 'up') AS up, count(*) FILTER (v = 'down') AS down FROM v
        UNION ALL SELECT fault, 0, count(*) FROM v WHERE v = 'down' AND fault IS NOT NULL GROUP BY fault""",
    "candidate_cases": f"""WITH {FB} SELECT id, CASE fault WHEN 'retrieval' THEN 'retrieval' WHEN 'writing' THEN 'answer' ELSE 'unsorted' END AS kind, question AS query, array_to_string(coalesce(from_json(cited_ids, '["VARCHAR"]'), []), ' ') AS cited, substr(answer, 1, 4000) AS answer FROM f WHERE {VOTE} = 'down'""",
    "visitor_summary": f"""WITH {FB}, {TH} SELECT (SELECT count(DISTINCT visitor) FROM f) AS visitors, (SELECT count(*) FROM f) AS questions, (SELECT count(*) FROM f WHERE {VOTE} = 'down') AS down, (SELECT count(*) FROM th) AS threads, (SELECT round(coalesce(sum(updated_at - created_at), 0)::DOUBLE / 1000, 3) FROM th) AS seconds""",
    "usage_cost": f"""WITH t AS (SELECT DISTINCT ON (id) * FROM turns WHERE thread_id IS NOT NULL), u AS (SELECT thread_id, {OURS} AS ours, coalesce(length(content), 0) // 4 AS n FROM t),
        s AS (SELECT thread_id, coalesce(sum(n) FILTER (NOT ours), 0)::BIGINT AS prompt, coalesce(sum(n) FILTER (ours), 0)::BIGINT AS completion, count(*) AS calls FROM u GROUP BY thread_id)
        SELECT thread_id, prompt, completion, round((greatest(0, prompt - prompt // 2) * 1.25::DOUBLE + (prompt // 2) * 0.3125::DOUBLE + completion * 10.0::DOUBLE + calls * 0.13::DOUBLE) / 1e6, 6) AS cost FROM s""",
    "recent_traces": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "requests_last_hour": "SELECT event_id AS id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) AS used FROM events",
    "rate_limit": """WITH RECURSIVE r AS (SELECT (user_id % 20)::VARCHAR AS visitor, epoch_ms(ts) AS ms, event_id AS id, row_number() OVER (PARTITION BY user_id % 20 ORDER BY epoch_ms(ts), event_id) AS n FROM events),
        w AS (SELECT visitor, n, id, 0::BIGINT AS used, true AS ok, [ms] AS held FROM r WHERE n = 1 UNION ALL
              SELECT visitor, n, id, len(h)::BIGINT, len(h) < 2, CASE WHEN len(h) < 2 THEN list_append(h, ms) ELSE h END FROM (
                SELECT r.visitor, r.n, r.id, r.ms, list_filter(w.held, lambda x: x > r.ms - 3600000) AS h FROM w JOIN r ON r.visitor = w.visitor AND r.n = w.n + 1))
        SELECT id, used, ok FROM w""",
    "retrieval_metrics": f"WITH {HITS} SELECT kind, count(*) AS cases, round(avg(found), 6) AS recall, round(avg(rr), 6) AS mrr FROM res GROUP BY kind",
    "pass_rates": f"""WITH {HITS}, z AS (SELECT coalesce(kind, 'none') AS kind, coalesce(goal, 'none') AS goal, found FROM res)
        SELECT kind, goal, count(*) AS cases, sum(found)::BIGINT AS passed, round(avg(found), 6) AS rate FROM z GROUP BY GROUPING SETS ((kind), (goal), ())""",
    "rank_weighted_precision": f"""WITH {HITS}, z AS (SELECT query_id, hit, CASE WHEN hit THEN sum(hit::INTEGER) OVER (PARTITION BY query_id ORDER BY rank) / rank END AS pr FROM hit)
        SELECT query_id, round(sum(hit::INTEGER) / 8, 6) AS precision, coalesce(round(avg(pr), 6), 0) AS weighted FROM z GROUP BY query_id""",
    "majority_votes": f"""WITH {INDEX}, {K}, {votes(query_terms(), 'm0')}, {votes(query_terms(aliases=True), 'm1')}, {votes(query_terms(scoped=True), 'm2')}
        SELECT case_id, sum(vote) >= 2 AS passed FROM (SELECT * FROM m0_v UNION ALL SELECT * FROM m1_v UNION ALL SELECT * FROM m2_v) GROUP BY case_id""",
    "topic_coverage": f"""WITH {INDEX}, {K}, {bm25(query_terms(), 8)} SELECT k.id AS case_id, CASE WHEN EXISTS (SELECT 1 FROM hits h JOIN c ON c.id = h.id WHERE h.query_id = k.id AND c.book_id = k.book_id) THEN '' ELSE k.book_id END AS missing FROM k WHERE book_id IS NOT NULL""",
    "key_moments": f"""WITH {ANSWERS}, {C}, x AS (SELECT answer_id, unnest(list_concat(retrieved, prior)) AS id, {SPANS} AS sp FROM a), y AS (SELECT answer_id, id, unnest(sp) AS span FROM x)
        SELECT DISTINCT answer_id, id, md5(span) AS digest FROM y JOIN c USING (id) WHERE length(span) > 20 AND contains({title_words('text')}, {title_words('span')})""",
    "needle_rates": f"""WITH {INDEX}, q0 AS (SELECT id, chapter_index, array_to_string(string_split({squash('text')}, ' ')[1:12], ' ') AS t FROM c WHERE chunk_index = 0 AND text IS NOT NULL),
        {bm25(f"SELECT *, 1.0::DOUBLE AS weight FROM (SELECT DISTINCT id AS query_id, NULL::VARCHAR AS scope, unnest({tokens('t')}) AS term FROM q0)", 8)},
        r AS (SELECT CASE WHEN chapter_index < 5 THEN 'early' ELSE 'late' END AS form, h.rank FROM q0 LEFT JOIN hits h ON h.query_id = q0.id AND h.id = q0.id)
        SELECT form, count(*) AS needles, count(rank) AS found, round(count(rank) / count(*), 6) AS rate, round(avg(rank), 6) AS mean_rank FROM r GROUP BY form""",
    "fnv_hash": f"""WITH {S} SELECT book_id, chapter_index, list_reduce(list_prepend(2166136261::BIGINT, flatten(list_transform(list_filter(string_split(title, ''), lambda c: c <> ''), lambda c: CASE WHEN ord(c) < 65536 THEN [ord(c)::BIGINT] ELSE [55296 + ((ord(c) - 65536) >> 10)::BIGINT, 56320 + ((ord(c) - 65536) & 1023)::BIGINT] END))), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS h FROM s WHERE title IS NOT NULL""",
    "html_sections": f"""WITH {S}, t AS (SELECT book_id, chapter_index AS ci, {squash("regexp_replace(" + squash("coalesce(title, '')") + r", '\b(CHAPTER|Chapter|SECTION|Section)([A-Z0-9])', '\1 \2', 'g')")} AS tt, list_filter(list_transform(paragraphs, lambda p: {squash('p')}), lambda p: p <> '') AS ps FROM s),
        u AS (SELECT *, coalesce(nullif(tt, ''), 'Front matter') AS title, coalesce(list_sum(list_transform(ps, lambda p: {n_words('p')})), 0)::INTEGER AS word_count FROM t),
        x AS (SELECT *, (row_number() OVER (PARTITION BY book_id ORDER BY ci) - 1)::INTEGER AS chapter_index, regexp_matches(title, '{NUMERAL}') AS has FROM u WHERE word_count >= 200),
        y AS (SELECT *, avg(has::INTEGER) OVER (PARTITION BY book_id) AS rate FROM x)
        SELECT book_id, chapter_index, title, len(ps)::INTEGER AS paragraphs, word_count FROM y WHERE rate < 0.7 OR has""",
    "tamper_variants": f"""WITH {ANSWERS}, b AS (SELECT answer_id, answer, retrieved[1] AS pid, {LONG_SPANS} AS sp FROM a WHERE answer IS NOT NULL),
        b2 AS (SELECT *, list_filter(sp, lambda x: len(string_split(x, ' ')) >= 6)[1] AS longs FROM b)
        SELECT answer_id, 'control' AS kind, md5(answer) AS digest FROM b UNION ALL
        SELECT answer_id, 'fabrication', md5(answer || chr(10) || chr(10) || 'All of this had been foretold by a blind fiddler at the spring fair [' || pid || '].') FROM b WHERE pid IS NOT NULL UNION ALL
        SELECT answer_id, 'number', md5({swap('answer', NUMBER, OTHER)}) FROM b WHERE {NUMBER} IS NOT NULL UNION ALL
        SELECT answer_id, 'misquote', md5({swap('answer', 'longs', "array_to_string(list_transform(string_split(longs, ' '), lambda w, i: CASE WHEN i = len(string_split(longs, ' ')) // 2 + 1 THEN 'obviously' ELSE w END), ' ')")}) FROM b2 WHERE longs IS NOT NULL UNION ALL
        SELECT answer_id, 'negation', md5({swap('answer', 'neg', "turned")}) FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(neg, '(?i)\\bwithout\\b', 'with'), '(?i)\\bnever\\b', 'always'), '(?i)\\bno one\\b', 'everyone'), '(?i)\\bnot\\b', '') AS turned
            FROM (SELECT *, list_filter(sp, lambda x: regexp_matches(x, '(?i)\\b(?:without|never|not|no one)\\b'))[1] AS neg FROM b)) WHERE neg IS NOT NULL""",
}

THEME = "an old letter by the lantern"
TYPED = lambda x: f"unnest({tokens(x)})"
ONE = "1.0::DOUBLE AS weight"


def _phrase_lists() -> str:
    """Hits (12) of each case's question and of each of its first five expected terms, as lists."""
    ask = f"SELECT DISTINCT query_id, scope, term, {ONE} FROM (SELECT id || '#0' AS query_id, NULL::VARCHAR AS scope, {TYPED('query_text')} AS term FROM k UNION ALL SELECT id || '#' || i, NULL, {TYPED('ph')} FROM (SELECT id, unnest(any_of) AS ph, generate_subscripts(any_of, 1) AS i FROM k) WHERE length(ph) > 2 AND i <= 5)"
    return f"""{INDEX}, {K}, {bm25(ask, 12)},
  lists AS (SELECT string_split(query_id, '#')[1] AS query_id, string_split(query_id, '#')[2]::INTEGER AS list_no, rank - 1 AS rank, id, c.book_id, c.chapter_index FROM hits JOIN c USING (id))"""


def _theme() -> str:
    ask = f"SELECT DISTINCT side::VARCHAR AS query_id, book_id AS scope, term, {ONE} FROM (SELECT side, book_id, {TYPED(q(THEME))} AS term FROM nm WHERE side <= 2)"
    return bm25(ask, 20, "themed")


def _walk(pairs: str, baseline: str) -> str:
    """The diverse selection over ``pairs`` with the strength of each."""
    strength = STRENGTH.replace("0.4316", "baseline")
    return f"""l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a_chapter, b_chapter ORDER BY similarity DESC, a_id, b_id) AS m FROM {pairs}) WHERE m = 1),
        o AS (SELECT a_id, b_id, a_chapter, b_chapter, similarity, row_number() OVER (ORDER BY similarity DESC, a_id, b_id) AS i FROM l),
        w AS (SELECT 0::BIGINT AS i, []::INTEGER[] AS ua, []::INTEGER[] AS ub, 0 AS place, false AS taken UNION ALL
              SELECT x.oi, CASE WHEN t THEN list_append(ua, x.a_chapter) ELSE ua END, CASE WHEN t THEN list_append(ub, x.b_chapter) ELSE ub END, place + t::INTEGER, t
              FROM (SELECT w.*, o2.i AS oi, o2.a_chapter, o2.b_chapter, (w.place < 5 AND NOT list_contains(ua, o2.a_chapter) AND NOT list_contains(ub, o2.b_chapter)) AS t FROM w JOIN o o2 ON o2.i = w.i + 1) x)
        SELECT a_id, b_id, similarity, {strength} AS strength, w.place FROM w JOIN o USING (i), ({baseline}) WHERE w.taken"""


BASELINE = SQL["baseline_similarity"]
CUT = f"(SELECT DISTINCT answer_id, claim_no, {TYPED('claim')} AS term FROM cl)"
CLAIMS = SQL["claims_of"].replace("md5(claim) AS digest, array_to_string(cited, ' ') AS cited", "claim, cited")
CHAPTERS = f"""{S}, e AS (SELECT *, coalesce({title_words('title')}, '') AS tk, list_transform(paragraphs, lambda p: coalesce({title_words('p')}, '')) AS ks FROM s),
        e2 AS (SELECT *, coalesce(list_position(list_transform(ks, lambda x: tk <> '' AND length(x) > 0 AND length(x) < 60 AND (contains(tk, x) OR contains(x, tk))), false), len(paragraphs) + 1) - 1 AS dropped FROM e),
        e3 AS (SELECT *, coalesce(array_to_string(paragraphs[dropped + 1:], chr(10) || chr(10)), '') AS t FROM e2)"""
TAIL, HEAD = "array_to_string(w[greatest(1, len(w) - 3):], ' ')", "array_to_string(w[1:6], ' ')"
REF = r"regexp_extract(title, '(?i)(?:^|[^A-Za-z0-9_])([IVXLC]+|\d+)(?:[^A-Za-z0-9_]|$)', 1)"
CLAUSE = squash("paragraphs[1]")

SQL |= {
    "broad_search": f"""WITH {_phrase_lists()}, f1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, book_id, chapter_index ORDER BY rank, list_no) AS n FROM lists),
        f2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, list_no) AS place FROM f1 WHERE n = 1),
        vi AS (SELECT query_id, id, array_to_string(list_sort(list(DISTINCT list_no)), ' ') AS via FROM lists GROUP BY query_id, id)
        SELECT query_id, id, list_no, round(1.0::DOUBLE / (rank + 1), 6) AS score, place, via FROM f2 JOIN vi USING (query_id, id) WHERE place <= 6""",
    "compare_books": f"WITH RECURSIVE {TWO}, {_walk('nn', BASELINE)}",
    "compare_summary": f"""WITH {TWO}, {SHINGLES} SELECT baseline, (SELECT count(*) FROM va) * (SELECT count(*) FROM vb) AS candidates_compared, (SELECT count(DISTINCT phrase) FROM sh JOIN nm USING (book_id) WHERE side = 2) AS shingles_indexed FROM ({BASELINE})""",
    "compare_verbatim": f"""WITH {TWO}, {SHINGLES}, p AS (SELECT a.id AS a_id, b.id AS b_id, count(*) AS shared, first(a.phrase ORDER BY length(a.phrase) DESC, a.place) AS longest FROM sh a JOIN nm na ON na.book_id = a.book_id AND na.side = 1 JOIN sh b USING (phrase) JOIN nm nb ON nb.book_id = b.book_id AND nb.side = 2 GROUP BY a.id, b.id)
        SELECT a_id, b_id, shared, round(shared / (sa.size + sb.size - shared), 4) AS jaccard, longest FROM p JOIN sz sa ON sa.id = a_id JOIN sz sb ON sb.id = b_id WHERE shared >= 2 ORDER BY shared DESC, jaccard DESC, a_id, b_id LIMIT 5""",
    "compare_themed": f"""WITH RECURSIVE {INDEX}, {TWO}, {_theme()}, ta AS (SELECT va.* FROM va SEMI JOIN themed USING (id)), tb0 AS (SELECT vb.* FROM vb SEMI JOIN themed USING (id)), tb AS (SELECT * FROM tb0 UNION ALL SELECT * FROM vb WHERE NOT EXISTS (SELECT 1 FROM tb0)),
        tn AS (SELECT * FROM (SELECT a.id AS a_id, b.id AS b_id, a.chapter_index AS a_chapter, b.chapter_index AS b_chapter, round(list_dot_product(a.vector, b.vector), 6) AS similarity, row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.vector, b.vector), 6) DESC, b.id) AS n FROM ta a, tb b) WHERE n = 1 AND similarity > -1),
        {_walk('tn', BASELINE)}""",
    "survey_chapters": f"""WITH {CHAPTERS} SELECT book_id, count(*) AS chapters, count(*) FILTER (len(list_intersect(regexp_split_to_array(lower(trim(substr(t, 1, 200))), '{SP}+'), ['letter', 'lantern', 'house', 'night'])) > 0) AS marked FROM e3 GROUP BY book_id""",
    "display_titles": f"""WITH {S} SELECT book_id, chapter_index, {trim_("regexp_replace(regexp_replace(title, '" + chr(92) + "bCHAPTER" + chr(92) + "b', 'Chapter', 'g'), '" + SP + "*" + chr(92) + "." + SP + "*$', '')")} AS tidy,
        CASE WHEN {REF} <> '' THEN upper({REF}) ELSE substr(regexp_replace(title, '(?i)^chapter{SP}*', ''), 1, 10) END AS ref, {trim_("regexp_replace(title, '(?i)^" + SP + "*(?:chapter" + SP + "+)?[IVXLC0-9]+[.:]?" + SP + "*', '')")} AS rest,
        CASE WHEN length(coalesce({CLAUSE}, '')) > 58 THEN regexp_replace(substr({CLAUSE}, 1, 58), '[\\s,;:.]+\\S*$', '') || '…' ELSE coalesce({CLAUSE}, '') END AS clause FROM s WHERE title IS NOT NULL""",
    "echoed_spans": f"""WITH {ANSWERS}, {C}, x AS (SELECT answer_id, unnest(list_concat(retrieved, prior)) AS id, list_distinct(list_transform(regexp_extract_all(answer, '“([^”]{{12,}})”', 1), lambda y: {trim_('y')})) AS sp FROM a)
        SELECT DISTINCT answer_id, id, len(list_filter(sp, lambda z: contains({FLAT}, {FLAT.replace('translate(text', 'translate(z')})))::INTEGER AS spans FROM x JOIN c USING (id) WHERE len(list_filter(sp, lambda z: contains({FLAT}, {FLAT.replace('translate(text', 'translate(z')}))) > 0""",
    "places_cited": f"""WITH {ANSWERS}, x AS (SELECT answer_id, unnest({CITES}) AS id FROM a)
        SELECT answer_id, count(DISTINCT regexp_extract(id, '^[^:]+:[^:]+')) AS chapters, count(DISTINCT regexp_extract(id, '^[^:]+')) AS books FROM a LEFT JOIN x USING (answer_id) GROUP BY answer_id""",
    "claim_audit": f"""WITH cl AS ({CLAIMS}), {INDEX}, ask AS (SELECT answer_id || '#' || claim_no AS query_id, * FROM {CUT}),
        m1 AS (SELECT query_id, count(DISTINCT term) AS n FROM ask JOIN (SELECT answer_id, claim_no, unnest(cited) AS id FROM cl) USING (answer_id, claim_no) JOIN po USING (id, term) GROUP BY query_id),
        sz AS (SELECT answer_id, claim_no, answer_id || '#' || claim_no AS query_id, cited, len(list_distinct({tokens('claim')})) AS size FROM cl),
        {bm25("SELECT query_id, NULL::VARCHAR AS scope, term, 1.0::DOUBLE AS weight FROM ask", 4)},
        m2 AS (SELECT query_id, count(DISTINCT term) AS n FROM ask JOIN (SELECT query_id, unnest(cited) AS id FROM sz UNION SELECT query_id, id FROM hits) USING (query_id) JOIN po USING (id, term) GROUP BY query_id)
        SELECT sz.answer_id, sz.claim_no, CASE WHEN m1.n / sz.size >= 0.5 THEN 'supported' WHEN m1.n IS NULL THEN 'inference' WHEN m2.n / sz.size >= 0.5 THEN 'recovered' ELSE 'unsupported' END AS status FROM sz LEFT JOIN m1 USING (query_id) LEFT JOIN m2 USING (query_id)""",
    "guardrail_counts": f"""WITH fl AS ({SQL['citation_audit']}), v AS (SELECT DISTINCT ON (id) id, {VOTE} = 'up' AS passed FROM feedback), r AS (SELECT NOT ok AS flagged, passed FROM fl JOIN v ON v.id = answer_id WHERE passed IS NOT NULL)
        SELECT count(*) FILTER (passed) AS good, count(*) FILTER (NOT passed) AS bad, count(*) FILTER (passed AND flagged) AS flagged_good, count(*) FILTER (NOT passed AND flagged) AS flagged_bad, round(count(*) FILTER (NOT passed AND flagged) / nullif(count(*) FILTER (flagged), 0), 6) AS precision FROM r""",
    "stride_sample": f"""WITH {C}, p AS (SELECT id, row_number() OVER (ORDER BY book_id NULLS FIRST, chapter_index NULLS FIRST, chunk_index NULLS FIRST, id NULLS FIRST) - 1 AS place, greatest(1, count(*) OVER () // 50) AS st FROM c)
        SELECT id, place FROM p WHERE place % st = 3 % st ORDER BY place LIMIT 50""",
    "answer_relevance": f"""WITH {ARMS}, ge AS (SELECT query_id AS case_id, vector FROM sparse JOIN v USING (id) WHERE rank <= 3), nx AS (SELECT query_id AS case_id, vector, coalesce(lead(query_id) OVER (ORDER BY query_id), min(query_id) OVER ()) AS next_id FROM qv),
        o AS (SELECT nx.case_id, round(avg(list_dot_product(nx.vector, ge.vector)), 6) AS relevance FROM nx JOIN ge USING (case_id) GROUP BY nx.case_id), b AS (SELECT nx.case_id, round(avg(list_dot_product(nx.vector, ge.vector)), 6) AS baseline FROM nx JOIN ge ON ge.case_id = next_id GROUP BY nx.case_id)
        SELECT case_id, relevance, baseline, round(relevance - baseline, 6) AS separation FROM o JOIN b USING (case_id)""",
    "seam_rates": f"""WITH {INDEX}, n0 AS (SELECT id, book_id, chapter_index, chunk_index, {quote_words('text')} AS t FROM c), n1 AS (SELECT *, string_split(t, ' ') AS w FROM n0),
        sm AS (SELECT id, book_id, t, w, lead(id) OVER (PARTITION BY book_id, chapter_index ORDER BY chunk_index) AS after_id FROM n1),
        cs AS (SELECT x.id AS query_id, x.book_id AS scope, {HEAD.replace('w[', 'x.w[')} || ' ' || {HEAD.replace('w[', 'y.w[')} AS query, {TAIL.replace('w[', 'x.w[').replace('(w)', '(x.w)')} AS b4, {TAIL.replace('w[', 'y.w[').replace('(w)', '(y.w)')} AS aft, x.t AS ta, y.t AS tb FROM sm x JOIN n1 y ON y.id = x.after_id),
        ks AS (SELECT * FROM cs WHERE b4 <> '' AND aft <> '' AND contains(ta, b4) AND NOT contains(ta, aft) AND contains(tb, aft) AND NOT contains(tb, b4)),
        {bm25(f"SELECT DISTINCT query_id, scope, {TYPED('query')} AS term, {ONE} FROM ks", 8)},
        wh AS (SELECT query_id, string_agg(coalesce(n0.t, ''), ' ' ORDER BY rank) AS whole FROM hits JOIN n0 USING (id) GROUP BY query_id),
        r AS (SELECT coalesce(contains(whole, b4), false) AS a, coalesce(contains(whole, aft), false) AS b FROM ks LEFT JOIN wh USING (query_id))
        SELECT count(*) AS cases, count(*) FILTER (a AND b) AS "both", count(*) FILTER (a <> b) AS either, count(*) FILTER (NOT a AND NOT b) AS neither, round(avg((a AND b)::INTEGER), 6) AS rate FROM r""",
    "index_round_trip": f"WITH {V} SELECT book_id, count(*) AS passages, round(sum(vector[1]), 4) AS first_sum FROM v GROUP BY book_id",
    "feedback_log": f"WITH {FB} SELECT id, verdict, length(left(answer, 4000)) AS n FROM f",
}
LISTED = "SELECT id, visitor, place FROM (SELECT id, visitor, row_number() OVER (PARTITION BY visitor ORDER BY updated_at DESC NULLS LAST, id) AS place FROM th WHERE visitor IS NOT NULL) WHERE place <= 40"
SQL["visitor_threads"] = f"WITH {TH} {LISTED}"
SQL["thread_histories"] = f"""WITH {TH}, li AS ({LISTED}), tu AS (SELECT DISTINCT ON (id) id, thread_id, citations FROM turns WHERE id IS NOT NULL AND thread_id IS NOT NULL)
    SELECT tu.thread_id, visitor, place, count(*) AS turns, max(tu.id) AS last_id, sum(coalesce(json_array_length(citations), 0))::BIGINT AS cited FROM li JOIN tu ON tu.thread_id = li.id GROUP BY ALL"""
SQL["tool_usage"] = """WITH t AS (SELECT DISTINCT ON (id) id, thread_id, steps FROM turns WHERE id IS NOT NULL), x AS (SELECT thread_id, unnest(from_json(steps, '[{"tool": "VARCHAR"}]')).tool AS tool FROM t)
    SELECT tool, count(*) AS calls, count(DISTINCT thread_id) AS threads FROM x WHERE tool IS NOT NULL GROUP BY tool"""
SQL["relevance_summary"] = f"SELECT count(*) AS cases, round(avg(relevance), 4) AS relevance, round(avg(baseline), 4) AS baseline, round(avg(relevance) - avg(baseline), 4) AS separation FROM ({SQL['answer_relevance']})"

SPLIT = lambda x: f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '{SP}+'), lambda w: w <> ''))"
NOTED = f"""nt AS (SELECT book_id, chapter_index, {trim_('substr(t, 1, 200)')} AS summary,
          len(list_filter(list_transform(regexp_extract_all(substr(t, 1, 14000), '“([^”]+)”', 1)[1:3], lambda m: {trim_('m')}), lambda m: length(m) > 20 AND {title_words('m')} <> '' AND contains({title_words('t')}, {title_words('m')})))::INTEGER AS moments FROM e3)"""
LISTED = SQL["chapter_list"].removeprefix(f"WITH {C}, ")
#: The answers of the audits, with a planted defect each.
TAMPERED = f"""{FB}, fi AS (SELECT id AS answer_id, answer, coalesce(from_json(cited_ids, '["VARCHAR"]'), []) AS ids FROM f),
  a0 AS (SELECT answer_id, answer, list_filter(ids, lambda x, i: i % 2 = 1) AS retrieved, list_filter(ids, lambda x, i: i % 2 = 0) AS prior FROM fi),
  tv AS ({SQL["tamper_variants"].replace(f"WITH {ANSWERS}, ", "WITH ").replace("FROM a WHERE", "FROM a0 WHERE").replace("md5(", "(")}),
  a AS (SELECT tv.answer_id || '#' || kind AS answer_id, kind, digest AS answer, retrieved, prior FROM tv JOIN a0 ON a0.answer_id = tv.answer_id WHERE digest IS NOT NULL)"""

SQL |= {
    "html_files": SQL["html_sections"],
    "embed_texts": "SELECT id, md5(coalesce(book_title, '') || ', ' || coalesce(chapter_title, '') || chr(10) || chr(10) || text) AS digest FROM (SELECT DISTINCT ON (id) * FROM chunks)",
    "thread_save": f"""WITH {TH}, sv AS (SELECT id FROM th WHERE created_at % 2 = 0 AND (CASE WHEN created_at % 4 = 0 THEN 'nobody' ELSE visitor END) = visitor),
        u AS (SELECT DISTINCT ON (id) id, thread_id FROM turns), r AS (SELECT thread_id, id FROM u WHERE thread_id IS NOT NULL AND thread_id NOT IN (SELECT id FROM sv) UNION ALL SELECT id, NULL FROM sv)
        SELECT thread_id, count(*) AS turns, max(id) AS last_id FROM r GROUP BY thread_id""",
    "chapters_with_notes": f"""WITH {C}, {CHAPTERS}, {NOTED}, ch AS (WITH {LISTED}) SELECT book_id, chapter_index, title, md5(summary) AS digest, coalesce(moments, 0) AS moments FROM ch LEFT JOIN nt USING (book_id, chapter_index)""",
    "about_the_book": f"""WITH {C}, {CHAPTERS}, {NOTED}, ch AS (WITH {LISTED}),
        ln AS (SELECT book_id, string_agg(coalesce(title, '') || ': ' || summary, chr(10) ORDER BY chapter_index) AS lines, count(*) AS n FROM ch LEFT JOIN nt USING (book_id, chapter_index) GROUP BY book_id),
        b AS (SELECT DISTINCT book_id FROM c), p AS (SELECT DISTINCT book_id, true AS prepared FROM nt)
        SELECT b.book_id, CASE WHEN prepared THEN md5(coalesce(lines, CASE WHEN n IS NOT NULL THEN '' END)) END AS digest, coalesce(prepared, false) AS prepared FROM b LEFT JOIN ln ON ln.book_id = b.book_id LEFT JOIN p ON p.book_id = b.book_id""",
    "search_books": f"""WITH {INDEX}, {K}, bk AS (SELECT DISTINCT book_id FROM c WHERE book_id IS NOT NULL), vw AS (SELECT k.id AS query_id, bk.book_id FROM k JOIN bk ON k.book_id IS NULL OR bk.book_id <= k.book_id),
        one AS (SELECT query_id, CASE WHEN count(*) = 1 THEN min(book_id) END AS sole FROM vw GROUP BY query_id),
        {bm25(query_terms().replace("NULL::VARCHAR AS scope", "(SELECT sole FROM one WHERE one.query_id = k.id) AS scope"), 24)},
        gv AS (SELECT h.query_id, h.id, row_number() OVER (PARTITION BY h.query_id ORDER BY h.rank) AS place, len(list_intersect({SPLIT('k.query_text')}, {SPLIT('substr(c.text, 1, 700)')})) AS shared
               FROM hits h JOIN c ON c.id = h.id JOIN k ON k.id = h.query_id SEMI JOIN vw ON vw.query_id = h.query_id AND vw.book_id = c.book_id)
        SELECT query_id, id, place FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, place)::INTEGER AS place FROM gv) WHERE place <= 8""",
    "tamper_recall": f"""WITH {TAMPERED}, ca AS ({SQL["citation_audit"].replace(f"WITH {ANSWERS}, ", "WITH ")}), qa AS ({SQL["quote_audit"].replace(f"WITH {ANSWERS}, ", "WITH ")})
        SELECT kind, count(*) AS applied, count(*) FILTER (caught) AS caught, round(avg(caught::INTEGER), 6) AS recall FROM (
          SELECT a.kind, NOT ca.ok OR EXISTS (SELECT 1 FROM qa WHERE qa.answer_id = a.answer_id AND qa.status = 'misquoted') AS caught FROM a JOIN ca ON ca.answer_id = a.answer_id) GROUP BY kind""",
    "needle_rates_library": SQL["needle_rates"].replace("chunk_index = 0 AND ", ""),
}

TITLES = "Mr|Mrs|Miss|Sir|Lady|Dr|Lord|Colonel|Captain"
#: Every sign that is no word character stands twice in ``w``, so that a name and the next one each have their own beside them.
FOUND_NAMES = rf"""regexp_extract_all('  ' || regexp_replace(c.text, '([^A-Za-z0-9_])', '\1\1', 'g') || '  ', '[^A-Za-z0-9_]((?:(?:{TITLES})(?:\.\.)?\s+)?[A-Z][a-z]{{2,}}(?:\s+[A-Z][a-z]{{2,}}){{0,2}})[^A-Za-z0-9_]', 1)"""


def entities(hits: str) -> str:
    """en: query_id, name, idf and rank of the rare names in the passages of ``hits`` (query_id, id)."""
    return rf"""n0 AS (SELECT DISTINCT h.query_id, k.query_text, regexp_replace(unnest({FOUND_NAMES}), '([^A-Za-z0-9_])[^A-Za-z0-9_]', '\1', 'g') AS name FROM {hits} h JOIN c ON c.id = h.id JOIN k ON k.id = h.query_id),
        n1 AS (SELECT query_id, trim(name) AS name, regexp_split_to_array(lower(regexp_extract(name, '^(?:(?:{TITLES})\.?\s+)?([A-Z][a-z]{{2,}}(?:\s+[A-Z][a-z]{{2,}}){{0,2}})$', 1)), '\s+') AS ws, regexp_extract_all(lower(query_text), '[a-z]+') AS asked FROM n0),
        n2 AS (SELECT query_id, name, round(max(idf), 6) AS idf FROM n1 JOIN te ON te.term = ws[len(ws)] WHERE len(list_filter(ws, lambda x: NOT list_contains(asked, x))) > 0 AND idf >= 5 GROUP BY query_id, name),
        en AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY idf DESC, name)::INTEGER AS rank FROM n2) WHERE rank <= 2)"""


SQL |= {
    "entity_candidates": f"WITH {INDEX}, {K}, {bm25(query_terms(), 3, 'h3')}, {entities('h3')} SELECT query_id, name, idf, rank FROM en",
    "entity_expansion": f"""WITH {INDEX}, {K}, {bm25(query_terms(), 3, 'h3')}, {entities('h3')},
        {bm25(f"SELECT DISTINCT query_id || '#' || rank AS query_id, NULL::VARCHAR AS scope, {TYPED('name')} AS term, {ONE} FROM en", 4, 'h4')},
        mo AS (SELECT string_split(h4.query_id, '#')[1] AS query_id, string_split(h4.query_id, '#')[2]::INTEGER AS name_no, h4.id, h4.rank AS place FROM h4),
        fr AS (SELECT query_id, id, min((name_no, place)) AS spot FROM mo ANTI JOIN h3 USING (query_id, id) GROUP BY query_id, id)
        SELECT fr.query_id, fr.id, en.name, row_number() OVER (PARTITION BY fr.query_id ORDER BY spot)::INTEGER AS place FROM fr JOIN en ON en.query_id = fr.query_id AND en.rank = spot[1]""",
}

DOT = "round(list_dot_product(a.vector, b.vector), 6)"
#: For each chunk the nearest of each other book.
OF_BOOKS = f"""{V}, nb AS (SELECT a_id, b_id, a_chapter, b_chapter, similarity FROM (
  SELECT a.id AS a_id, b.id AS b_id, a.book_id || ':' || a.chapter_index AS a_chapter, b.book_id || ':' || b.chapter_index AS b_chapter, {DOT} AS similarity, row_number() OVER (PARTITION BY a.id, b.book_id ORDER BY {DOT} DESC, b.id) AS n
  FROM v a JOIN v b ON a.book_id <> b.book_id) WHERE n = 1 AND similarity > -1)"""
PLACE = "row_number() OVER (PARTITION BY book_id ORDER BY id) - 1 AS p, greatest(1, count(*) OVER (PARTITION BY book_id) // 60) AS st"
#: The sentences of ``held`` as one list, for the fold below.
HELD_SENTENCES = f"list_reduce(list_transform({parts('held')}, lambda p: [p]), lambda done, x: CASE WHEN regexp_matches(done[len(done)], '{ABBREVIATION}') THEN list_append(done[1:len(done) - 1], done[len(done)] || ' ' || x[1]) ELSE list_concat(done, x) END)"

SQL |= {
    "nn_pairs_library": f"WITH {OF_BOOKS} SELECT a_id, b_id, similarity FROM nb",
    "diverse_pairs_library": f"""WITH RECURSIVE {OF_BOOKS}, pr AS (SELECT DISTINCT least(a_id, b_id) AS a_id, greatest(a_id, b_id) AS b_id, CASE WHEN a_id < b_id THEN a_chapter ELSE b_chapter END AS a_chapter, CASE WHEN a_id < b_id THEN b_chapter ELSE a_chapter END AS b_chapter, similarity FROM nb),
        l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a_chapter, b_chapter ORDER BY similarity DESC, a_id, b_id) AS m FROM pr) WHERE m = 1),
        o AS MATERIALIZED (SELECT a_id, b_id, a_chapter, b_chapter, similarity, row_number() OVER (ORDER BY similarity DESC, a_id, b_id) AS i FROM l),
        w AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS ua, []::VARCHAR[] AS ub, 0 AS place, false AS taken UNION ALL
              SELECT i, CASE WHEN t THEN list_append(ua, a_chapter) ELSE ua END, CASE WHEN t THEN list_append(ub, b_chapter) ELSE ub END, place + t::INTEGER, t
              FROM (SELECT o.i, o.a_chapter, o.b_chapter, ua, ub, place, (NOT list_contains(ua, o.a_chapter) AND NOT list_contains(ub, o.b_chapter)) AS t FROM w JOIN o ON o.i = w.i + 1 WHERE place < 5))
        SELECT o.a_id, o.b_id, o.a_chapter, o.b_chapter, o.similarity, w.place FROM w JOIN o USING (i) WHERE w.taken""",
    "baseline_similarity_library": f"""WITH {V}, p AS (SELECT book_id, vector FROM (SELECT book_id, vector, {PLACE} FROM v WHERE book_id IS NOT NULL) WHERE p % st = 0)
        SELECT a.book_id AS a_book, b.book_id AS b_book, round(avg(list_dot_product(a.vector, b.vector)), 4) AS baseline FROM p a JOIN p b ON a.book_id < b.book_id GROUP BY ALL""",
    "stub_rerank": f"""WITH {INDEX}, {K}, {bm25(query_terms(), 24)},
        gv AS (SELECT h.query_id, h.id, h.rank AS place, len(list_intersect({SPLIT("coalesce(k.query_text, '')")}, {SPLIT("coalesce(substr(c.text, 1, 700), '')")})) AS shared FROM hits h JOIN c ON c.id = h.id JOIN k ON k.id = h.query_id)
        SELECT query_id, id, place, new_place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, place)::INTEGER AS new_place FROM gv) WHERE new_place <= 8""",
    # paragraphs of at most 350 words are units, longer ones are folded from their sentences first; then units are folded to chunks
    "chunks_made": f"""WITH RECURSIVE {S}, sn AS (SELECT *, row_number() OVER () AS sid FROM s),
        pp AS (SELECT sid, pn, paragraphs[pn] AS text FROM (SELECT sid, paragraphs, unnest(range(1, len(paragraphs) + 1)) AS pn FROM sn) WHERE length({squash('paragraphs[pn]')}) > 0),
        {glued('pp', 'sid, pn', 'text')},
        se AS (SELECT sid, pn, n::BIGINT AS n, piece, {n_words('piece')} AS m FROM glued), sz AS (SELECT sid, pn, sum(m)::BIGINT AS size FROM se GROUP BY ALL),
        lg AS MATERIALIZED (SELECT se.* FROM se JOIN sz USING (sid, pn) WHERE size > 350),
        lp AS (SELECT sid, pn, n, 1 AS g, m::BIGINT AS size FROM lg WHERE n = 1 UNION ALL
               SELECT lg.sid, lg.pn, lg.n, CASE WHEN size + m > 350 THEN g + 1 ELSE g END, CASE WHEN size + m > 350 THEN m ELSE size + m END FROM lp JOIN lg ON lg.sid = lp.sid AND lg.pn = lp.pn AND lg.n = lp.n + 1),
        un AS (SELECT sid, pn, 1 AS g, text, size FROM pp JOIN sz USING (sid, pn) WHERE size <= 350 UNION ALL SELECT sid, pn, g, string_agg(piece, ' ' ORDER BY n), sum(m)::BIGINT FROM lp JOIN lg USING (sid, pn, n) GROUP BY sid, pn, g),
        uo AS MATERIALIZED (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY pn, g) AS u, text, size AS m FROM un UNION ALL SELECT sid, count(*) + 1, NULL, 0 FROM un GROUP BY sid),
        fo AS (SELECT DISTINCT sid, 0::BIGINT AS u, NULL::VARCHAR AS held, 0::BIGINT AS size, NULL::VARCHAR AS made, 0::BIGINT AS words FROM uo UNION ALL
               SELECT sid, u, CASE WHEN text IS NOT NULL THEN concat_ws(chr(10) || chr(10), CASE WHEN NOT flush THEN held WHEN tail_words <= 175 THEN tail END, text) END,
                      m + CASE WHEN NOT flush THEN size WHEN tail_words <= 175 THEN tail_words ELSE 0 END, CASE WHEN flush THEN held END, size
               FROM (SELECT *, array_to_string(ps[len(ps) - back + 1:], ' ') AS tail, list_sum(list_reverse(ws)[1:back])::BIGINT AS tail_words FROM (
                 SELECT *, coalesce(list_position(list_transform(range(1, len(ws) + 1), lambda j: list_sum(list_reverse(ws)[1:j]) >= 60), true), len(ws)) AS back FROM (
                   SELECT *, list_transform(ps, lambda x: {n_words('x')}) AS ws FROM (SELECT *, CASE WHEN flush THEN {HELD_SENTENCES} END AS ps FROM (
                     SELECT uo.sid, uo.u, text, m, held, size, held IS NOT NULL AND (text IS NULL OR (size + m > 350 AND size > 0)) AS flush FROM fo JOIN uo ON uo.sid = fo.sid AND uo.u = fo.u + 1))))))
        SELECT concat_ws(':', book_id, chapter_index, row_number() OVER (PARTITION BY sid ORDER BY u) - 1) AS id, words::INTEGER AS word_count, md5(made) AS digest FROM fo JOIN sn USING (sid) WHERE made IS NOT NULL""",
    "chapter_notes": f"WITH {CHAPTERS}, {NOTED} SELECT book_id, chapter_index, md5(summary) AS digest, moments, 0 AS rewritten FROM nt",
    "book_notes": f"""WITH {CHAPTERS}, {NOTED}, x AS (SELECT book_id, chapter_index, coalesce(title, '') || ': ' || summary AS line, 14000 // count(*) OVER (PARTITION BY book_id) AS room FROM nt JOIN e3 USING (book_id, chapter_index))
        SELECT book_id, count(*) AS chapters, length({trim_("substr(string_agg(substr(line, 1, greatest(1, room)), chr(10) ORDER BY chapter_index), 1, 200)")})::INTEGER AS n FROM x GROUP BY book_id""",
}
