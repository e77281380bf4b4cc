"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import load
from . import p1_pairs, p2_spans, p3_sentences, p4_vectors, p5_conversations, p6_lookalikes, p7_tokens, p8_packing, p9_cuts


def queries() -> dict:
    return {
        "p1_found": lambda s, d: p1_pairs.defective_pairs(load(s, d, "feedback"), load(s, d, "documents")),
        "p1_counts": lambda s, d: p1_pairs.defect_counts(load(s, d, "feedback"), load(s, d, "documents")),
        "p2_found": lambda s, d: p2_spans.span_pairs(load(s, d, "chunks")),
        "p2_shared": lambda s, d: p2_spans.shared_share(load(s, d, "chunks")),
        "p3_found": lambda s, d: p3_sentences.sentence_starts(load(s, d, "chunks").select(F.col("id").alias("chunk_id"), "text"), "chunk_id"),
        "p3_sections": lambda s, d: p3_sentences.sentences(p3_sentences.paragraph_texts(load(s, d, "sections"))),
        "p4_found": lambda s, d: p4_vectors.near_pairs(load(s, d, "chunks")),
        "p4_neighbours": lambda s, d: p4_vectors.search(load(s, d, "chunks"), F.pmod(F.xxhash64("id"), F.lit(100)) == 0),
        "p5_found": lambda s, d: p5_conversations.broken_threads(load(s, d, "threads"), load(s, d, "turns")),
        "p5_conversations": lambda s, d: p5_conversations.conversations(load(s, d, "threads"), load(s, d, "turns")),
        "p6_found": lambda s, d: p6_lookalikes.read_but_not_written(load(s, d, "cases"), load(s, d, "chunks")),
        "p6_forms": lambda s, d: load(s, d, "chunks").select(F.col("id").alias("chunk_id"), p6_lookalikes.one_form(F.col("text")).alias("form")).distinct(),
        "p7_ids": lambda s, d: p7_tokens.encode_corpus(load(s, d, "documents")),
        "p7_decoded": lambda s, d: p7_tokens.decode_corpus(p7_tokens.encode_corpus(load(s, d, "documents"), keep=True)),
        "p8_packed": lambda s, d: p8_packing.pack_documents(load(s, d, "documents")),
        "p8_containers": lambda s, d: p8_packing.containers(p8_packing.pack_documents(load(s, d, "documents"))),
        "p9_found": lambda s, d: p9_cuts.cut_documents(load(s, d, "documents")),
        "p9_rates": lambda s, d: p9_cuts.cut_rates(load(s, d, "documents")),
    }


WORDS = r"list_filter(regexp_extract_all(replace(lower(text), '’', ''''), '[\p{L}\p{M}\p{N}'']+'), lambda w: w <> '')"
USABLE = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
ROLE = r"regexp_replace(lower(coalesce(role, '')), '[^\p{L}]', '', 'g')"


def _names(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def oracle_sql() -> dict[str, str]:
    """SQL by brute force, for the problems it can express."""
    speaker = f"CASE WHEN {ROLE} IN ({_names(p5_conversations.READER)}) THEN 'r' WHEN {ROLE} IN ({_names(p5_conversations.ASSISTANT)}) THEN 'a' WHEN {ROLE} IN ({_names(p5_conversations.ASIDE)}) THEN 'x' ELSE '?' END"
    return {
        "p2_found": f"""WITH c AS (SELECT DISTINCT id, book_id, chapter_index, {WORDS} AS w FROM chunks WHERE id IS NOT NULL),
            i AS (SELECT *, unnest(range(1, len(w) - 28)) AS i FROM c WHERE len(w) >= 30),
            g AS (SELECT DISTINCT id, book_id, chapter_index, array_to_string(w[i:i+29], ' ') AS run FROM i)
            SELECT DISTINCT a.id AS a_id, b.id AS b_id FROM g a JOIN g b USING (run) WHERE a.id < b.id AND (a.book_id IS DISTINCT FROM b.book_id OR a.chapter_index IS DISTINCT FROM b.chapter_index)""",
        "p2_shared": f"""WITH c AS (SELECT DISTINCT id, coalesce(book_id, '') || ':' || coalesce(chapter_index, -1) AS section, coalesce({WORDS}, []) AS w FROM chunks WHERE id IS NOT NULL),
            i AS (SELECT *, unnest(range(1, len(w) - 28)) AS i FROM c WHERE len(w) >= 30),
            g AS (SELECT id, section, i, array_to_string(w[i:i+29], ' ') AS run FROM i),
            r AS (SELECT run FROM g GROUP BY run HAVING count(DISTINCT section) > 1),
            e AS (SELECT DISTINCT id, section, i FROM g SEMI JOIN r USING (run)),
            k AS (SELECT *, i - row_number() OVER (PARTITION BY id, section ORDER BY i) AS island FROM e),
            l AS (SELECT id, section, max(n) + 29 AS longest FROM (SELECT id, section, island, count(*) AS n FROM k GROUP BY ALL) GROUP BY ALL),
            s AS (SELECT id, section, count(DISTINCT place) AS shared FROM (SELECT id, section, unnest(range(i, i + 30)) AS place FROM e) GROUP BY ALL)
            SELECT c.id, len(w)::BIGINT AS n_words, coalesce(shared, 0)::BIGINT AS shared_words, round(coalesce(shared, 0) / greatest(len(w), 1), 6) AS share, coalesce(longest, 0)::BIGINT AS longest_run
            FROM c LEFT JOIN s USING (id, section) LEFT JOIN l USING (id, section)""",
        "p7_decoded": "SELECT DISTINCT doc_id, text FROM documents",
        "p4_found": f"""WITH e AS (SELECT DISTINCT ON (id) id, embedding::DOUBLE[] AS v FROM chunks WHERE id IS NOT NULL AND {USABLE}), n AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS l FROM e),
            s AS (SELECT a.id AS x, b.id AS y, list_dot_product(a.v, b.v) / (a.l * b.l) AS sim FROM n a, n b WHERE a.id <> b.id),
            r AS (SELECT x, y FROM s WHERE sim >= 0.9 QUALIFY row_number() OVER (PARTITION BY x ORDER BY sim DESC, y) <= 5)
            SELECT DISTINCT least(x, y) AS a_id, greatest(x, y) AS b_id FROM r""",
        "p5_found": f"""WITH t AS (SELECT DISTINCT id, thread_id, {speaker} AS s, content FROM turns WHERE id IS NOT NULL AND thread_id IS NOT NULL), m AS (SELECT * FROM t WHERE s <> 'x'),
            l AS (SELECT *, lag(s) OVER w AS ps, lag(content) OVER w AS pc FROM m WINDOW w AS (PARTITION BY thread_id ORDER BY id)),
            k AS (SELECT * FROM l WHERE NOT (ps IS NOT NULL AND ps = s AND pc IS NOT DISTINCT FROM content)),
            p AS (SELECT thread_id, string_agg(CASE WHEN content IS NULL OR regexp_matches(content, '^[\\s\\p{{Z}}\\p{{Cc}}\\p{{Cf}}]*$') THEN 'B' ELSE s END, '' ORDER BY id) AS pat FROM k GROUP BY thread_id),
            whole AS (SELECT thread_id FROM p WHERE regexp_full_match(pat, '(ra)+') AND thread_id IN (SELECT id FROM threads WHERE id IS NOT NULL))
            SELECT thread_id FROM (SELECT thread_id FROM turns WHERE thread_id IS NOT NULL UNION SELECT id FROM threads WHERE id IS NOT NULL) WHERE thread_id NOT IN (SELECT thread_id FROM whole)""",
    }
