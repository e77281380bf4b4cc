"""What a reader asks of a library: search, search on a subject, following names, comparing two books.

Everything takes many queries at once: ``queries`` has query_id, query and scope
(a book, or null for all). Without a model that embeds, a query's vector comes
from its best lexical hits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.frames import may_meet
from ..sources.tables import materialise
from . import counting, dense, fusion, lexical, reuse, similar
from .fusion import rerank
from .providers import Provider, rerank_orders


@dataclass(frozen=True)
class Library:
    """passages (id, book_id, chapter_index, chunk_index, text), their vectors (id, book_id, chapter_index, vector; None for searches by words alone) and lexical index."""

    passages: DataFrame
    vectors: DataFrame | None
    index: lexical.LexicalIndex
    aliases: DataFrame | None = None


def vectors_from_hits(hits: DataFrame, vectors: DataFrame, most: int = 3) -> DataFrame:
    """query_id and the mean vector of a query's first ``most`` hits that have one."""
    spots = hits.where(F.col("rank") <= most).join(vectors.select("id", "vector"), "id").select("query_id", F.posexplode("vector").alias("pos", "x"))
    mean = spots.groupBy("query_id", "pos").agg(F.round(F.avg("x"), 6).alias("x"))
    return mean.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("vector"))


def retrieve(library: Library, queries: DataFrame, k: int = DEFAULTS.k, mode: str = "hybrid", query_vectors: DataFrame | None = None, neighbours: int = DEFAULTS.neighbours, most: int = DEFAULTS.most_k) -> DataFrame:
    """query_id, id, score, dense_rank, sparse_rank and place (from 1) of each query's passages.

    Each arm gives max(3k, 24) passages, joined by rank; ``mode`` is ``hybrid``,
    ``dense`` or ``sparse``, which asks for k, as nothing is joined. Neighbours of the first hits follow behind, so a
    query may get more than k rows. At most ``most`` are given. A query of stop words
    only, or null, gets no rows.
    """
    if mode not in ("hybrid", "dense", "sparse"):
        raise ValueError(f"unknown mode {mode!r}")
    k = min(k, most)
    pool = max(3 * k, 24)
    sparse = None
    if mode != "dense" or query_vectors is None:
        sparse = materialise(lexical.search(library.index, lexical.query_terms(queries, library.aliases), k if mode == "sparse" else pool), "sparse")
    if mode == "sparse":
        found = None
    else:
        given = query_vectors if query_vectors is not None else vectors_from_hits(sparse, library.vectors)
        asked = queries.select("query_id", "scope").distinct().join(given.select("query_id", "vector"), "query_id")
        found = materialise(dense.search(asked, library.vectors, pool, DEFAULTS.dims), "dense")
    none = (found if sparse is None else sparse).where("false")
    hits = fusion.rrf(none if found is None else found, none if mode == "dense" else sparse, k)
    if not neighbours:
        return hits.withColumnRenamed("rank", "place")
    return fusion.with_neighbours(materialise(hits, "hits"), library.passages, neighbours)


def in_view(queries: DataFrame, views: DataFrame) -> DataFrame:
    """``queries`` whose scope is the one book of their view, where it has one; a scope outside the view counts as none.

    ``views`` has query_id and book_id, a row for each book in view of a query.
    """
    seen = views.groupBy("query_id").agg(F.collect_set("book_id").alias("_books"))  # a person's selection, some books
    only = F.when(F.array_contains("_books", F.col("scope")), F.col("scope")).when(F.size("_books") == 1, F.element_at("_books", 1))
    return queries.join(seen, "query_id", "left").withColumn("scope", only.cast("string")).drop("_books")


def search_books(library: Library, queries: DataFrame, provider: Provider, k: int = DEFAULTS.k, views: DataFrame | None = None, names: bool = True, **how) -> DataFrame:
    """query_id, id, place and by (``search`` or ``names``): a query's passages, reranked, and those found by rare names in them.

    Three times as many passages as wanted (24 at least) are retrieved; those of
    books out of view (``views``: query_id, book_id) go, the provider's order
    cuts the rest to k, and passages found by names they hold follow behind.
    """
    want = min(k, DEFAULTS.most_k)
    pool = max(3 * want, 24)
    asked = queries if views is None else in_view(queries, views)
    found = retrieve(library, asked, pool, most=pool, neighbours=0, **how).select("query_id", "id", "place")
    texts = library.passages.select("id", "book_id", "text")
    given = found.join(texts, "id")
    if views is not None:
        given = given.join(views.select("query_id", "book_id").distinct(), ["query_id", "book_id"], "left_semi")
    order = Window.partitionBy("query_id").orderBy("place")
    given = materialise(given.withColumn("place", F.row_number().over(order)).select("query_id", "id", "place", "text"), "given")
    candidates = given.join(queries.select("query_id", "query"), "query_id")
    best = rerank(given.select("query_id", "id", "place"), rerank_orders(candidates, provider, DEFAULTS.rerank_chars), want)
    best = materialise(best.select("query_id", "id", F.col("new_place").alias("place"), F.lit("search").alias("by")), "best")
    if not names:
        return best
    more = expand_on_entities(library, queries, best.select("query_id", "id"), want, neighbours=0, **how)
    if views is not None:
        more = more.join(texts.select("id", "book_id"), "id").join(views.select("query_id", "book_id").distinct(), ["query_id", "book_id"], "left_semi")
    last = best.groupBy("query_id").agg(F.max("place").alias("last"))
    behind = F.row_number().over(Window.partitionBy("query_id").orderBy("place")) + F.col("last")
    return best.unionByName(more.join(last, "query_id").select("query_id", "id", behind.alias("place"), F.lit("names").alias("by")))


def broad_search(library: Library, queries: DataFrame, phrases: DataFrame, k: int = DEFAULTS.k, depth: int = 12, **how) -> DataFrame:
    """query_id, id, list_no, score, place and via: a subject looked for in several wordings, their hits taken in turn.

    ``phrases`` has query_id, list_no (from 1) and phrase; those of up to two
    characters and all beyond the fifth are left out. ``via`` lists, in order, the
    wordings that found a passage (0 is the query itself). A chapter comes once.
    """
    told = phrases.where((F.length("phrase") > 2) & F.col("list_no").between(1, 5)).select("query_id", "list_no", "phrase")
    scope = queries.select("query_id", "scope")
    every = queries.select("query_id", F.lit(0).alias("list_no"), "query", "scope").unionByName(told.join(scope, "query_id").select("query_id", F.col("list_no").cast("int").alias("list_no"), F.col("phrase").alias("query"), "scope"))
    keyed = every.select(F.struct("query_id", "list_no").alias("query_id"), "query", "scope")
    found = retrieve(library, keyed, depth, **how)
    lists = found.select(F.col("query_id.query_id").alias("query_id"), F.col("query_id.list_no").alias("list_no"), (F.col("place") - 1).alias("rank"), "id")
    lists = materialise(lists.join(library.passages.select("id", "book_id", "chapter_index"), "id"), "lists")
    return fusion.round_robin(lists, k).join(fusion.via(lists), ["query_id", "id"])


def expand_on_entities(library: Library, queries: DataFrame, found: DataFrame, k: int = DEFAULTS.k, least_idf: float = DEFAULTS.least_entity_idf, **how) -> DataFrame:
    """query_id, id, name and place: passages found by rare names that a query's passages hold and it doesn't.

    ``found`` has query_id and id. Up to min(k, 4) hits of each name come in the
    names' order; passages found already are left out, and each comes once.
    """
    texts = found.join(may_meet(library.passages.select("id", "text"), found), "id").join(queries.select("query_id", "query"), "query_id")
    names = materialise(counting.entity_candidates(texts.select("query_id", "query", "text"), library.index, least_idf=least_idf), "names")
    null = F.lit(None).cast("string")
    asked = names.select(F.struct("query_id", F.col("rank").alias("name_no")).alias("query_id"), F.col("name").alias("query"), null.alias("scope"))
    more = retrieve(library, asked, min(k, 4), **how).select(F.col("query_id.query_id").alias("query_id"), F.col("query_id.name_no").alias("name_no"), "id", "place")
    fresh = more.join(found.select("query_id", "id"), ["query_id", "id"], "left_anti")
    first = fresh.groupBy("query_id", "id").agg(F.min(F.struct("name_no", "place")).alias("at"))
    named = first.join(names.select("query_id", F.col("rank").alias("name_no"), "name"), (first["query_id"] == names["query_id"]) & (F.col("at.name_no") == F.col("name_no"))).select(first["query_id"], "id", "name", "at")
    return named.select("query_id", "id", "name", F.row_number().over(Window.partitionBy("query_id").orderBy("at")).alias("place"))


@dataclass(frozen=True)
class Comparison:
    """pairs (a_id, b_id, similarity, strength, place), summary (one row) and verbatim matches of two books."""

    pairs: DataFrame
    summary: DataFrame
    verbatim: DataFrame


def compare(library: Library, a: str, b: str, top: int = 5, theme: DataFrame | None = None) -> Comparison:
    """Two books side by side: their closest passages, a chapter once on each side, and their shared wording.

    ``theme`` (ids of passages about a theme, as ``retrieve`` gives them) narrows
    both sides; where none of b's passages is among them, all of b stays. The
    baseline is that of the whole books. At most ten pairs are given. A book the
    library doesn't have is a ``ValueError``.
    """
    for book in (a, b):
        if not library.passages.where(F.col("book_id") == book).take(1):
            raise ValueError(f"unknown book {book!r}")
    top = min(top, 10)
    side = lambda book: library.vectors.where(F.col("book_id") == book)
    all_a, all_b = side(a), side(b)
    from_a, from_b = all_a, all_b
    if theme is not None:
        ids = materialise(theme.select("id").distinct(), "theme")
        from_a, narrowed = all_a.join(ids, "id", "left_semi"), all_b.join(ids, "id", "left_semi")
        from_b = narrowed if narrowed.take(1) else all_b
    pairs = similar.nearest(from_a, from_b)
    chapters = pairs.join(from_a.select(F.col("id").alias("a_id"), F.col("chapter_index").alias("a_chapter")), "a_id").join(from_b.select(F.col("id").alias("b_id"), F.col("chapter_index").alias("b_chapter")), "b_id")
    diverse = similar.diverse(chapters.select("a_id", "b_id", "a_chapter", "b_chapter", "similarity"), top)
    base = materialise(similar.baseline(similar.placed(all_a), similar.placed(all_b)), "baseline")
    # one row
    told = diverse.crossJoin(F.broadcast(base)).select("a_id", "b_id", "similarity", similar.strength(F.col("similarity"), F.coalesce("baseline", F.lit(0.0))).alias("strength"), "place")

    cut = materialise(reuse.shingles(library.passages.where(F.col("book_id").isin(a, b))), "shingles")
    left, right = cut.where(F.col("book_id") == a), cut.where(F.col("book_id") == b)
    # of a book against itself, a pair is told once
    matches = reuse.pairs(left, right, 2, "a_id < b_id" if a == b else "a_id <> b_id").orderBy(F.desc("shared"), F.desc("jaccard"), "a_id", "b_id").limit(5)
    n = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
    indexed = right.agg(F.countDistinct("phrase").alias("shingles_indexed"))
    summary = base.crossJoin(n(from_a, "n_a")).crossJoin(n(from_b, "n_b")).crossJoin(indexed).select(F.coalesce("baseline", F.lit(0.0)).alias("baseline"), (F.col("n_a") * F.col("n_b")).alias("candidates_compared"), "shingles_indexed")
    return Comparison(told, summary, matches)
