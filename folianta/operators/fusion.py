"""Putting ranked lists together: rank fusion, neighbours, interleaving, reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS


def rrf(dense: DataFrame, sparse: DataFrame, k: int = DEFAULTS.k, rrf_k: int = DEFAULTS.rrf_k) -> DataFrame:
    """query_id, id, score, dense_rank, sparse_rank (from 0, null where an arm missed) and rank (from 1).

    An id scores 1 / (rrf_k + rank + 1) for each arm that has it. Ties go to the
    better dense rank, then to the better sparse rank.
    """
    a = dense.select("query_id", "id", (F.col("rank") - 1).alias("dense_rank"))
    b = sparse.select("query_id", "id", (F.col("rank") - 1).alias("sparse_rank"))
    term = lambda c: F.coalesce(1 / (rrf_k + F.col(c) + 1), F.lit(0.0))
    both = a.join(b, ["query_id", "id"], "full_outer").withColumn("score", F.round(term("dense_rank") + term("sparse_rank"), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"))
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_neighbours(hits: DataFrame, passages: DataFrame, top: int = DEFAULTS.neighbours) -> DataFrame:
    """``hits`` followed by the passages just before and after the ``top`` best, unless they are hits already.

    ``passages`` has id, book_id, chapter_index and chunk_index. A neighbour has
    score 0 and null ranks of its own; ``place`` counts on from the hits, so a
    query may get more rows than were asked for. A neighbour of two hits comes once.
    """
    spots = passages.select("id", "book_id", "chapter_index", "chunk_index")
    last = hits.groupBy("query_id").agg(F.max("rank").alias("last"))
    steps = F.posexplode(F.array(F.lit(-1), F.lit(1))).alias("side", "step")
    wanted = hits.where(F.col("rank") <= top).join(spots, "id").select("query_id", "rank", "book_id", "chapter_index", "chunk_index", steps)
    wanted = wanted.select("query_id", "rank", "side", "book_id", "chapter_index", (F.col("chunk_index") + F.col("step")).alias("chunk_index"))
    near = wanted.join(spots, ["book_id", "chapter_index", "chunk_index"]).join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
    first = near.groupBy("query_id", "id").agg(F.min(F.struct("rank", "side")).alias("from_"))
    order = Window.partitionBy("query_id").orderBy("from_")
    extra = first.withColumn("n", F.row_number().over(order)).join(last, "query_id")
    null = F.lit(None).cast("int")
    return hits.select("query_id", "id", "score", "dense_rank", "sparse_rank", F.col("rank").alias("place")).unionByName(
        extra.select("query_id", "id", F.lit(0.0).alias("score"), null.alias("dense_rank"), null.alias("sparse_rank"), (F.col("last") + F.col("n")).alias("place"))
    )


def round_robin(lists: DataFrame, k: int) -> DataFrame:
    """One passage of each list in turn, at most one of a chapter: the first k.

    ``lists`` has query_id, list_no, rank (from 0), id, book_id and
    chapter_index. A passage's first appearance in rank order takes its chapter,
    so this is a window, not a loop. Score is 1 / (rank + 1).
    """
    chapter = Window.partitionBy("query_id", "book_id", "chapter_index").orderBy("rank", "list_no")
    first = lists.withColumn("n", F.row_number().over(chapter)).where("n = 1")
    order = Window.partitionBy("query_id").orderBy("rank", "list_no")
    placed = first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return placed.select("query_id", "id", "list_no", F.round(1 / (F.col("rank") + 1), 6).alias("score"), "place")


def via(lists: DataFrame) -> DataFrame:
    """query_id, id and the numbers of the lists that found it, in order."""
    return lists.groupBy("query_id", "id").agg(F.array_sort(F.collect_set("list_no")).alias("via"))


def rerank(candidates: DataFrame, orders: DataFrame, k: int) -> DataFrame:
    """Candidates in a reranker's order, those it left out behind in their own, cut to k.

    ``candidates`` has query_id, id and place (from 1); ``orders`` has query_id
    and order, an array of places the reranker gave. Places it gave twice count
    once, unknown ones not at all; a query without an order keeps its own.
    """
    given = orders.select("query_id", F.posexplode("order").alias("at", "place")).groupBy("query_id", "place").agg(F.min("at").alias("at"))
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("at"), "place")
    return candidates.join(given, ["query_id", "place"], "left").withColumn("new_place", F.row_number().over(order)).where(F.col("new_place") <= k).drop("at")
