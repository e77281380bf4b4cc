"""Exact counting of terms, and names worth following."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.text import count_matches
from .lexical import LexicalIndex

#: Terms counted in one pass.
MOST_TERMS = 1000

#: Fixed value: a capitalised run of up to three words, with or without a title.
NAME = r"(?<![A-Za-z0-9_])((?:Mr|Mrs|Miss|Sir|Lady|Dr|Lord|Colonel|Captain)\.?\s+)?([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,}){0,2})(?![A-Za-z0-9_])"


def mentions(chapters: DataFrame, terms: DataFrame) -> DataFrame:
    """term, book_id, chapter_index and mentions, where there are any.

    ``chapters`` has book_id, chapter_index and text; ``terms`` has term, a list
    that a person typed. More than ``MOST_TERMS`` different ones are a
    ``ValueError``, so that every chapter is read once with all of them beside it.
    """
    typed = [row["term"] for row in terms.where("term is not null").distinct().limit(MOST_TERMS + 1).collect()]
    if len(typed) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    listed = F.array(*map(F.lit, sorted(typed))) if typed else F.array().cast("array<string>")
    met = chapters.select("book_id", "chapter_index", "text", F.explode(listed).alias("term"))
    return met.select("term", "book_id", "chapter_index", count_matches(F.col("text"), F.col("term")).cast("bigint").alias("mentions")).where("mentions > 0")


def mention_totals(found: DataFrame, top: int = 3) -> DataFrame:
    """term, book_id, total, chapters (that mention it) and top (its chapters with most, ``index:mentions``)."""
    order = Window.partitionBy("term", "book_id").orderBy(F.desc("mentions"), "chapter_index")
    ranked = found.withColumn("n", F.row_number().over(order))
    best = F.array_sort(F.collect_list(F.when(F.col("n") <= top, F.struct("n", F.concat_ws(":", "chapter_index", "mentions").alias("said")))))
    return ranked.groupBy("term", "book_id").agg(F.sum("mentions").alias("total"), F.count(F.lit(1)).alias("chapters"), F.array_join(F.transform(best, lambda b: b["said"]), " ").alias("top"))


def entity_candidates(passages: DataFrame, index: LexicalIndex, most: int = DEFAULTS.most_entities, least_idf: float = DEFAULTS.least_entity_idf) -> DataFrame:
    """query_id, name, idf and rank: the rarest names of a query's passages that the query doesn't hold.

    ``passages`` has query_id, query and text. A name is as rare as its last
    word; at least ``least_idf`` is asked for. Ties go to the name first in the alphabet.
    """
    runs = F.regexp_extract_all("text", F.lit(NAME), F.lit(0))
    names = passages.select("query_id", F.regexp_extract_all(F.lower("query"), F.lit("[a-z]+"), F.lit(0)).alias("asked"), F.explode(runs).alias("name")).distinct()
    bare = F.regexp_extract("name", NAME, 2)
    words = F.split(F.lower(bare), r"\s+")
    fresh = names.select("query_id", F.trim("name").alias("name"), words.alias("words"), "asked").where(F.size(F.array_except("words", "asked")) > 0)
    rare = fresh.withColumn("term", F.element_at("words", -1)).join(index.terms.select("term", "idf"), "term").where(F.col("idf") >= least_idf)
    best = rare.groupBy("query_id", "name").agg(F.round(F.max("idf"), 6).alias("idf"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("idf"), "name"))
    return best.withColumn("rank", rank).where(F.col("rank") <= most)
