"""Notes on chapters and books by a provider, checked against the text, and surveys over them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import title_words
from .providers import Provider

#: How much of a chapter a provider is given.
CHARS = 14_000


def chapter_notes(chapters: DataFrame, provider: Provider, chars: int = CHARS, rewrites: int = 1) -> DataFrame:
    """book_id, chapter_index, title, summary, moments and rewritten (how often).

    ``chapters`` has book_id, chapter_index, title and text. A summary with
    statements the provider can't find in the chapter is written again, at most
    ``rewrites`` times; a failing check lets it stand, a failing summary is
    empty. Moments are quotations of over 20 characters that the chapter holds,
    in letters and digits; the whole text is looked at. A null text is an empty one.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for title, text in zip(frame["title"], frame["given"], strict=True):
                summary, moments, again = "", [], 0
                try:
                    said = provider.summarise(title or "", text)
                    summary = str(said.get("summary") or "").strip()
                    moments = [str(m or "").strip() for m in said.get("moments") or []]
                    while summary and again < rewrites and (problems := provider.unsupported(text, summary)):
                        summary = str(provider.rewrite(text, summary, problems) or summary).strip()
                        again += 1
                except Exception:
                    pass
                made.append((summary, moments, again))
            yield frame[["book_id", "chapter_index", "title", "text"]].assign(summary=[m[0] for m in made], told=[m[1] for m in made], rewritten=[m[2] for m in made])

    text = F.coalesce("text", F.lit(""))
    rows = chapters.select(F.col("book_id").cast("string").alias("book_id"), F.col("chapter_index").cast("int").alias("chapter_index"), F.col("title").cast("string").alias("title"), text.alias("text"), F.substring(text, 1, chars).alias("given"))
    noted = rows.mapInPandas(run, "book_id string, chapter_index int, title string, text string, summary string, told array<string>, rewritten int")
    return noted.withColumn("moments", verified("told", "text")).select("book_id", "chapter_index", "title", "summary", "moments", "rewritten")


def verified(moments: str, text: str, least: int = 20):
    """Those of ``moments`` longer than ``least`` characters that ``text`` holds, in letters and digits."""
    return F.filter(moments, lambda m: (F.length(m) > least) & (title_words(m) != "") & F.contains(title_words(F.col(text)), title_words(m)))


def book_notes(notes: DataFrame, provider: Provider, chars: int = CHARS) -> DataFrame:
    """book_id, chapters and summary: a book's note, written from its chapters' notes in order.

    Only as many first characters of each chapter's note are put together as
    leave room for all within ``chars``, as a provider takes no more.
    """
    n = notes.groupBy("book_id").agg(F.count(F.lit(1)).alias("chapters"))
    room = F.greatest(F.lit(1), F.floor(F.lit(chars) / F.col("chapters"))).cast("int")
    line = F.substring(F.concat(F.coalesce("title", F.lit("")), F.lit(": "), F.coalesce("summary", F.lit(""))), F.lit(1), room)
    part = notes.join(n, "book_id").select("book_id", "chapters", F.struct("chapter_index", line.alias("line")).alias("part"))
    given = part.groupBy("book_id", "chapters").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["line"]), "\n").alias("given"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for book, text in zip(frame["book_id"], frame["given"], strict=True):
                try:
                    out.append(str(provider.summarise(book, text).get("summary") or "").strip())
                except Exception:
                    out.append("")
            yield frame[["book_id", "chapters"]].assign(summary=out)

    return given.mapInPandas(run, "book_id string, chapters bigint, summary string")


def onto_chapters(chapters: DataFrame, notes: DataFrame) -> DataFrame:
    """``chapters`` (book_id, chapter_index, title) with summary (null where there is no note) and moments (then empty).

    Notes of sections that aren't chapters are left out. Of several notes on one chapter one stands.
    """
    told = notes.select("book_id", "chapter_index", "summary", "moments").dropDuplicates(["book_id", "chapter_index"])
    joined = chapters.select("book_id", "chapter_index", "title").join(told, ["book_id", "chapter_index"], "left")
    return joined.withColumn("moments", F.coalesce("moments", F.array().cast("array<string>")))


def about_the_book(books: DataFrame, book_notes: DataFrame, chapters: DataFrame) -> DataFrame:
    """book_id, summary, chapters and prepared: what the notes tell about each of ``books`` (book_id).

    ``chapters`` comes from ``onto_chapters``; its notes are put together in
    order, a line (``title: summary``) each. A book without a note of its own
    isn't prepared and tells nothing.
    """
    line = F.concat(F.coalesce("title", F.lit("")), F.lit(": "), "summary")
    part = F.array_sort(F.collect_list(F.when(F.col("summary").isNotNull(), F.struct("chapter_index", line.alias("line")))))
    lines = chapters.groupBy("book_id").agg(F.array_join(F.transform(part, lambda p: p["line"]), "\n").alias("chapters"))
    joined = books.select("book_id").distinct().join(book_notes.select("book_id", "summary"), "book_id", "left").join(lines, "book_id", "left")
    prepared = F.col("summary").isNotNull()
    return joined.select("book_id", "summary", F.when(prepared, F.col("chapters")).alias("chapters"), prepared.alias("prepared"))


def survey(notes: DataFrame, wanted: str, provider: Provider, named: int = 8) -> DataFrame:
    """book_id, chapters, marked and first (titles of the first ``named`` marked chapters): which chapters hold a thing, by their notes.

    Every note is read. A book whose provider fails on a note counts it as not
    marked. ``wanted`` of fewer than three characters is a ``ValueError``.
    """
    if len(wanted.strip()) < 3:
        raise ValueError("tell what to look for")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            marks = []
            for note in frame["summary"]:
                try:
                    marks.append(bool(provider.mark(wanted, note or "")))
                except Exception:
                    marks.append(False)
            yield frame[["book_id", "chapter_index", "title"]].assign(marked=marks)

    marked = notes.select("book_id", "chapter_index", "title", "summary").mapInPandas(run, "book_id string, chapter_index int, title string, marked boolean")
    order = Window.partitionBy("book_id", "marked").orderBy("chapter_index")
    ranked = marked.withColumn("n", F.row_number().over(order))
    first = F.array_sort(F.collect_list(F.when(F.col("marked") & (F.col("n") <= named), F.struct("n", F.coalesce("title", F.lit("")).alias("title")))))
    return ranked.groupBy("book_id").agg(F.count(F.lit(1)).alias("chapters"), F.count(F.when(F.col("marked"), 1)).alias("marked"), F.array_join(F.transform(first, lambda x: x["title"]), ", ").alias("first"))
