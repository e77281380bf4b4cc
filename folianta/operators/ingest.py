"""From pages to sections to chunks, and the figures that describe them."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.text import count_words, fix_heading, has_numeral, split_sentences, squash, title_words

# What holds no prose.
SKIPPED_CLASSES = {"pagenum", "pagenumber", "figcenter", "caption"}
SKIPPED_TAGS = {"table", "style", "script"}
SKIPPED_IDS = {"pg-header", "pg-footer"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSES_PARAGRAPH = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "blockquote", "section", "article", "pre", "hr"}


class _Reader(HTMLParser):
    """Headings and paragraphs in document order; a one-letter image is its letter (a drop cap)."""

    def __init__(self, heading: str):
        super().__init__(convert_charrefs=True)
        self.heading, self.found, self.open, self.depth = heading, [], None, 0
        self.skip: list[str] = []

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        if tag == "img":
            letter = given.get("alt", "").strip()
            if len(letter) == 1 and letter.isascii() and letter.isalpha() and not self.skip:
                self.handle_data(letter)
            return
        dropped = tag in SKIPPED_TAGS or given.get("id") in SKIPPED_IDS or SKIPPED_CLASSES & set(given.get("class", "").split())
        if self.skip or dropped:
            if tag not in VOID:
                self.skip.append(tag)
            return
        if tag in CLOSES_PARAGRAPH and self.open and self.open[0] == "p":
            self.open = None
        if tag in (self.heading, "p"):
            self.open = [tag, ""]
            self.found.append(self.open)

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                while self.skip.pop() != tag:
                    pass
            return
        if self.open and tag == self.open[0]:
            self.open = None

    def handle_data(self, data):
        if self.open and not self.skip:
            self.open[1] += data


def read_html(pages: DataFrame, heading: str = "h2") -> DataFrame:
    """book_id, place, is_heading and text of each heading and paragraph of ``pages`` (book_id, html).

    Null pages give nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for book, html in zip(batch.book_id, batch.html, strict=True):
                reader = _Reader(heading)
                reader.feed(html or "")
                reader.close()
                rows += [(book, i, tag == heading, text) for i, (tag, text) in enumerate(reader.found)]
            yield pd.DataFrame(rows, columns=["book_id", "place", "is_heading", "text"])

    return pages.select("book_id", "html").mapInPandas(run, "book_id string, place int, is_heading boolean, text string")


def sections_of(lines: DataFrame, least_words: int = DEFAULTS.least_section_words, numbered: float = 0.7) -> DataFrame:
    """book_id, chapter_index, title, paragraphs and word_count from the rows of ``read_html``.

    Text before the first heading and empty paragraphs are left out, and so are
    sections of fewer than ``least_words`` words; those that stay are numbered
    from 0. Then, where at least ``numbered`` of a book's titles hold a numeral,
    sections without one are dropped, and the numbers stay.
    """
    order = Window.partitionBy("book_id").orderBy("place")
    marked = lines.withColumn("text", squash(F.col("text"))).withColumn("section", F.sum(F.col("is_heading").cast("int")).over(order))
    heading = F.max(F.when(F.col("is_heading"), F.coalesce(F.nullif(fix_heading(F.col("text")), F.lit("")), F.lit("Front matter"))))
    body = F.array_sort(F.collect_list(F.when(~F.col("is_heading") & (F.col("text") != ""), F.struct("place", "text"))))
    grouped = marked.where("section > 0").groupBy("book_id", "section").agg(heading.alias("title"), F.transform(body, lambda p: p["text"]).alias("paragraphs"))
    sized = grouped.withColumn("word_count", paragraph_words(F.col("paragraphs"))).where(F.col("word_count") >= least_words)
    indexed = sized.withColumn("chapter_index", F.row_number().over(Window.partitionBy("book_id").orderBy("section")) - 1)
    return numbered_only(indexed, numbered).select("book_id", "chapter_index", "title", "paragraphs", "word_count")


def paragraph_words(paragraphs: Column) -> Column:
    """The words of all paragraphs of a section."""
    return F.aggregate(paragraphs, F.lit(0), lambda n, p: n + count_words(p))


def numbered_only(sections: DataFrame, share: float = 0.7) -> DataFrame:
    """Sections with a numeral in the title, in books where at least ``share`` of the titles have one; else all."""
    has = F.coalesce(has_numeral(F.col("title")), F.lit(False))
    rate = F.avg(has.cast("double")).over(Window.partitionBy("book_id"))
    return sections.withColumn("rate", rate).where((F.col("rate") < share) | has).drop("rate")


def chapter_texts(sections: DataFrame) -> DataFrame:
    """book_id, chapter_index, title, dropped and text: a chapter's paragraphs without leading echoes of its title.

    A paragraph echoes the title if either, in letters and digits only, holds
    the other and the paragraph has 1 to 59 characters so. A section without a
    usable title has no echoes.
    """
    title = title_words(F.col("title"))
    usual = F.coalesce(title, F.lit(""))
    key = F.transform("paragraphs", lambda p: F.coalesce(title_words(p), F.lit("")))
    echo = F.transform(key, lambda k: (usual != "") & (F.length(k) > 0) & (F.length(k) < 60) & (F.contains(usual, k) | F.contains(k, usual)))
    first = F.coalesce(F.nullif(F.array_position(echo, F.lit(False)), F.lit(0)) - 1, F.size("paragraphs"))
    kept = F.filter("paragraphs", lambda p, i: i >= first)
    return sections.select("book_id", "chapter_index", "title", first.cast("int").alias("dropped"), F.array_join(kept, "\n\n").alias("text"))


def fold(units: list[str], words: list[int], carries, target: int, overlap: int) -> list[tuple[str, int]]:
    """Greedy packing of a section's units to ``target`` words, each chunk led by the end of the one before.

    ``carries`` gives the sentences of a chunk with their words. The end carried
    over is the fewest last sentences with ``overlap`` words; it is dropped where
    it exceeds half the target.
    """
    made, held, size = [], [], 0
    for unit, n in [*zip(units, words, strict=True), (None, 0)]:
        if held and (unit is None or (size + n > target and size > 0)):
            text = "\n\n".join(held)
            made.append((text, size))
            tail, tail_words = [], 0
            for sentence, m in reversed(carries(text)):
                if tail_words >= overlap:
                    break
                tail.append(sentence)
                tail_words += m
            held, size = ([], 0) if tail_words > target / 2 else ([" ".join(reversed(tail))], tail_words)
        if unit is not None:
            held.append(unit)
            size += n
    return made


def chunk(sections: DataFrame, target: int = DEFAULTS.chunk_words, overlap: int = DEFAULTS.overlap_words) -> DataFrame:
    """id (book:chapter:n), book_id, chapter_index, chunk_index, text and word_count of the chunks of each section.

    Sentences are split and counted in the JVM; only the fold, which depends on
    what it did before, runs in Python, one row for each section, so no shuffle
    is needed. Paragraphs longer than the target are packed from whole sentences
    first. Null and empty paragraphs are left out.
    """
    p = F.filter("paragraphs", lambda x: F.coalesce(F.length(squash(x)), F.lit(0)) > 0)
    cut = F.transform(p, split_sentences)
    counted = F.transform(cut, lambda s: F.transform(s, count_words))
    rows = sections.select("book_id", "chapter_index", p.alias("paragraphs"), cut.alias("sentences"), counted.alias("words"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                known, units, sizes = {}, [], []
                for text, sentences, counts in zip(row.paragraphs, row.sentences, row.words, strict=True):
                    known |= dict(zip(sentences, map(int, counts), strict=True))
                    if sum(counts) <= target:
                        units.append(text), sizes.append(int(sum(counts)))
                        continue
                    held, size = [], 0
                    for sentence, n in zip(sentences, map(int, counts), strict=True):
                        if held and size + n > target:
                            units.append(" ".join(held)), sizes.append(size)
                            held, size = [], 0
                        held.append(sentence)
                        size += n
                    units.append(" ".join(held)), sizes.append(size)

                def carries(text, known=known):
                    found = []
                    for part in split_plain(text):
                        found.append((part, known.get(part, len(part.split()))))
                    return found

                out += [(row.book_id, row.chapter_index, i, text, n) for i, (text, n) in enumerate(fold(units, sizes, carries, target, overlap))]
            yield pd.DataFrame(out, columns=["book_id", "chapter_index", "chunk_index", "text", "word_count"])

    made = rows.mapInPandas(run, "book_id string, chapter_index int, chunk_index int, text string, word_count int")
    return made.select(F.concat_ws(":", "book_id", "chapter_index", "chunk_index").alias("id"), "*")


def split_plain(text: str) -> list[str]:
    """As ``functions.text.split_sentences``, for one string inside a task."""
    import regex

    from ..functions.text import ABBREVIATIONS, SPACE

    space = SPACE.replace(r"\s", r"\s\x0b")
    end = regex.compile(rf"(?<=[.!?][”’\"')\]]{{0,3}}){space}+")
    short = regex.compile(r"(?:^|[\s (\"'“‘\[])(?:" + "|".join(map(regex.escape, ABBREVIATIONS)) + r")\.\Z", regex.I)
    out: list[str] = []
    for part in end.split(text):
        if out and short.search(out[-1]):
            out[-1] += " " + part
        else:
            out.append(part)
    return out


def size_report(chunks: DataFrame) -> DataFrame:
    """book_id, n, mean and the 10th, 50th and 90th percentile and maximum of chunk words.

    A percentile is the value at place floor((n - 1) * p) of the sorted sizes,
    not interpolated; sizes are counted by value first, so no list of all of
    them is made.
    """
    counted = chunks.groupBy("book_id", "word_count").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("book_id").orderBy("word_count")
    placed = counted.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy("book_id")))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor((F.col("all") - 1) * p), F.col("word_count")))
    return placed.groupBy("book_id").agg(
        F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("word_count")) / F.sum("n"), 4).alias("mean"), at(0.1).alias("p10"), at(0.5).alias("p50"), at(0.9).alias("p90"), F.max("word_count").alias("max")
    )


def collection_stats(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """book_id, words and chapters (of its sections, as chunks overlap) and chunks."""
    words = sections.select("book_id", paragraph_words(F.col("paragraphs")).alias("w")).groupBy("book_id").agg(F.sum("w").alias("words"), F.count(F.lit(1)).alias("chapters"))
    n = chunks.groupBy("book_id").agg(F.count(F.lit(1)).alias("chunks"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return words.join(n, "book_id", "full_outer").select("book_id", zero("words"), zero("chapters"), zero("chunks"))


def chapter_list(chunks: DataFrame) -> DataFrame:
    """book_id, chapter_index and the title of a chapter's first chunk that has one, numbered chapters only where most are."""
    titled = F.min_by("chapter_title", F.when(F.col("chapter_title").isNotNull(), F.col("chunk_index")))
    first = chunks.groupBy("book_id", "chapter_index").agg(titled.alias("title"))
    return numbered_only(first).select("book_id", "chapter_index", "title")


def reading_order(chapters: DataFrame) -> DataFrame:
    """``chapters`` with the chapters just before and after; null where the number next to it is missing."""
    order = Window.partitionBy("book_id").orderBy("chapter_index")
    before, after = F.lag("chapter_index").over(order), F.lead("chapter_index").over(order)
    return chapters.select("book_id", "chapter_index", F.when(before == F.col("chapter_index") - 1, before).alias("previous"), F.when(after == F.col("chapter_index") + 1, after).alias("next"))


def seams(chunks: DataFrame) -> DataFrame:
    """before_id, after_id: consecutive chunks of one chapter."""
    order = Window.partitionBy("book_id", "chapter_index").orderBy("chunk_index")
    return chunks.select(F.col("id").alias("before_id"), F.lead("id").over(order).alias("after_id")).where("after_id is not null")
