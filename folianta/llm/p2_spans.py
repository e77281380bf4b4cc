"""Problem 2: long runs of words that stand verbatim in more than one chapter.

Method: a de Bruijn graph of the repeated text. Its edges are runs of
``min_words`` words (k-mers); an edge that continues in one way only, and is
entered in one way only, is joined to the next, so each nonbranching path
becomes one span; the words at the source coordinates of a span verify it and
pair its records.

Only repeated text needs a graph. Every window of ``min_words`` words therefore
first names the smallest of its shorter k-mers (its minimizer, the same in any
text that holds the window); a window can only be repeated in another chapter
if its minimizer is. That drops nearly all text after one pass over a sketch of
about an eighth of the words, and loses nothing.

All joins are on hashes or words and spread over their values; a span of many
records costs one row per record until its pairs, the result itself, are made.
Then each span's records are salted: the pairs of ``SALT_ROWS`` of its records
with all its others are made in a task of their own.

Null ids take no part, null and wordless texts have no spans, exact copies of a
row count once, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialise
from .arrow import ragged, strings
from .words import sliding, window_hashes, word_hashes, word_runs

MIN_WORDS = 30
SALT_ROWS = 2000


def _chunks(chunks: DataFrame) -> DataFrame:
    section = F.xxhash64(F.coalesce(F.col("book_id").cast("string"), F.lit("\0")), F.coalesce(F.col("chapter_index").cast("string"), F.lit("\0")))
    return chunks.select(F.col("id").cast("string").alias("id"), section.alias("section"), F.col("text").cast("string").alias("text")).where("id is not null").withColumn("record", F.xxhash64("id"))


def _minimizers(min_words: int):
    k = (min_words + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, starts, ends, offsets = word_runs(batch["text"])
            count = np.diff(offsets)
            kmers = window_hashes(word_hashes(points, starts, ends), k)
            row = np.repeat(np.arange(len(count)), count)
            left = offsets[1:][row] - np.arange(len(row))
            # where a full window starts: the smallest k-mer in it; elsewhere 0, which no k-mer reaches
            least = np.where(left >= min_words, sliding(kmers, min_words - k + 1, np.minimum), np.uint64(0))
            above = sliding(least[::-1], min_words - k + 1, np.maximum)[::-1]
            at = np.flatnonzero((above == kmers) & (left >= k) & (above > 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(kmers[at].view(np.int64)), batch["record"].take(pa.array(row[at])), batch["section"].take(pa.array(row[at])), pa.array((at - offsets[row[at]]).astype(np.int32))],
                names=["kmer", "record", "section", "place"],
            )

    return run


def _edges(min_words: int):
    k = (min_words + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, starts, ends, offsets = word_runs(batch["text"])
            count = np.diff(offsets)
            hashes = window_hashes(word_hashes(points, starts, ends), min_words)
            # each repeated minimizer asks for the windows that hold it
            asked = np.zeros(len(starts) + 1, np.int64)
            places = batch["places"]
            size = np.asarray(places.value_lengths().fill_null(0))
            at = np.asarray(places.flatten()).astype(np.int64) + np.repeat(offsets[:-1], size)
            begin = np.repeat(offsets[:-1], size)
            np.add.at(asked, np.maximum(begin, at + k - min_words), 1)
            np.add.at(asked, at + 1, -1)
            row = np.repeat(np.arange(len(count)), count)
            full = offsets[1:][row] - np.arange(len(row)) >= min_words
            take = np.flatnonzero((np.cumsum(asked[:-1]) > 0) & full)
            # the words of the record, one space between two, verify its spans
            room = np.concatenate(([0], np.cumsum(ends - starts + 1)))
            spaced = np.full(int(room[-1]), 32, np.uint32)
            spaced[ragged(room[:-1], ends - starts)] = points[ragged(starts, ends - starts)]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["section"], pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), strings(spaced, room[offsets])], names=["id", "section", "edge", "place", "words"]
            )
            yield pa.RecordBatch.from_arrays(
                [batch["id"].take(pa.array(row[take])), batch["section"].take(pa.array(row[take])), pa.array(hashes[take].view(np.int64)), pa.array((take - offsets[row[take]]).astype(np.int32)), pa.nulls(len(take), pa.string())],
                names=["id", "section", "edge", "place", "words"],
            )

    return run


def _in_two_sections(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min("section").alias("low"), F.max("section").alias("high")).where("low <> high").select(key)


def _repeated(chunks: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """Edges of the graph by source coordinate (id, section, edge, place), and the words of their records."""
    rows = _chunks(chunks)
    sketch = materialise(rows.select("record", "section", "text").mapInArrow(_minimizers(min_words), "kmer bigint, record bigint, section bigint, place int"), "sketch")
    asked = sketch.join(_in_two_sections(sketch, "kmer"), "kmer", "left_semi").groupBy("record").agg(F.array_sort(F.collect_set("place")).alias("places"))
    there = rows.join(asked, "record").select("id", "section", "text", "places")
    found = materialise(there.mapInArrow(_edges(min_words), "id string, section bigint, edge bigint, place int, words string"), "edges")
    edges = found.where("edge is not null").dropDuplicates(["id", "section", "place", "edge"])
    words = found.where("words is not null").select("id", "section", "words").dropDuplicates(["id", "section", "words"])
    return edges.join(_in_two_sections(edges, "edge"), "edge", "left_semi"), words


def _paths(edges: DataFrame, min_words: int) -> DataFrame:
    """Nonbranching paths by source: id, section, path (its first edge), start and n_words."""
    order = Window.partitionBy("id", "section").orderBy("place")
    steps = edges.select(
        "id", "section", "edge", "place",
        F.when(F.lead("place").over(order) == F.col("place") + 1, F.lead("edge").over(order)).alias("after"),
        F.when(F.lag("place").over(order) == F.col("place") - 1, F.lag("edge").over(order)).alias("before"),
    )
    only = lambda c: F.when((F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c)), F.min(c))
    ways = materialise(steps.groupBy("edge").agg(only("after").alias("only_after"), only("before").alias("only_before")), "ways")
    joined = steps.join(ways.select("edge", "only_before"), "edge").join(ways.select(F.col("edge").alias("before"), "only_after"), "before", "left")
    goes_on = F.coalesce((F.col("only_before") == F.col("before")) & (F.col("only_after") == F.col("edge")), F.lit(False))
    sofar = order.rowsBetween(Window.unboundedPreceding, 0)
    headed = joined.withColumn("start", F.last(F.when(~goes_on, F.col("place")), ignorenulls=True).over(sofar))
    return headed.groupBy("id", "section", "start").agg(F.min_by("edge", "place").alias("path"), (F.count(F.lit(1)) + F.lit(min_words - 1)).alias("n_words"))


def shared_spans(chunks: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Each span by the record that holds it: id, section, start (in words), n_words, phrase."""
    edges, words = _repeated(chunks, min_words)
    spans = _paths(edges, min_words).join(words, ["id", "section"])
    phrase = F.array_join(F.slice(F.split("words", " "), F.col("start") + 1, F.col("n_words").cast("int")), " ")
    return spans.select("id", "section", "start", "n_words", phrase.alias("phrase"))


def span_pairs(chunks: DataFrame, min_words: int = MIN_WORDS, salt_rows: int = SALT_ROWS) -> DataFrame:
    """``a_id``, ``b_id``: records of different chapters that share a run of ``min_words`` words, smaller id first."""
    spans = materialise(shared_spans(chunks, min_words).select("id", "section", "phrase").distinct(), "spans")
    sizes = spans.groupBy("phrase").agg(F.ceil(F.count(F.lit(1)) / salt_rows).cast("int").alias("salts"))
    # nearly every span has one salt; only those of many records meet their number
    sized = spans.join(sizes.where("salts > 1"), "phrase", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    a = sized.select(F.col("id").alias("a_id"), F.col("section").alias("a_section"), "phrase", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
    b = sized.select(F.col("id").alias("b_id"), F.col("section").alias("b_section"), "phrase", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    pairs = a.join(b, ["phrase", "salt"]).where("a_id < b_id and a_section <> b_section")
    return pairs.select("a_id", "b_id").distinct()


def shared_share(chunks: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """For each record: id, n_words, shared_words (in runs that also stand in another chapter), share, longest run.

    The runs are the spans of the graph whose words stand in another chapter too;
    where one span goes on in the next, both are one run. Records without such a
    run are there with 0; so are those with null texts.
    """
    spans = materialise(shared_spans(chunks, min_words), "spans")
    verified = spans.join(_in_two_sections(spans, "phrase"), "phrase", "left_semi").select("id", "section", "start", (F.col("start") + F.col("n_words")).alias("end"))
    order = Window.partitionBy("id", "section").orderBy("start", "end")
    so_far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # edges of one run overlap by all but one word
    new_run = F.coalesce((F.col("start") > so_far - (min_words - 1)).cast("int"), F.lit(1))
    runs = verified.select("*", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(so_far, F.lit(0)))).alias("adds"), new_run.alias("new"))
    runs = runs.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    by_run = runs.groupBy("id", "section", "run").agg(F.sum("adds").alias("adds"), (F.max("end") - F.min("start")).alias("length"))
    shared = by_run.groupBy("id", "section").agg(F.sum("adds").alias("shared"), F.max("length").alias("longest"))
    n_words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}\p{M}\p{N}'’]+"), F.lit(0))).cast("bigint")
    counted = _chunks(chunks).select("id", "section", n_words.alias("n_words")).distinct()
    out = counted.join(shared, ["id", "section"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return out.select("id", "n_words", zero("shared").alias("shared_words"), F.round(zero("shared") / F.greatest(F.col("n_words"), F.lit(1)), 6).alias("share"), zero("longest").alias("longest_run"))
