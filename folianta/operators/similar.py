"""Comparing collections: nearest passages, a measured baseline, strength in words, a diverse selection."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import numbered
from ..functions.vectors import dot
from ..sources.tables import materialise
from . import dense

# What the categories and the lift over the baseline are called.
RELATIONSHIPS = {
    "parallel_scene": "the same kind of scene",
    "shared_theme": "the same idea, handled differently",
    "similar_phrasing": "closely similar wording",
    "coincidental": "no real connection, shared genre only",
}
STRENGTHS = [
    (0.05, "no more alike than any two passages picked at random from these books"),
    (0.15, "slightly closer than average, but weak"),
    (0.25, "clearly closer than average, worth reading"),
]
STRONGEST = "much closer than average. A strong resemblance"


def strength(similarity: Column, baseline: Column) -> Column:
    """How far above the baseline a similarity is, in words."""
    lift = similarity - baseline
    said = F.lit(STRONGEST)
    for below, words in reversed(STRENGTHS):
        said = F.when(lift < below, words).otherwise(said)
    return said


def relationship(kind: Column) -> Column:
    """A relationship in words; anything unknown or null is not assessed."""
    said = F.lit("not assessed")
    for name, words in RELATIONSHIPS.items():
        said = F.when(kind == name, words).otherwise(said)
    return said


def nearest(a: DataFrame, b: DataFrame, dims: int = 64) -> DataFrame:
    """a_id, b_id and similarity: for each vector of ``a`` the most similar of ``b``.

    Both have id, book_id and vector, normalised; ties go to the smaller id, and
    a product of exactly -1 is no match.
    """
    asked = a.select(F.col("id").alias("query_id"), F.lit(None).cast("string").alias("scope"), "vector")
    found = dense.search(asked, b, 1, dims).where("score > -1")
    return found.select(F.col("query_id").alias("a_id"), F.col("id").alias("b_id"), F.col("score").alias("similarity"))


#: Vectors that ask in one task at most, some 1 kB each.
BLOCK_ROWS = 120_000


class _Asking:
    """The vectors of a task that ask, and for each the best of the book that is just coming by."""

    def __init__(self, batches: list[pa.RecordBatch], dims: int, raw: bool) -> None:
        rows = pa.Table.from_batches(batches)
        self.id, self.chapter = rows["id"].combine_chunks(), rows["chapter"].combine_chunks()
        self.vector = np.concatenate([_vectors(batch, dims, raw) for batch in batches])
        self.single = self.vector.astype(np.float32)
        self.length = np.sqrt(np.einsum("nd,nd->n", self.vector, self.vector)).max(initial=0)
        books = rows["book_id"].combine_chunks().dictionary_encode()
        self.named, self.book = {name: i for i, name in enumerate(books.dictionary.to_pylist())}, np.asarray(books.indices)
        self.next_book()

    def next_book(self) -> None:
        self.best, self.row = np.full(len(self.id), -1.0), np.full(len(self.id), -1)

    def meet(self, x: np.ndarray, first: int, least: float) -> None:
        """``x`` are the next vectors of the book by id, ``first`` the place of their first in it; what stays under ``least`` is of no use."""
        single = x.astype(np.float32)
        # what a product in single precision may be off by, and what rounding to 6 places may lift
        slack = np.float32(1e-5 + 2e-5 * self.length * np.sqrt(np.einsum("nd,nd->n", x, x)).max(initial=0))
        for at in range(0, len(self.best), 512):
            near = self.single[at : at + 512] @ single.T
            top = near.max(axis=1)
            some = np.flatnonzero(top >= np.maximum(self.best[at : at + 512], least) - slack)
            if not len(some):
                continue
            i, j = np.nonzero((near if len(some) == len(near) else near[some]) >= (top[some] - slack)[:, None])
            i = some[i] + at
            value = np.round(np.einsum("nd,nd->n", self.vector[i], x[j]), 6)
            if len(i) > len(some):
                order = np.lexsort((j, -value, i))
                order = order[np.r_[True, np.diff(i[order]) > 0]]
                i, j, value = i[order], j[order], value[order]
            # an equal one that came before has the smaller id
            higher = value > self.best[i]
            self.best[i[higher]], self.row[i[higher]] = value[higher], j[higher] + first


def _vectors(batch: pa.RecordBatch, dims: int, raw: bool) -> np.ndarray:
    x = np.asarray(batch["vector"].flatten(), np.float64).reshape(-1, dims)
    if raw:
        # in order, as ``functions.vectors.unit`` adds up
        total = np.zeros(len(x))
        for d in range(dims):
            total += x[:, d] * x[:, d]
        length = np.sqrt(total)
        x = x / np.where(length == 0, 1.0, length)[:, None]
    return x


def _books_met(batches: Iterator[pa.RecordBatch], dims: int, raw: bool, least=lambda: -1.0):
    """For each book that comes by: who asks, its name, the ids and chapters of its vectors, and which of those who ask have a best in it.

    Those who ask come first; behind them the books' vectors by book and id, so
    of a book no more than a batch of vectors and its ids are held.
    """
    waiting, asking, book, met = [], None, None, []
    column = lambda name: pa.concat_arrays([batch[name] for batch in met])

    def done():
        found = np.flatnonzero((asking.book != asking.named.get(book, -1)) & (asking.best > -1))
        return asking, book, column("id"), column("chapter"), found

    for batch in batches:
        ask = int(np.count_nonzero(batch["asks"].to_numpy(zero_copy_only=False)))
        if ask:
            waiting.append(batch.slice(0, ask))
        batch = batch.slice(ask)
        if not batch.num_rows or not (waiting or asking):
            continue
        if asking is None:
            asking, waiting = _Asking(waiting, dims, raw), []
        x, names = _vectors(batch, dims, raw), np.asarray(batch["book_id"].to_pylist(), object)
        starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        for start, end in zip(starts, np.r_[starts[1:], len(x)], strict=True):
            if names[start] != book:
                if book is not None:
                    yield done()
                asking.next_book()
                book, met = names[start], []
            first = sum(one.num_rows for one in met)
            met.append(batch.select(["id", "chapter"]).slice(start, end - start))
            for low in range(start, end, 2048):
                asking.meet(x[low : min(low + 2048, end)], first + low - start, least())
    if book is not None:
        yield done()


def _met(vectors: DataFrame, run, kinds: str, block_rows: int) -> DataFrame:
    """What ``run`` makes of every vector and every book: a task has a block of those who ask, and some books whole.

    Nothing but the vectors moves: a book's best is settled within a task.
    """
    rows, cores = vectors.count(), vectors.sparkSession.sparkContext.defaultParallelism
    # blocks and groups of books as even as may be, since a vector moves once for each of either
    blocks = max(1, math.ceil(rows / block_rows), min(math.ceil(rows / 500), math.ceil(math.sqrt(2 * cores))))
    groups = math.ceil(2 * cores / blocks)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of_block, of_group = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("book_id"), F.lit(groups)).cast("int")
    ask = vectors.select("*", F.lit(True).alias("asks"), of_block.alias("block"), every(groups).alias("group"))
    told = vectors.select("*", F.lit(False).alias("asks"), every(blocks).alias("block"), of_group.alias("group"))
    both = ask.unionByName(told).select(*vectors.columns, "asks", (F.col("group") * blocks + F.col("block")).alias("task"))
    return both.repartitionById(blocks * groups, "task").sortWithinPartitions(F.desc("asks"), "book_id", "id").mapInArrow(run, kinds)


def nearest_of_books(vectors: DataFrame, dims: int = 64, block_rows: int = BLOCK_ROWS, raw: bool = False, books: bool = True) -> DataFrame:
    """a_id, b_id, a_book, b_book and similarity: for each vector and each other book, the most similar of that book.

    ``vectors`` has id, book_id and vector, normalised, or as they are if ``raw``;
    those without a book take no part. Ties and products of -1 are as in
    ``nearest``. Rows leave a task book by book. Without ``books`` the two
    columns of books are left out.
    """
    kinds = "a_id string, b_id string, a_book string, b_book string, similarity double" if books else "a_id string, b_id string, similarity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asking, book, ids, _, found in _books_met(batches, dims, raw):
            at = pa.array(found)
            named = [pa.array(list(asking.named), pa.string()).take(pa.array(asking.book[found])), pa.array(np.full(len(found), book, object), pa.string())] if books else []
            names = ["a_id", "b_id", *["a_book", "b_book"] * books, "similarity"]
            yield pa.RecordBatch.from_arrays([asking.id.take(at), ids.take(pa.array(asking.row[found])), *named, pa.array(asking.best[found])], names=names)

    named = vectors.where("book_id is not null").select("id", "book_id", F.lit(None).cast("string").alias("chapter"), "vector")
    return _met(named, run, kinds, block_rows)


def _leads(pairs: list[tuple], top: int) -> list[tuple]:
    """Of pairs (minus similarity, a_id, b_id, a_chapter, b_chapter) those that ``diverse`` would walk."""
    out, met, of_a, of_b = [], set(), Counter(), Counter()
    for pair in sorted(set(pairs)):
        a, b = pair[3:]
        if (a, b) in met:
            continue
        met.add((a, b))
        of_a[a] += 1
        if of_a[a] > top:
            continue
        of_b[b] += 1
        if of_b[b] <= top:
            out.append(pair)
            if len(out) == 2 * top * top:
                break
    return out


def diverse_of_books(vectors: DataFrame, top: int, dims: int = 64, block_rows: int = BLOCK_ROWS, raw: bool = False) -> DataFrame:
    """The diverse selection of all pairs of ``nearest_of_books``, each told once with the smaller id first.

    ``vectors`` has id, book_id, chapter (its book's) and vector. What ``diverse``
    says of the pairs that hold every choice is true of any part of them as well,
    so a task sends on 2 * ``top`` squared pairs at most, and what is less similar
    than the last of so many can't be chosen.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        least = lambda: -kept[-1][0] if len(kept) == 2 * top * top else -1.0
        for asking, _, ids, chapters, found in _books_met(batches, dims, raw, least):
            found = found[asking.best[found] >= least()]
            if not len(found):
                continue
            at, row = pa.array(found), pa.array(asking.row[found])
            fresh = zip(asking.best[found].tolist(), asking.id.take(at).to_pylist(), ids.take(row).to_pylist(), asking.chapter.take(at).to_pylist(), chapters.take(row).to_pylist(), strict=True)
            kept = _leads(kept + [(-s, a, b, x, y) if a < b else (-s, b, a, y, x) for s, a, b, x, y in fresh], top)
        yield pa.RecordBatch.from_pylist([{"a_id": a, "b_id": b, "a_chapter": x, "b_chapter": y, "similarity": -s} for s, a, b, x, y in kept], schema=pa.schema([(c, pa.string()) for c in ("a_id", "b_id", "a_chapter", "b_chapter")] + [("similarity", pa.float64())]))

    named = vectors.where("book_id is not null").select("id", "book_id", "chapter", "vector")
    found = _met(named, run, "a_id string, b_id string, a_chapter string, b_chapter string, similarity double", block_rows)
    # walked more than once, and found by all that work
    return diverse(materialise(found, "leads").distinct(), top)


def diverse(pairs: DataFrame, top: int) -> DataFrame:
    """The most similar pairs of which no two share a chapter on either side, at most ``top``; with their ``place``.

    ``pairs`` has a_id, b_id, a_chapter, b_chapter and similarity. Only the best
    pair of two chapters can be chosen. A chosen pair has fewer than ``top``
    better ones in either of its chapters, as each of those was shut out by
    another choice; of the pairs that are so good on both sides, a choice shuts
    out fewer than 2 * ``top``. So the first 2 * ``top`` squared of them hold
    every choice, whatever the number of passages, and only those are walked.
    """
    better = [F.desc("similarity"), "a_id", "b_id"]
    nth = lambda *c: F.row_number().over(Window.partitionBy(*c).orderBy(*better))
    leads = pairs.withColumn("n", nth("a_chapter", "b_chapter")).where("n = 1").drop("n")
    good = leads.withColumn("n", nth("a_chapter")).where(F.col("n") <= top).withColumn("m", nth("b_chapter")).where(F.col("m") <= top).drop("n", "m")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b, place = set(), set(), 0
        for batch in batches:
            kept = []
            for row in batch.itertuples(index=False):
                if place < top and row.a_chapter not in a and row.b_chapter not in b:
                    a.add(row.a_chapter), b.add(row.b_chapter)
                    place += 1
                    kept.append((*row, place))
            yield pd.DataFrame(kept, columns=[*batch.columns, "place"])

    ordered = good.orderBy(*better).limit(2 * top * top).coalesce(1).sortWithinPartitions(*better)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in leads.schema)
    return ordered.mapInPandas(walk, f"{kinds}, place int")


def placed(vectors: DataFrame) -> DataFrame:
    """vector and place (from 0, by id) of a book's vectors."""
    return numbered(vectors.select("id", "vector"), ["id"]).select("vector", "place")


def baseline(a: DataFrame, b: DataFrame, most: int = 60) -> DataFrame:
    """One row, ``baseline``: the mean product of evenly spaced rows of both sides, to 4 places.

    Both have place (from 0 in corpus order) and vector. Every n-th row is taken,
    n being the size over ``most`` rounded down, so each side gives fewer than
    2 * ``most`` rows whatever its size.
    """
    def sample(side: DataFrame, name: str) -> DataFrame:
        stride = F.broadcast(side.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / most)).alias("stride")))
        return side.crossJoin(stride).where("place % stride = 0").select(F.col("vector").alias(name))

    both = sample(a, "x").crossJoin(F.broadcast(sample(b, "y")))
    return both.agg(F.round(F.avg(dot(F.col("x"), F.col("y"))), 4).alias("baseline"))


def baselines(vectors: DataFrame, most: int = 60, dims: int = 64) -> DataFrame:
    """a_book, b_book (smaller first) and ``baseline`` of every two books, sampled as ``baseline`` does.

    ``vectors`` has id, book_id and vector. The mean of all products of two samples
    is the product of their means, so a book moves one vector, whatever its sample.
    """
    sizes = vectors.where("book_id is not null").groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / most))
    # places run over all books; a book's first is taken off
    placed_ = numbered(vectors.where("book_id is not null").select("id", "book_id", "vector"), ["book_id", "id"])
    firsts = placed_.groupBy("book_id").agg(F.min("place").alias("first"))
    taken = placed_.join(firsts, "book_id").join(sizes, "book_id").where((F.col("place") - F.col("first")) % stride == 0)
    mean = F.array(*[F.avg(F.element_at("vector", i + 1).cast("double")) for i in range(dims)])
    means = materialise(taken.groupBy("book_id").agg(mean.alias("mean")), "means")
    side = lambda book, name: means.select(F.col("book_id").alias(book), F.col("mean").alias(name))
    both = side("a_book", "x").join(side("b_book", "y"), F.col("a_book") < F.col("b_book"))
    return both.select("a_book", "b_book", F.round(dot(F.col("x"), F.col("y")), 4).alias("baseline"))
