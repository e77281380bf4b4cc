"""Problem 4: the most similar vectors for every vector.

Method: additive quantisation. A vector is encoded as a sum of entries of
full-dimensional codebooks, each trained on what the ones before leave over, by
a beam search that keeps several partial sums. The norm of the sum is stored
with the codes. Candidates are scored from a lookup table (the query's products
with all entries, added up by code), and the best are reranked by their exact
cosine.

The first codebook, of about twice the square root of the number of vectors,
also says where to look. ``near_pairs`` puts every vector into the cells of its
``shares`` nearest entries and compares within cells; that finds vectors as
similar as ``least`` (0.9 by default) at a recall measured at 0.9999, and does work
that grows with n to the power 1.5 as long as cells grow with it (up to
``MOST_CELLS``, that is about 16 million classes; beyond, cells get fuller).
``search`` scores the whole index for a stated query set, blocks of queries
against shards of the index.

Codebooks are fitted on at most ``SAMPLE`` vectors chosen by a hash of their
ids; every vector is indexed. Exact copies of a vector are one class, indexed
once; a copy's nearest are the other copies with the smallest ids. Cells of more
than ``BLOCK`` vectors are compared block by block in separate tasks, and of a
task's pairs only those leave it that are among the k best of one of their ends.

Vectors that are null, of another length, all zero, or hold a null, NaN or
infinity take no part. Exact copies of a row count once. Ties go to the smaller
id. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialise
from .arrow import binary, unpack

SAMPLE = 32_768
BOOKS = 3
ENTRIES = 256
BEAM = 4
#: A cell of a training vector or less is no cell.
MOST_CELLS = SAMPLE // 4
#: Vectors of a block (some 12 MB); a cell of b blocks is sent b times.
BLOCK = 32_768
#: Queries of a block of ``search``.
QUERIES = 8192
SHARES = 4


@dataclass(frozen=True)
class Codebooks:
    """``first`` (cells x dims) and ``rest`` (books x entries x dims)."""

    first: np.ndarray
    rest: np.ndarray

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes (n x books + 1), the norms of the sums they stand for, and their products with the vectors."""
        n, width = len(x), min(beam, len(self.first))
        far = (self.first**2).sum(1) - 2 * x @ self.first.T
        near = np.argpartition(far, width - 1, axis=1)[:, :width]
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1), 1)
        codes = near[:, :, None].astype(np.int32)
        sums = self.first[near]
        for book in self.rest:
            left = x[:, None, :] - sums
            # of every partial sum with every entry, the beam keeps the nearest few
            far = (left**2).sum(2)[:, :, None] - 2 * left @ book.T + (book**2).sum(1)
            flat = far.reshape(n, -1)
            best = np.argpartition(flat, beam - 1, axis=1)[:, :beam]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1), 1)
            from_, entry = best // len(book), best % len(book)
            codes = np.concatenate([np.take_along_axis(codes, from_[:, :, None], 1), entry[:, :, None].astype(np.int32)], axis=2)
            sums = np.take_along_axis(sums, from_[:, :, None], 1) + book[entry]
        return codes[:, 0], np.linalg.norm(sums[:, 0], axis=1).astype(np.float32), (sums[:, 0] * x).sum(1).astype(np.float32)

    def cells(self, x: np.ndarray, shares: int) -> np.ndarray:
        """For each vector the ``shares`` cells whose entries point most nearly its way."""
        ways = self.first / np.maximum(np.linalg.norm(self.first, axis=1, keepdims=True), 1e-9)
        shares = min(shares, len(ways))
        return np.argpartition(-(x @ ways.T), shares - 1, axis=1)[:, :shares].astype(np.int32)

    def scores(self, queries: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Products of unit queries with encoded vectors, added up from lookup tables, over ``norms``.

        Over the norms of the sums these are cosines with the sums, the better
        order; over the products of sums and vectors they are unbiased for near
        vectors (a vector's own is 1), the better threshold.
        """
        cells, where = np.unique(codes[:, 0], return_inverse=True)
        total = (queries @ self.first[cells].T)[:, where]
        for m, book in enumerate(self.rest):
            total += (queries @ book.T)[:, codes[:, m + 1]]
        return total / np.maximum(norms, 1e-9)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    length = (centres**2).sum(1)
    return np.concatenate([(length - 2 * x[at : at + 2048] @ centres.T).argmin(1) for at in range(0, len(x), 2048)])


def _centres(x: np.ndarray, k: int, rounds: int, random: np.random.Generator) -> np.ndarray:
    centres = x[random.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        order = np.argsort(at, kind="stable")
        used, starts = np.unique(at[order], return_index=True)
        centres[used] = np.add.reduceat(x[order], starts, axis=0) / np.diff(np.append(starts, len(x)))[:, None]
    return centres


def fit(x: np.ndarray, cells: int, books: int = BOOKS, entries: int = ENTRIES, rounds: int = 6, seed: int = 7) -> Codebooks:
    """Codebooks for unit vectors: each fitted to what the ones before leave over."""
    random = np.random.default_rng(seed)
    first = _centres(x, cells, rounds, random)
    left = x - first[_nearest(x, first)]
    rest = []
    for _ in range(books):
        rest.append(_centres(left, entries, rounds, random))
        left = left - rest[-1][_nearest(left, rest[-1])]
    return Codebooks(first, np.stack(rest))


def usable(vectors: DataFrame, key: str = "id", vector: str = "embedding", dims: int = 64) -> DataFrame:
    """``id`` and ``vector`` (array of float) of the rows that take part, once each."""
    v = F.col("vector")
    rows = vectors.select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("vector"))
    sound = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col("id").isNotNull() & sound)


def _matrix(column, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float32).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    wide = x.astype(np.float64)
    wide /= np.abs(wide).max(1, keepdims=True)  # no square of a huge or tiny number
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


@dataclass
class Index:
    """``firsts``: the k + 1 smallest ids of each class of equal vectors; ``coded``: id, vector, codes and cells of classes."""

    members: DataFrame
    firsts: DataFrame
    coded: DataFrame
    books: Codebooks | None
    dims: int


def build(vectors: DataFrame, k: int = 5, dims: int = 64, sample: int = SAMPLE, shares: int = SHARES) -> Index:
    """Classes of equal vectors, codebooks, and a code for every class."""
    rows = usable(vectors, dims=dims)
    # two hashes of the whole vector name its class
    named = rows.select("id", "vector", F.xxhash64("vector").alias("a"), F.xxhash64(F.reverse("vector"), F.lit(1)).alias("b"))
    # the window keeps k + 1 rows of a class in each task before anything moves
    order = Window.partitionBy("a", "b").orderBy("id")
    firsts = materialise(named.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k + 1).dropDuplicates(["a", "b", "rank"]), "classes")
    reps = firsts.where("rank = 1").select("id", "vector")
    n = reps.count()
    if not n:
        return Index(named.select("id", "a", "b"), firsts, reps, None, dims)
    share = min(1.0, sample / n)
    fitted_on = reps if share == 1 else reps.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
    cells = max(1, min(n, MOST_CELLS, int(2 * math.sqrt(n))))
    x = _unit(_matrix(fitted_on.select("vector").toArrow()["vector"], dims))
    books = fit(x, cells, entries=min(ENTRIES, max(BEAM, len(x))))
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(_matrix(batch["vector"], dims))
            for at in range(0, len(unit), 2048):
                part = unit[at : at + 2048]
                codes, norms, along = sent.value.encode(part)
                near = sent.value.cells(part, shares)
                ends = np.arange(len(part) + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(at, len(part)), binary(part, ends * dims), binary(codes, ends * codes.shape[1]), pa.array(norms), pa.array(along), binary(near, ends * near.shape[1])],
                    names=["id", "unit", "codes", "norm", "along", "near"],
                )

    coded = reps.mapInArrow(encode, "id string, unit binary, codes binary, norm float, along float, near binary")
    return Index(named.select("id", "a", "b"), firsts, coded, books, dims)


def _top(approx: np.ndarray, keep: int) -> np.ndarray:
    """For each row the places of its ``keep`` highest values."""
    keep = min(keep, approx.shape[1])
    return np.argpartition(-approx, keep - 1, axis=1)[:, :keep]


def _best(of: np.ndarray, s: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Which pairs are among the ``k`` of the highest ``s`` of their ``of``, smaller ``tie`` first."""
    order = np.lexsort((tie, -s, of))
    first = np.concatenate(([True], of[order][1:] != of[order][:-1])) if len(order) else np.zeros(0, bool)
    place = np.arange(len(order)) - np.repeat(np.flatnonzero(first), np.diff(np.append(np.flatnonzero(first), len(order))))
    keep = np.zeros(len(of), bool)
    keep[order[place < k]] = True
    return keep


def _compare(books, dims: int, k: int, least: float, slack: float):
    """Compares the vectors of one block of a cell with those of another (or the same).

    What leaves are the pairs among the k best of either end, ties to the smaller id.
    """

    def run(table: pa.Table) -> pa.Table:
        unit = unpack(table["unit"], np.float32)[0].reshape(-1, dims)
        codes = unpack(table["codes"], np.int32)[0].reshape(len(unit), -1)
        along = np.asarray(table["along"])
        side = np.asarray(table["side"])
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        ids = table["id"].combine_chunks()
        place = np.empty(len(ids), np.int64)
        place[np.asarray(pa.compute.sort_indices(ids))] = np.arange(len(ids))
        a, b, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        step = max(16, min(512, (1 << 21) // max(1, len(right))))
        for at in range(0, len(left), step):
            rows = left[at : at + step]
            approx = books.value.scores(unit[rows], codes[right], along[right])
            i, j = np.nonzero(approx >= least - slack)
            # exact reranking of what the tables let through, in pieces of 32 MB
            exact = np.concatenate([np.einsum("nd,nd->n", unit[rows[i[p : p + 65_536]]].astype(np.float64), unit[right[j[p : p + 65_536]]]) for p in range(0, max(1, len(i)), 65_536)])
            i, j = rows[i], right[j]
            good = (exact >= least) & (i != j)
            i, j, exact = i[good], j[good], exact[good]
            mine = _best(i, exact, place[j], k)
            if not mine.all():
                # of what isn't among a left vector's best, each right one keeps its best
                theirs = _best(j, exact, place[i], k)
                i, j, exact = i[mine | theirs], j[mine | theirs], exact[mine | theirs]
            a, b, s = np.append(a, i), np.append(b, j), np.append(s, exact)
            if len(a) > 4 * k * len(ids):
                keep = _best(a, s, place[b], k) | _best(b, s, place[a], k)
                a, b, s = a[keep], b[keep], s[keep]
        if len(a):
            keep = _best(a, s, place[b], k) | _best(b, s, place[a], k)
            a, b, s = a[keep], b[keep], s[keep]
        return pa.table([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(s, pa.float64())], names=["id", "other", "similarity"])

    return run


def near_classes(index: Index, k: int = 5, least: float = 0.9, slack: float = 0.15, block: int = BLOCK) -> DataFrame:
    """``id``, ``other``, ``similarity``: for each class the up to k most similar other classes with at least ``least``."""
    spark = index.coded.sparkSession
    coded = index.coded
    sent = spark.sparkContext.broadcast(index.books)

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, at = unpack(batch["near"], np.int32)
            row = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(at)))
            yield pa.RecordBatch.from_arrays([pa.array(near), *(batch[c].take(row) for c in ("id", "unit", "codes", "along"))], names=["cell", "id", "unit", "codes", "along"])

    spread = materialise(coded.mapInArrow(cells_of, "cell int, id string, unit binary, codes binary, along float"), "cells")
    # a row for each cell, at most as many as the first codebook has entries
    blocks = spread.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = spread.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    # block i meets block j once, with i <= j: as the left side (1), the right (2) or both (0)
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("partner")
    met = placed.select("*", others).select(
        "cell", F.least("block", "partner").alias("i"), F.greatest("block", "partner").alias("j"),
        F.when(F.col("block") == F.col("partner"), 0).when(F.col("block") < F.col("partner"), 1).otherwise(2).alias("side"), "id", "unit", "codes", "along",
    )
    found = met.groupBy("cell", "i", "j").applyInArrow(_compare(sent, index.dims, k, least, slack), "id string, other string, similarity double")
    pairs = found.select(F.explode(F.array(F.struct("id", "other", "similarity"), F.struct(F.col("other").alias("id"), F.col("id").alias("other"), "similarity"))).alias("p")).select("p.*")
    pairs = pairs.groupBy("id", "other").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def near_pairs(vectors: DataFrame, k: int = 5, least: float = 0.9, dims: int = 64, shares: int = SHARES) -> DataFrame:
    """``a_id``, ``b_id``: pairs with cosine of at least ``least``, one among the k most similar of the other."""
    index = build(vectors, k, dims, shares=shares)
    members, firsts = index.members.distinct(), index.firsts
    # equal vectors: every member with the smallest other ids of its class
    inner = members.join(firsts.select("a", "b", F.col("id").alias("other")), ["a", "b"]).where("id <> other")
    close = Window.partitionBy("id").orderBy("other")
    inner = inner.withColumn("rank", F.row_number().over(close)).where(F.col("rank") <= k).select("id", "other", F.col("rank").alias("place"))
    if index.books is None:
        return inner.select(F.least("id", "other").alias("a_id"), F.greatest("id", "other").alias("b_id")).distinct()
    between = near_classes(index, k, least)
    # other classes: the smallest ids of each near class, for members whose own class leaves room
    names = firsts.select("a", "b", "id", "rank")
    rep = names.where("rank = 1").select("a", "b", F.col("id").alias("rep"))
    sizes = firsts.groupBy("a", "b").agg(F.count(F.lit(1)).alias("size"))
    of_class = between.join(rep.withColumnRenamed("rep", "id"), "id").select("a", "b", F.col("other").alias("other_rep"), "similarity")
    other_ids = names.join(rep, ["a", "b"]).select(F.col("rep").alias("other_rep"), F.col("id").alias("other"))
    offered = of_class.join(other_ids, "other_rep").join(sizes, ["a", "b"]).where(F.col("size") <= k)
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("similarity"), "other"))
    taken = offered.withColumn("place", place + F.col("size") - 1).where(F.col("place") <= k).select("a", "b", "other")
    outer = names.select("a", "b", "id").join(taken, ["a", "b"]).select("id", "other")
    both = inner.select("id", "other").unionByName(outer)
    return both.select(F.least("id", "other").alias("a_id"), F.greatest("id", "other").alias("b_id")).distinct()


def _scan(books, dims: int, k: int, wide: int):
    """Scores one shard of the index for all queries in it by tables, and reranks the best exactly."""

    def run(queries: pa.Table, shard: pa.Table) -> pa.Table:
        q = unpack(queries["unit"], np.float32)[0].reshape(-1, dims)
        unit = unpack(shard["unit"], np.float32)[0].reshape(-1, dims)
        codes = unpack(shard["codes"], np.int32)[0].reshape(len(unit), -1) if len(unit) else np.zeros((0, 1), np.int32)
        norms = np.asarray(shard["norm"])
        a, b, s = [], [], []
        for at in range(0, len(q) if len(unit) else 0, 256):
            part = q[at : at + 256]
            best = _top(books.value.scores(part, codes, norms), wide)
            exact = np.einsum("qd,qwd->qw", part.astype(np.float64), unit[best])
            # some more than k, as a query finds itself and ties go by id
            first = _top(exact, 4 * (k + 1))
            best, exact = np.take_along_axis(best, first, 1), np.take_along_axis(exact, first, 1)
            a.append(np.repeat(np.arange(at, at + len(part)), best.shape[1])), b.append(best.ravel()), s.append(exact.ravel())
        a, b, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, s))
        return pa.table([queries["id"].combine_chunks().take(pa.array(a)), shard["id"].combine_chunks().take(pa.array(b)), pa.array(s, pa.float64())], names=["id", "other", "similarity"])

    return run


def search(vectors: DataFrame, is_query, k: int = 5, dims: int = 64, wide: int = 256, shard_rows: int = 20_000, query_rows: int = QUERIES) -> DataFrame:
    """``id``, ``other``, ``similarity`` and ``rank``: the k most similar vectors for each of the stated queries.

    ``is_query`` is a condition on ``id`` that states the query set. Each query
    is looked for by its class: every shard of the index is scored for each block
    of the classes asked for from tables, its ``wide`` best for each are reranked
    exactly, its k best leave the task, and the k best classes of all shards
    remain. A query's own copies come first, by smallest id, then the members of
    those classes.
    """
    index = build(vectors, k, dims)
    spark = vectors.sparkSession
    if index.books is None:
        return index.firsts.select("id", F.col("id").alias("other"), F.lit(0.0).alias("similarity"), F.lit(1).alias("rank")).limit(0)
    queries = materialise(index.members.where(is_query).distinct(), "queries")
    # a row for each class asked for, with its k + 1 smallest ids
    classes = index.firsts.join(queries.select("a", "b").distinct(), ["a", "b"], "left_semi").groupBy("a", "b").agg(F.array_sort(F.collect_list("id")).alias("own"))
    classes = materialise(classes.withColumn("rep", F.col("own")[0]), "query_classes")
    coded = materialise(index.coded.drop("near", "along"), "coded")
    shards = max(1, math.ceil(coded.count() / shard_rows))
    blocks = max(1, math.ceil(classes.count() / query_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kept = coded.select("id", "unit", "codes", "norm", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(shards)).cast("int").alias("of_shard"), every(blocks).alias("of_block"))
    asked = coded.join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("id"), F.col("unit").alias("unit"), F.pmod(F.xxhash64("id", F.lit(6)), F.lit(blocks)).cast("int").alias("block"), every(shards).alias("shard"))
    sent = spark.sparkContext.broadcast(index.books)
    found = asked.groupBy("shard", "block").cogroup(kept.groupBy("of_shard", "of_block")).applyInArrow(_scan(sent, dims, k, wide), "id string, other string, similarity double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    between = found.where("id <> other").withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("id").alias("rep"), F.col("other").alias("near"), "similarity")
    # the smallest ids of each near class; k of them all are enough for any query
    firsts = index.firsts.where(F.col("rank") <= k).select("a", "b", "id", "rank")
    named = firsts.where("rank = 1").select("a", "b", F.col("id").alias("near")).join(firsts.select("a", "b", F.col("id").alias("other")), ["a", "b"]).select("near", "other")
    place = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("similarity"), "other"))
    nearest = between.join(named, "near").withColumn("place", place).where(F.col("place") <= k)
    others = nearest.groupBy("rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "other", "similarity"))), lambda x: F.struct(x["other"].alias("other"), x["similarity"].alias("similarity"))).alias("others"))
    each = queries.join(classes.join(others, "rep", "left"), ["a", "b"])
    copies = F.transform(F.filter("own", lambda x: x != F.col("id")), lambda x: F.struct(x.alias("other"), F.lit(1.0).alias("similarity")))
    both = F.slice(F.concat(copies, F.coalesce("others", F.array().cast("array<struct<other: string, similarity: double>>"))), 1, k)
    return each.select("id", F.posexplode(both).alias("at", "n")).select("id", "n.other", "n.similarity", (F.col("at") + 1).alias("rank"))
