"""Dense search of many queries in blocks: each shard of vectors is multiplied with each block of queries once."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a shard and queries of a block at most: a task holds some 20 MB and 40 MB of numbers, each once more in parts.
SHARD_ROWS, BLOCK_QUERIES = 40_000, 65_536


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), np.float64).reshape(-1, dims)


def _scores(k: int, dims: int):
    """The k highest products of each query with the vectors of a shard.

    Products are taken in single precision first, a stretch of the shard at a time;
    only those that come near the k-th best so far are taken again in double.
    """

    def run(queries: pa.Table, shard: pa.Table) -> pa.Table:
        # by book, so that a scope is a stretch of its own; ties go to the smaller id
        shard = shard.sort_by([("book_id", "ascending"), ("id", "ascending")]) if shard.num_rows else shard
        ids, books = shard["id"].combine_chunks(), shard["book_id"].combine_chunks()
        place = np.empty(len(ids), np.int64)
        place[np.asarray(pa.compute.sort_indices(ids))] = np.arange(len(ids))
        x, q = _matrix(shard["vector"], dims), _matrix(queries["vector"], dims)
        del shard
        single, asked = x.astype(np.float32), q.astype(np.float32)
        # what a product in single precision may be off by, and what rounding to 6 places may lift
        length = lambda m: float(np.sqrt(np.einsum("nd,nd->n", m, m)).max(initial=0))
        slack = 1e-5 + 2e-5 * length(x) * length(q)
        scopes = queries["scope"].to_pylist()
        groups: dict[str | None, list[int]] = {}
        for i, scope in enumerate(scopes):
            groups.setdefault(scope, []).append(i)
        named = books.to_pylist()
        who, what, score = [], [], []
        for scope, members in groups.items():
            start, end = 0, len(ids)
            if scope is not None:
                known = len(named) - books.null_count
                start, end = bisect.bisect_left(named, scope, 0, known), bisect.bisect_right(named, scope, 0, known)
            if start == end:
                continue
            members = np.asarray(members)
            for at in range(0, len(members), 512):
                some = members[at : at + 512]
                i, j, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                least = np.full(len(some), -np.inf, np.float32)
                for low in range(start, end, 4096):
                    high = min(low + 4096, end)
                    near = asked[some] @ single[low:high].T
                    if high - low >= k and np.isneginf(least).any():
                        least = np.maximum(least, np.partition(near, high - low - k, axis=1)[:, high - low - k] - np.float32(slack))
                    new = np.flatnonzero(near >= least[:, None])
                    a, b = new // (high - low), new % (high - low) + low
                    i, j = np.concatenate((i, a)), np.concatenate((j, b))
                    for cut in range(0, len(a), 65_536):
                        value = np.concatenate((value, np.round(np.einsum("nd,nd->n", q[some[a[cut : cut + 65_536]]], x[b[cut : cut + 65_536]]), 6)))
                    order = np.lexsort((place[j], -value, i))
                    i, j, value = i[order], j[order], value[order]
                    rank = np.arange(len(i)) - np.searchsorted(i, np.arange(len(some)))[i]
                    last = rank == k - 1
                    least[i[last]] = np.maximum(least[i[last]], (value[last] - slack).astype(np.float32))
                    kept = rank < k
                    i, j, value = i[kept], j[kept], value[kept]
                who.append(some[i]), what.append(j), score.append(value)
        flat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return pa.table(
            [queries["query_id"].combine_chunks().take(pa.array(flat(who, np.int64))), ids.take(pa.array(flat(what, np.int64))), pa.array(flat(score, np.float64))], names=["query_id", "id", "score"]
        )

    return run


def search(queries: DataFrame, vectors: DataFrame, k: int, dims: int = 64, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, id, score (to 6 places) and rank (from 1): the k highest products for each query.

    ``queries`` has query_id, scope (a book, or null) and vector; ``vectors`` has
    id, book_id and vector, normalised. Each shard keeps k rows for a query, so
    what meets in the last window is k rows for each query and shard; each block
    of queries meets each shard in a task of its own. Products may be negative; none is dropped.
    """
    rows, blocks = vectors.count(), max(1, math.ceil(queries.count() / block_queries))
    # a small table is cut so that all cores have a shard
    shards = max(1, math.ceil(rows / shard_rows), min(math.ceil(rows / 2000), math.ceil(vectors.sparkSession.sparkContext.defaultParallelism / blocks)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kept = vectors.select(*[F.col(c).alias(c) for c in ("id", "book_id", "vector")], F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("of_shard"), every(blocks).alias("of_block"))
    asked = queries.select("query_id", "scope", "vector", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), every(shards).alias("shard"))
    kind = queries.schema["query_id"].dataType.simpleString()
    id_kind = vectors.schema["id"].dataType.simpleString()
    found = asked.groupBy("shard", "block").cogroup(kept.groupBy("of_shard", "of_block")).applyInArrow(_scores(k, dims), f"query_id {kind}, id {id_kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
