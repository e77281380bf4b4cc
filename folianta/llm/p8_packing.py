"""Problem 8: texts packed into containers of one fixed capacity.

Method: cost-balanced packing. A text costs its length plus its length squared
over the capacity (linear work and attention). Texts are taken longest first,
and each goes to the container with the lowest cost so far that has room for it;
as many containers stand open as the tokens need, and another is opened only
where a text fits in none. A text longer than a container is cut into full
containers and a rest; no other text is split.

Only ids and sizes move. Rounds of packing run in shards of at most
``SHARD_ROWS`` pieces, chosen by a hash, so each shard has the same mixture of
sizes; the pieces of containers that stay below ``FULL`` are put together from
all shards and packed again, until one shard holds what is left. A round that
fills no container is repeated with half as many, larger shards; if nothing is
gained in shards of ``MOST_ROWS`` pieces either, what is left doesn't fit together.

Null and empty texts have size 0, are whole and take a place in a container
without using it. Exact copies of a row count once. An empty table gives an
empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialise
from .p7_tokens import token_count

CAPACITY = 2048
SHARD_ROWS = 16_384
#: The most pieces of one shard: about 2 MB of ids and sizes in a task.
MOST_ROWS = 65_536
FULL = 0.98


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each piece, numbered from 0: longest first, to the cheapest container with room."""
    total = int(sizes.sum())
    open_ = max(1, math.ceil(total / capacity))
    room = np.full(open_, capacity, np.int64)
    cost = np.zeros(open_)
    place = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        at = int(np.where(room >= n, cost, np.inf).argmin())
        if room[at] < n:
            at = len(room)
            room, cost = np.append(room, capacity), np.append(cost, 0.0)
        room[at] -= n
        cost[at] += n + n * n / capacity
        place[i] = at
    return place


def _pack_shard(capacity: int, round_no: int):
    def run(table: pa.Table) -> pa.Table:
        # a fixed order makes a repeated task give the same containers
        table = table.sort_by([("n_tokens", "descending"), ("item", "ascending"), ("piece", "ascending")])
        place = pack(np.asarray(table["n_tokens"]), capacity)
        shard = int(table["shard"][0].as_py())
        number = pa.array((round_no << 56) + (shard << 24) + place)
        return pa.table([table["item"], table["doc_id"], table["piece"], table["n_tokens"], number], names=["item", "doc_id", "piece", "n_tokens", "container"])

    return run


_SCHEMA = "item bigint, doc_id bigint, piece int, n_tokens int, container bigint"


def pieces(documents: DataFrame, capacity: int, path: str | None = None) -> DataFrame:
    """item, doc_id, piece (from 0) and n_tokens: whole texts, and the parts of those longer than ``capacity``."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sized = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("item"), token_count(F.col("text"), path).alias("size")).distinct()
    parts = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("size") / capacity).cast("int") - 1))).alias("piece")
    return sized.select("item", "doc_id", "size", parts).select("item", "doc_id", "piece", F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).cast("int").alias("n_tokens"))


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None, shard_rows: int = SHARD_ROWS, full: float = FULL) -> DataFrame:
    """doc_id, piece, first_token, n_tokens and container of every text."""
    waiting = materialise(pieces(documents, capacity, path), "pieces")
    done: list[DataFrame] = []
    round_no, left = 0, waiting.count()
    while True:
        shards = max(1, math.ceil(left / shard_rows))
        sharded = waiting.withColumn("shard", F.pmod(F.xxhash64("item", "piece", F.lit(round_no)), F.lit(shards)).cast("int"))
        packed = materialise(sharded.groupBy("shard").applyInArrow(_pack_shard(capacity, round_no), _SCHEMA), "packed")
        if shards == 1:
            done.append(packed)
            break
        filled = packed.groupBy("container").agg((F.sum("n_tokens") >= full * capacity).alias("full"))
        marked = packed.join(filled, "container")
        again = materialise(marked.where("not full").drop("container", "full"), "pieces")
        still = again.count()
        if still == left:
            # larger shards offer each piece more partners
            if shard_rows >= MOST_ROWS:
                done.append(packed)
                break
            shard_rows *= 2
        else:
            done.append(marked.where("full").select(packed.columns))
            if not still:
                break
        waiting, left, round_no = again, still, round_no + 1
    all_ = done[0]
    for more in done[1:]:
        all_ = all_.unionByName(more)
    return all_.select("doc_id", "piece", (F.col("piece") * capacity).cast("int").alias("first_token"), "n_tokens", "container")


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """For each container: the ``texts`` (or parts) in it, its ``n_tokens``, ``fill`` (0 to 1) and ``cost``."""
    n = F.col("n_tokens")
    return packed.groupBy("container").agg(
        F.count(F.lit(1)).alias("texts"), F.sum("n_tokens").alias("n_tokens"), F.round(F.sum("n_tokens") / capacity, 6).alias("fill"), F.round(F.sum(n + n * n / capacity), 3).alias("cost")
    )
