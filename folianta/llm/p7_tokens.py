"""Problem 7: the token ids of every document by a public byte-level BPE.

Method: a global shuffle of distinct words. Texts are cut into pre-tokens with
their positions; a block of documents keeps, for each document, the sequence of
its pre-tokens (position by position, as codes of the block), and each word of
the block is one row. Every distinct word of the corpus is encoded exactly once,
its ids are joined back to the (block, code) rows that use it, and each block
reassembles its documents by position. What moves is one row per block and
distinct word, never one per occurrence, so the commonest word costs one small
row per block instead of a skewed partition.

Nulls and empty texts have the empty list of ids; decoded with ``keep``, a null
is null again. Exact copies of a row count once; rows that share an id but not
the text all stay, each with its own ids and its own text when decoded.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import materialise
from .arrow import binary, lists, ragged, unpack

#: Fixed value: the pattern of the rank files, as published with them.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

TOKENIZERS = "/opt/tokenizers"
BLOCK_ROWS = 4096

_loaded: dict[str, object] = {}


def ranks(path: str) -> dict[bytes, int]:
    """The byte strings of a rank file with their ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def tokenizer(path: str):
    """The tokenizer of a rank file, loaded once in a Python worker."""
    if path not in _loaded:
        import tiktoken

        _loaded[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})
    return _loaded[path]


def rank_file(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    return f"{folder}/{name}.tiktoken"


def _pretokens(block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(PATTERN).findall
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                vocabulary: defaultdict[str, int] = defaultdict()
                vocabulary.default_factory = vocabulary.__len__
                code = vocabulary.__getitem__
                codes, ends = [], [0]
                for text in part["text"].to_pylist():
                    if text:
                        codes.extend(map(code, find(text)))
                    ends.append(len(codes))
                flat = np.array(codes, np.uint16 if len(vocabulary) <= 0xFFFF else np.uint32)
                n, words = part.num_rows, len(vocabulary)
                size = pa.array(np.full(n, flat.itemsize, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, number)), part["doc_id"], part["text_key"], size, binary(flat, np.array(ends)), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32())],
                    names=["block", "doc_id", "text_key", "width", "codes", "word", "code"],
                )
                if words:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(words, number)), pa.nulls(words, pa.int64()), pa.nulls(words, pa.int64()), pa.nulls(words, pa.int32()), pa.nulls(words, pa.binary()), pa.array(list(vocabulary), pa.string()), pa.array(np.arange(words, dtype=np.int32))],
                        names=["block", "doc_id", "text_key", "width", "codes", "word", "code"],
                    )
                number += 1

    return run


def _encode_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        for batch in batches:
            ids = [encode(word) for word in batch["word"].to_pylist()]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64)))
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([batch["word"], binary(flat, ends)], names=["word", "ids"])

    return run


def _assemble(documents: pa.Table, words: pa.Table) -> pa.Table:
    ids, ends = unpack(words["ids"], np.int32)
    starts = np.zeros(len(ends) - 1, np.int64)
    lengths = np.zeros(len(ends) - 1, np.int64)
    code = np.asarray(words["code"])
    starts[code], lengths[code] = ends[:-1], np.diff(ends)
    # the width of the codes is the same throughout a block
    width = np.asarray(documents["width"])[0] if documents.num_rows else 2
    codes, at = unpack(documents["codes"], np.uint16 if width == 2 else np.uint32)
    each = lengths[codes]
    upto = np.concatenate(([0], np.cumsum(each)))
    out = ids[ragged(starts[codes], each)]
    return pa.table([documents["doc_id"].combine_chunks(), documents["text_key"].combine_chunks(), lists(out, upto[at], pa.int32())], names=["doc_id", "text_key", "ids"])


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, block_rows: int = BLOCK_ROWS, keep: bool = False) -> DataFrame:
    """``key`` (as bigint) and ``ids`` (array of int) of each text; with ``keep`` also ``text_key``, a hash of the text (null for a null).

    Other columns of ``documents`` are ignored, whatever they are called. Null
    and empty texts get an empty list; an empty table gives an empty result.
    """
    path = path or rank_file()
    rows = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).select("doc_id", "text", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("text_key"))
    pieces = materialise(
        rows.mapInArrow(_pretokens(block_rows), "block bigint, doc_id bigint, text_key bigint, width int, codes binary, word string, code int"),
        "pretokens",
    )
    uses = pieces.where("word is not null").select(F.col("block").alias("used_in"), "code", "word")
    encoded = uses.select("word").distinct().mapInArrow(_encode_words(path), "word string, ids binary")
    # a block's documents wait for the ids of its words only
    words = uses.join(encoded, "word").select("used_in", "code", "ids")
    kept = pieces.where("codes is not null").dropDuplicates(["doc_id", "text_key"]).select("block", "doc_id", "text_key", "width", "codes")
    made = kept.groupBy("block").cogroup(words.groupBy("used_in")).applyInArrow(_assemble, "doc_id bigint, text_key bigint, ids array<int>")
    return made.select(F.col("doc_id").alias(key), *(["text_key"] if keep else []), "ids")


def token_bytes(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The table of a tokenizer: ``id`` and the ``bytes`` it stands for (as many rows as ids)."""
    table = ranks(path or rank_file())
    return spark.createDataFrame([(i, b) for b, i in table.items()], "id int, bytes binary")


def decode_corpus(encoded: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """``key`` and ``text`` again: positions exploded, joined with the token-byte table, put together in order.

    A text is put together by its key and ``text_key``, so keys may repeat; one
    whose ``text_key`` is null is null. Where ``encoded`` has no ``text_key``, a
    hash of the ids stands for it. The table is broadcast: it has one short row
    for each id of the vocabulary, whatever the corpus. An empty list gives an
    empty text.
    """
    table = token_bytes(encoded.sparkSession, path)
    which = F.col("text_key") if "text_key" in encoded.columns else F.xxhash64("ids")
    rows = encoded.select(F.col(key).alias("key"), which.alias("text_key"), F.posexplode_outer("ids").alias("pos", "id"))
    joined = rows.join(F.broadcast(table), "id", "left").select("key", "text_key", "pos", F.hex("bytes").alias("hex"))
    whole = joined.groupBy("key", "text_key").agg(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "hex")))).alias("parts"))
    text = F.decode(F.unhex(F.concat_ws("", F.col("parts.hex"))), "UTF-8")
    return whole.select(F.col("key").alias(key), F.when(F.col("text_key").isNotNull(), text).alias("text"))


def token_count(text: Column, path: str | None = None) -> Column:
    """The number of tokens of a text; null and empty count 0."""
    path = path or rank_file()

    @F.arrow_udf(T.IntegerType())
    def count(column: pa.Array) -> pa.Array:
        encode = tokenizer(path).encode_ordinary
        return pa.array([len(encode(x)) if x else 0 for x in column.to_pylist()], pa.int32())

    return count(text)
