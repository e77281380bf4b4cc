"""Small helpers for Arrow columns inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401


def plain(column) -> pa.Array:
    """One contiguous array of a column that may be chunked."""
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one uint32 array of code points, with n + 1 offsets.

    A null counts as an empty text. No per-row string call is made: the UTF-8
    buffer is decoded once.
    """
    texts = plain(texts).fill_null("")
    lengths = np.asarray(pa.compute.utf8_length(texts)).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    if not len(texts) or not offsets[-1]:
        return np.zeros(0, np.uint32), offsets
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    text = data.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes().decode("utf-8")
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), offsets


def strings(points: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The inverse of ``code_points``."""
    points = np.ascontiguousarray(points, np.uint32)
    data = points.tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    ends = np.concatenate(([0], np.cumsum(width)))[np.asarray(offsets)]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data)).cast(pa.string())


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of bytes: row i holds ``data[offsets[i]:offsets[i + 1]]``."""
    data = np.ascontiguousarray(data)
    at = (np.asarray(offsets) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])


def unpack(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """Values and n + 1 offsets of a binary column written by ``binary``."""
    column = plain(column)
    size = np.dtype(kind).itemsize
    if not len(column):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = b"" if data is None else data.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes()
    return np.frombuffer(raw, kind), (at - at[0]) // size


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges ``starts[i] .. starts[i] + lengths[i]``."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and n + 1 offsets."""
    return pa.ListArray.from_arrays(pa.array(np.asarray(offsets), pa.int32()), pa.array(values, kind))
