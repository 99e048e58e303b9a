"""Strings and lists of strings in Arrow batches, a bounded stretch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Whether a byte of UTF-8 is part of a token: what T.tokenize takes from text in lower case.
_PART = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))


def slices(tokens: pa.ListArray, most: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Row ends and tokens of about `most` tokens' rows at a time (a row at least); null rows have none. Strings stay in Arrow."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
    flat, a, begin = pc.list_flatten(tokens), 0, 0
    while a < len(tokens):
        b = max(int(np.searchsorted(ends, begin + most, "right")), a + 1)
        yield ends[a:b] - begin, flat.slice(begin, int(ends[b - 1]) - begin)
        a, begin = b, int(ends[b - 1])


def text_slices(texts: pa.Array, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, row ends and bytes (UTF-8) of about `most` bytes' rows at a time (a row at least); null texts have none. Bytes stay in Arrow."""
    if not len(texts):
        return
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    begin, ends, a = int(ends[0]), ends[1:], 0
    while a < len(texts):
        b = max(int(np.searchsorted(ends, begin + most, "right")), a + 1)
        yield a, ends[a:b] - begin, data[begin : int(ends[b - 1])]
        a, begin = b, int(ends[b - 1])


def cut(ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Row ends and tokens of texts in lower case, given by row ends and bytes: those of T.tokenize, which holds each as a string of its own."""
    part = _PART[data]
    begin = part.copy()
    begin[1:] &= ~part[:-1]
    first = np.concatenate([[0], ends[:-1]])
    first = first[first < len(data)]
    begin[first] = part[first]  # no token goes on in the next text
    starts = np.append(np.flatnonzero(begin[part]), int(part.sum())).astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(data[part]))
    return np.searchsorted(np.flatnonzero(begin), ends), tokens
