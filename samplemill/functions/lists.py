"""Arrow list arrays inside Python workers: flat values and offsets instead of one object per row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def lists_of(flat: np.ndarray | pa.Array, sizes: np.ndarray, like: pa.Array) -> pa.Array:
    """Lists of ``sizes`` values each, NULL where ``like`` is; a NULL has no values, whatever its size says."""
    missing = like.is_null().to_numpy(zero_copy_only=False)
    if missing.any() and np.any(sizes[missing]):
        flat = np.asarray(flat)[np.repeat(~missing, sizes)]
        sizes = np.where(missing, 0, sizes)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    mask = pa.array(missing) if missing.any() else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=mask)


def list_sizes(lists: pa.Array) -> np.ndarray:
    """Values of each list; 0 for NULL."""
    offsets = lists.offsets.to_numpy()
    return np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets)).astype(np.int64)


def list_slices(lists: pa.Array, values: int) -> Iterator[pa.Array]:
    """Parts of a list array with about so many values each; a longer list is a part of its own."""
    part = np.cumsum(list_sizes(lists)) // values
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lists)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield lists.slice(a, b - a)


def character_bytes(values: pa.Array) -> np.ndarray:
    """All bytes of an array of strings or binaries in order, as a view of its buffer; NULL has none."""
    _, offsets, body = values.buffers()
    if body is None or not len(values):
        return np.zeros(0, np.uint8)
    kind = np.int64 if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else np.int32
    ends = np.frombuffer(offsets, kind, len(values) + 1, values.offset * np.dtype(kind).itemsize)
    return np.frombuffer(body, np.uint8, int(ends[-1] - ends[0]), int(ends[0]))
