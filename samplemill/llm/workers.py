"""What operators share inside Python workers: slices by bytes, caches that go when another operator comes, free names."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a column that a Python worker handles at once.
SLICE_BYTES = 4 << 20

_FORGET: dict[str, Callable[[], None]] = {}
_USED: list[str] = [""]


def byte_slices(batch: pa.RecordBatch, at: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of column ``at`` each; a longer value is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def on_change(owner: str, forget: Callable[[], None]) -> None:
    """Say how the caches of an operator are emptied."""
    _FORGET[owner] = forget


def use_caches(owner: str) -> None:
    """Python workers outlive stages: the first use of one operator's caches empties those of the one before."""
    if _USED[0] == owner:
        return
    if _USED[0] in _FORGET:
        _FORGET[_USED[0]]()
    _USED[0] = owner
    gc.collect()
    pa.default_memory_pool().release_unused()


def free_names(taken: Sequence[str], *wanted: str) -> list[str]:
    """The wanted names, longer by underscores where a table has them (names do not differ by case alone)."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
