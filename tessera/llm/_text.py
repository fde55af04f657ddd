"""Byte-level helpers that several corpus operators share; they run inside Arrow tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
#: Bytes of 0x80 and above, and with them all non-ASCII characters of UTF-8, stay.
ALNUM = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

#: Rows of text that a task holds at once, in bytes; one longer text is still held whole.
SLICE_BYTES = 4 << 20


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(ALNUM).split()


def utf8(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as UTF-8."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of a slice are about ``limit`` bytes or a single row.

    Memory that Arrow has freed goes back to the system after each batch: workers outlive their tasks.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0))
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch, col
        pa.default_memory_pool().release_unused()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


#: The one large thing that a Python process keeps from task to task, by name.
_KEPT: dict[str, Any] = {}


def kept(name: str, make: Callable[[], Any]) -> Any:
    """What this process keeps under ``name``, made if it keeps nothing or something else.

    Workers outlive their tasks and stages: a tokenizer with its caches would stay while other stages run.
    """
    if name not in _KEPT:
        forget()
        _KEPT[name] = make()
    return _KEPT[name]


def forget() -> None:
    """Gives back what an earlier stage has left in this process; tasks that need memory for other things call it first."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # freed blocks stay with the process otherwise
        if trim:
            trim(0)
