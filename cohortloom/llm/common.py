"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of one Arrow batch that are turned into Python objects at a time.
SLICE = 256


#: By module, how a worker lets go of what it keeps from one of that module's tasks to the next.
_keeps: dict[str, Callable[[], None]] = {}
#: The module that this worker served last.
_served: str | None = None


def keeps(module: str, drop: Callable[[], None]) -> None:
    """Tasks of ``module`` keep tables in their worker; ``drop`` empties them."""
    _keeps[module] = drop


def serve(module: str) -> None:
    """A task of ``module`` starts: a worker that served another one gives its memory back.

    Workers outlive stages, so the tables of every stage would add up in each of them.
    """
    global _served
    if _served not in (None, module):
        _keeps.get(_served, lambda: None)()
        gc.collect()  # coders and their memos refer to each other
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)
    _served = module


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of few rows, so that long texts stay bounded."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column; null counts as the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def typed(df: DataFrame, name: str) -> str:
    """The column as an entry of a schema string."""
    return f"`{name}` {df.schema[name].dataType.simpleString()}"


def map_slices(df: DataFrame, task: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
               schema: str) -> DataFrame:
    """Run ``task()`` once per partition and its result on every slice of rows."""
    module = task.__module__

    def run(batches):
        serve(module)
        step = task()
        for part in slices(batches):
            yield step(part)

    return df.mapInArrow(run, schema)


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, lengthened until no column is called so (in any case)."""
    used = {c.lower() for c in taken}
    while wanted.lower() in used:
        wanted += "_"
    return wanted
