"""A table of counts with a fixed number of cells, summed over all rows of a frame."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_PAGE = 4096


def counted(rows: DataFrame, cells_of: Callable, size: int) -> np.ndarray:
    """How often each of size cells comes up: cells_of(batch) yields arrays of cells.

    Tasks send pages of counts, never rows; pages meet by number, so the driver gets size numbers.
    """

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for cells in cells_of(batch):
                total += np.bincount(cells, minlength=size)
        pages = total.reshape(-1, _PAGE)
        yield pack({int(p): pages[p] for p in np.flatnonzero(pages.any(axis=1))})

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for page, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                now = np.frombuffer(counts, np.int64)
                held[page] = held[page] + now if page in held else now
        yield pack(held)

    def pack(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([c.tobytes() for c in held.values()], pa.binary())], ["page", "counts"])

    shape = "page int, counts binary"
    out = np.zeros((size // _PAGE, _PAGE), np.int64)
    for row in rows.mapInArrow(count, shape).repartition("page").mapInArrow(merge, shape).collect():
        out[row["page"]] = np.frombuffer(row["counts"], np.int64)
    return out.reshape(-1)
