"""A bit table of fixed size over 64-bit values: small enough to broadcast at any scale.

A value that was put in always passes; the fuller the table, the more others pass too. Callers join
exactly afterwards, so the table only saves work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lapforge.llm.textkit import U64

BITS = 1 << 25
_PAGE = 4096


def _place(values: np.ndarray) -> np.ndarray:
    return (values.view(U64) & U64(BITS - 1)).astype(np.int64)


def build(values: DataFrame) -> np.ndarray:
    """The packed table of a one-column bigint frame of hashes: BITS bits."""

    def run(batches):
        bits = np.zeros(BITS, bool)
        for batch in batches:
            bits[_place(batch.column(0).to_numpy())] = True
        packed = np.packbits(bits).reshape(-1, _PAGE)
        full = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([packed[i].tobytes() for i in full], pa.binary())], ["page", "bits"])

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for page, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                now = np.frombuffer(bits, np.uint8)
                held[page] = now | held[page] if page in held else now
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([b.tobytes() for b in held.values()], pa.binary())], ["page", "bits"])

    out = np.zeros((BITS // 8 // _PAGE, _PAGE), np.uint8)
    pages = values.mapInArrow(run, "page int, bits binary").repartition("page")
    for row in pages.mapInArrow(merge, "page int, bits binary").collect():  # BITS bits at most
        out[row["page"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def may_hold(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values may have been put in."""
    at = _place(values)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
