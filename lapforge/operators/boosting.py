"""Gradient-boosted regression trees from histograms of bins.

A fit passes over its rows once a level of each tree. So rows are binned once and held as blocks of one byte a value with what is left to
explain, a pass adds up counts and sums by node and bin with numpy, and only these tables, whose size does not follow the rows, meet at the driver.
Trees grow as those of Spark ML do: squared error, at most 32 bins, the first tree on the target, each later one on twice the residual; nothing
is drawn at random. The bins follow all rows where Spark ML draws 10,000; up to that many rows both have the same.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 32
#: Up to so many values, bins follow the exact counts of a column's values; beyond, its quantiles to 1 in so many.
FEW_VALUES = 10_000
#: Rows of a block, and of a task that goes through blocks.
BLOCK, ROWS_PER_TASK = 65_536, 500_000
#: Trees after which residuals start from the target again, so that what a lost block is made from stays short.
RESTART = 20
#: Gains that differ by less of themselves, or of the sums they come from, are equal; the first column and the lowest cut win.
SAME_GAIN, NO_GAIN = 1e-9, 1e-12
UNCUT = 255


@dataclass(frozen=True)
class Tree:
    """Node k has children 2k + 1 (rows with a bin up to its cut) and 2k + 2; an uncut node has only the first. value: of the last level's nodes."""

    column: np.ndarray
    cut: np.ndarray
    value: np.ndarray


@dataclass(frozen=True)
class Boosted:
    columns: tuple[str, ...]
    edges: tuple[np.ndarray, ...]
    trees: tuple[Tree, ...]
    rate: float
    importances: tuple[float, ...]
    train_rmse: float

    def predicted(self) -> Column:
        edges, trees, rate = self.edges, self.trees, self.rate

        @F.pandas_udf("double")
        def predict(values: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for some in values:
                bins = binned([s.to_numpy() for s in some], edges)
                yield pd.Series(value_of(bins, trees[0]) + rate * sum(value_of(bins, t) for t in trees[1:]))

        return predict(*[F.col(c).cast("double") for c in self.columns])


def binned(values: Sequence[np.ndarray], edges: Sequence[np.ndarray]) -> np.ndarray:
    """One row a column: how many edges lie below each value."""
    return np.stack([np.searchsorted(e, v, side="left").astype(np.uint8) for v, e in zip(values, edges, strict=True)])


def node_of(bins: np.ndarray, column: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Each row's place among the nodes of a level."""
    node = np.zeros(bins.shape[1], np.uint8 if levels <= 8 else np.uint32)
    for level in range(levels):
        right = np.zeros(len(node), bool)
        for k in range(2**level):
            at = 2**level - 1 + k
            if cut[at] != UNCUT:
                right |= (node == k) & (bins[column[at]] > cut[at])
        node = node * 2 + right
    return node


def value_of(bins: np.ndarray, tree: Tree) -> np.ndarray:
    return tree.value[node_of(bins, tree.column, tree.cut, len(tree.value).bit_length() - 1)]


def bin_edges(rows: DataFrame, n: int) -> list[np.ndarray]:
    """Up to 31 edges a column: halfway between neighbours where it has few values, else the values at the quantiles. rows: columns of doubles."""
    bins, columns = min(BINS, n), rows.columns
    wide = []
    if n > FEW_VALUES:
        kinds = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
        wide = [c for c in columns if kinds[c] > FEW_VALUES]
    found = {}
    if wide:
        shares = [i / bins for i in range(1, bins)]
        quantiles = rows.agg(*[F.percentile_approx(c, shares, FEW_VALUES).alias(c) for c in wide]).first()
        found = {c: np.unique(quantiles[c]) for c in wide}
    few = [c for c in columns if c not in found]
    counts = {c: [] for c in few}
    if few:
        for r in rows.unpivot([], few, "c", "v").groupBy("c", "v").count().collect():
            counts[r["c"]].append((r["v"], r["count"]))
    return [found[c] if c in found else _halfway(sorted(counts[c]), n, bins) for c in columns]


def _halfway(counts: list[tuple[float, int]], n: int, bins: int) -> np.ndarray:
    """Edges between values: all of them, or those nearest to equal numbers of rows a bin."""
    values = np.array([v for v, _ in counts])
    between = (values[:-1] + values[1:]) / 2
    if len(between) < bins:
        return between
    edges, seen, target = [], counts[0][1], n / bins
    for i in range(1, len(counts)):
        before, seen = seen, seen + counts[i][1]
        if abs(before - target) < abs(seen - target):
            edges.append(between[i - 1])
            target += n / bins
    return np.array(edges)


def _blocks(rows: DataFrame, edges: Sequence[np.ndarray]):
    """An RDD of (bins, target), the target being the last column of rows."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block() -> pa.RecordBatch:
            *x, y = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(len(edges) + 1))
            return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (binned(x, edges), y)], ["bins", "target"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK:
                yield block()
                held, n = [], 0
        if n:
            yield block()

    width = len(edges)
    packed = rows.mapInArrow(pack, "bins binary, target binary").rdd
    return packed.map(lambda r: (np.frombuffer(r["bins"], np.uint8).reshape(width, -1), np.frombuffer(r["target"])))


def _less(block: tuple[np.ndarray, np.ndarray], trees: Sequence[Tree], first: bool, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """The block with what the trees leave to explain; first: they begin with the one of the target itself."""
    bins, rest = block
    if first:
        rest, trees = 2 * (rest - value_of(bins, trees[0])), trees[1:]
    for tree in trees:
        rest = rest - 2 * rate * value_of(bins, tree)
    return bins, rest


def _tables(blocks: Iterable[tuple[np.ndarray, np.ndarray]], column: np.ndarray, cut: np.ndarray, level: int) -> Iterator[np.ndarray]:
    """Counts and sums of a part's rows by column, node of the level and bin."""
    total, size = None, BINS << level
    for bins, rest in blocks:
        node = node_of(bins, column, cut, level).astype(np.intp) * BINS
        if total is None:
            total = np.zeros((2, len(bins), size))
        for j, b in enumerate(bins):
            at = node + b
            total[0, j] += np.bincount(at, minlength=size)
            total[1, j] += np.bincount(at, rest, size)
    if total is not None:
        yield total.reshape(2, total.shape[1], -1, BINS)


def _added(parts) -> np.ndarray:
    """Tables of a few parts are added up at the driver, those of many by tasks first."""
    return parts.treeReduce(np.add, depth=1 if parts.getNumPartitions() <= 64 else 2)


def best_cuts(tables: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(column, cut, gain, and counts and sums of the two children) of each node."""
    n, s = tables.cumsum(axis=3)
    all_n, all_s = n[:1, :, -1:], s[:1, :, -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        parted = s**2 / n + (all_s - s) ** 2 / (all_n - n)
        whole = np.where(all_n > 0, all_s**2 / all_n, 0.0)
    gain = np.where((n > 0) & (n < all_n), parted - whole, -np.inf)
    flat = gain.transpose(1, 0, 2).reshape(gain.shape[1], -1)
    top, least = flat.max(axis=1), NO_GAIN * np.abs(whole[0, :, 0])
    chosen = np.argmax(flat >= (top - SAME_GAIN * np.abs(top) - least)[:, None], axis=1)
    column, cut = np.divmod(chosen, BINS)
    node = np.arange(len(column))
    own = top > least
    left = [np.where(own, t[column, node, cut], a[0, :, 0]) for t, a in ((n, all_n), (s, all_s))]
    children = [np.stack([x, a[0, :, 0] - x], axis=1).ravel() for x, a in zip(left, (all_n, all_s), strict=True)]
    return column, np.where(own, cut, UNCUT), np.where(own, flat[node, chosen], 0.0), *children


def fit(rows: DataFrame, columns: Sequence[str], target: str = "lap_time", trees: int = 100, depth: int = 5, rate: float = 0.1) -> Boosted | None:
    """Trees for the target over rows whose columns and target are all known; None without rows. rows is read several times: keep what is dear to compute."""
    spark = rows.sparkSession
    known = rows.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)], F.col(target).cast("double").alias("y"))
    n = known.count()
    if not n:
        return None
    edges = bin_edges(known.drop("y"), n)
    parts = max(-(-n // ROWS_PER_TASK), min(spark.sparkContext.defaultParallelism, -(-n // BLOCK)))
    level = StorageLevel.MEMORY_AND_DISK
    start = _blocks(known.coalesce(parts), edges).persist(level)
    now, grown, gains = start, [], np.zeros(len(columns))
    try:
        for t in range(trees):
            if t:
                again = t % RESTART == 0
                done, first = (list(grown), True) if again or t == 1 else (grown[-1:], False)
                before, now = now, (start if again else now).map(lambda b, done=done, first=first: _less(b, done, first, rate)).persist(level)
            column, cut = np.zeros(2**depth - 1, int), np.full(2**depth - 1, UNCUT)
            for k in range(depth):
                tables = _added(now.mapPartitions(lambda b, column=column, cut=cut, k=k: _tables(b, column, cut, k)))
                if t and k == 0 and before is not start:
                    before.unpersist()
                nodes = slice(2**k - 1, 2 ** (k + 1) - 1)
                column[nodes], cut[nodes], gain, count, total = best_cuts(tables)
                np.add.at(gains, column[nodes], gain)
            grown.append(Tree(column.astype(np.uint16), cut.astype(np.uint8), np.divide(total, count, out=np.zeros(len(total)), where=count > 0)))
        last = grown[-1:] if trees > 1 else grown
        squares = now.map(lambda b: float((_less(b, last, trees == 1, rate)[1] ** 2).sum())).sum()
    finally:
        for held in {start, now}:
            held.unpersist()
    shares = gains / gains.sum() if gains.sum() > 0 else gains
    return Boosted(tuple(columns), tuple(edges), tuple(grown), rate, tuple(map(float, shares)), float(np.sqrt(squares / 4 / n)))
