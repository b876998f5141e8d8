"""Embedding whitening by a tall-skinny QR: no covariance matrix of the embeddings is ever formed.

Entries become whole numbers x = floor(256 * entry). The fit list is each distinct x vector once. Sums per
dimension are exact whole numbers, so n * x - S is exact too and a centred entry (n * x - S) / n is rounded
once. Every partition folds its centred rows into one triangular factor R by QR, batch by batch; R factors
are stacked and factored again FAN_IN at a time over shuffles until one is left. Its singular values s and
right vectors v are those of the whole centred list: eigenvalues of the covariance are s^2 / n, and
(x - S / n) . v / (s / sqrt(n)) is whitened.

The driver holds one d x d factor, the sums and up to `keep` vectors; tasks hold one factor and one batch.

Defined cases: a row is dropped when its vector is null or empty, holds null, NaN or infinite entries, or has
another length than most valid vectors (of equally common lengths the smallest counts); an entry so large that
x is no long drops its row too; a direction without variance has no component (one distinct vector: no
rows at all); equal eigenvalues may come in any basis of their space; the sign makes a component's largest
entry positive; a deviation above the largest long is null; repeated rows and ids repeat their results but
count once in the fit list if their x are equal; a null vec_id stays null; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapforge.llm.storage import written

SCALE = 256
KEEP = 4
FAN_IN = 16
_LONG = 2**63 - 1
OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whole_vectors(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x (array of bigint) of every row with a usable vector; native expressions only."""
    entry = F.col("__v")
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("__v"))
    limit = 2.0**63 / SCALE
    usable = F.size(entry) > 0
    usable &= F.forall(entry, lambda c: F.coalesce((c > -limit) & (c < limit), F.lit(False)))
    return rows.filter(F.coalesce(usable, F.lit(False))).select("vec_id", F.transform(entry, lambda c: F.floor(c * SCALE).cast("bigint")).alias("x"))


def common_length(rows: DataFrame) -> int:
    """The most common vector length; 0 without rows."""
    best = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return best["d"] if best else 0


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, bool]:
    """n * x - S exactly: (matrix, whether it is int64; else of Python integers)."""
    most = int(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0)
    if most <= _LONG:
        return x * np.int64(n) - np.array(sums, np.int64), True
    return x.astype(object) * n - np.array(sums, object), False


def squared(dev: np.ndarray, small: bool) -> list[int | None]:
    """Exact sum of squares per row; None above the largest long."""
    if small and len(dev) and int(np.abs(dev).max()) ** 2 * dev.shape[1] <= _LONG:
        return (dev * dev).sum(1).tolist()
    exact = (dev.astype(object) ** 2).sum(1).tolist() if len(dev) else []
    return [v if v <= _LONG else None for v in exact]


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """(rows, sum per dimension): partial sums per task, added up by Spark as decimals; d + 1 rows come back."""

    def partial(batches):
        n, total = 0, [0] * d
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n += len(x)
            fits = int(np.abs(x).max(initial=0)) * len(x) <= _LONG
            total = [a + int(b) for a, b in zip(total, x.sum(0) if fits else x.astype(object).sum(0), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([str(v) for v in (n, *total)])], ["i", "part"])

    added = fit.mapInArrow(partial, "i int, part string").groupBy("i").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).collect()
    by_place = {r["i"]: int(r["s"]) for r in added}
    return by_place.get(-1, 0), [by_place.get(i, 0) for i in range(d)]


def _factor(stack: np.ndarray) -> np.ndarray:
    return np.linalg.qr(stack, mode="r")


def triangular_factor(fit: DataFrame, n: int, sums: list[int], fan_in: int = FAN_IN) -> np.ndarray:
    """R of the centred fit list: one factor a partition, then a tree of merges."""
    d = len(sums)

    def local(batches):
        from pyspark import TaskContext

        r = None
        for batch in batches:
            dev, _ = deviations(_matrix(batch.column(0), d), n, sums)
            centred = dev.astype(np.float64) / n
            r = _factor(centred if r is None else np.vstack([r, centred]))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["node", "r"])

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")  # the same order of factors whenever a task is run again
        parts = [np.frombuffer(b, np.float64).reshape(-1, d) for b in table.column("r").to_pylist()]
        node = table.column("node")[0].as_py() // fan_in
        return pa.table({"node": pa.array([node], pa.int64()), "r": pa.array([_factor(np.vstack(parts)).tobytes()], pa.binary())})

    factors = written(fit.mapInArrow(local, "node bigint, r binary"), "whitening_factors")
    nodes = (factors.agg(F.max("node")).first()[0] or 0) + 1
    while nodes > 1:
        factors = factors.groupBy(F.expr(f"node div {fan_in}").alias("__up")).applyInArrow(merge, "node bigint, r binary")
        nodes = -(-nodes // fan_in)
    return np.frombuffer(bytes(factors.first()["r"]), np.float64).reshape(-1, d)


def components(r: np.ndarray, n: int, rows: int, keep: int = KEEP) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, unit vectors as rows, trace) of the covariance, from R's singular values; directions without variance left out."""
    _, s, v = np.linalg.svd(r, full_matrices=False)
    trace = float((s * s).sum() / n)
    real = s > (s[0] * np.finfo(float).eps * max(rows, r.shape[1]) if len(s) else 0.0)
    s, v = s[real][:keep], v[real][:keep]
    sign = np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)]) if len(v) else np.ones(0)
    return s * s / n, v * sign[:, None], trace


def _project(dev: np.ndarray, n: int, vectors: np.ndarray, values: np.ndarray) -> np.ndarray:
    return (dev.astype(np.float64) / n) @ vectors.T / np.sqrt(values)


def identity_error(fit: DataFrame, n: int, sums: list[int], vectors: np.ndarray, values: np.ndarray) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity.

    Tasks centre by their own mean before they multiply; their means and products are joined by sums of k * k rows.
    """
    d, k = len(sums), len(values)

    def partial(batches):
        count, mean, products = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            dev, _ = deviations(_matrix(batch.column(0), d), n, sums)
            w = _project(dev, n, vectors, values)
            here, m = len(w), w.mean(0) if len(w) else mean
            step = m - mean
            products += (w - m).T @ (w - m) + np.outer(step, step) * (count * here / max(count + here, 1))
            mean = mean + step * (here / max(count + here, 1))
            count += here
        if count:
            i, j = np.divmod(np.arange(k * k), k)
            arrays = [pa.array(i), pa.array(j), pa.array(np.full(k * k, float(count))), pa.array(mean[i]), pa.array(mean[j]), pa.array(products.ravel())]
            yield pa.RecordBatch.from_arrays(arrays, ["i", "j", "c", "mi", "mj", "p"])

    parts = fit.mapInArrow(partial, "i bigint, j bigint, c double, mi double, mj double, p double")
    total = parts.groupBy("i", "j").agg(F.sum("p").alias("p"), F.sum(F.expr("c * mi * mj")).alias("mm"), F.sum(F.expr("c * mi")).alias("mi"), F.sum(F.expr("c * mj")).alias("mj"))
    cov = (F.col("p") + F.col("mm") - F.col("mi") * F.col("mj") / n) / n
    return total.select(F.max(F.abs(cov - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)))).first()[0]


def whiten(table: DataFrame, vector: str = "embedding", keep: int = KEEP, fan_in: int = FAN_IN) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per usable vector and component."""
    spark = table.sparkSession
    rows = whole_vectors(table, vector)
    d = common_length(rows)
    if not d:
        return spark.createDataFrame([], OUT)
    rows = rows.filter(F.size("x") == d)
    fit = written(rows.select("x").distinct(), "whitening_fit")
    n, sums = exact_sums(fit, d)
    values, vectors, trace = components(triangular_factor(fit, n, sums, fan_in), n, n, keep)
    if not len(values):
        return spark.createDataFrame([], OUT)
    error = identity_error(fit, n, sums, vectors, values)
    explained, k = values / trace, len(values)

    def project(batches):
        for batch in batches:
            dev, small = deviations(_matrix(batch.column(1), d), n, sums)
            rows_here, w = len(dev), _project(dev, n, vectors, values)
            row = np.repeat(np.arange(rows_here), k)
            arrays = [
                batch.column(0).take(pa.array(row)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_here)),
                pa.array(np.full(rows_here * k, n, np.int64)),
                pa.array(squared(dev, small), pa.int64()).take(pa.array(row)),
                pa.array(w.ravel()),
                pa.array(np.tile(explained, rows_here)),
                pa.array(np.full(rows_here * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in OUT.split(", ")])

    return rows.mapInArrow(project, OUT)


def query(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = None
