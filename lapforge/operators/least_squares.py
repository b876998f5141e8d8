"""Least squares with several features in native expressions: sums of products, then a sweep solve per row.

A fit needs only the sums of products of its columns (its Gram matrix), so it can be a group's sums, or running
sums of a window, or a total less a part. `solve` turns a row of sums into coefficients by the sweep operator, one
projection per feature; no Python, no collect, and as many fits as rows. A feature that depends on those before it
(pivot below TOLERANCE of its spread) has coefficient 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-10


def products(columns: Sequence[Column], target: Column) -> dict[str, Column]:
    """Name to expression of the upper triangle of the products of (1, columns, target): `g_i_j`."""
    all_ = [F.lit(1.0), *[c.cast("double") for c in columns], target.cast("double")]
    return {f"g_{i}_{j}": all_[i] * all_[j] for i in range(len(all_)) for j in range(i, len(all_))}


def sums(columns: Sequence[Column], target: Column) -> list[Column]:
    """Aggregates of the products, for groupBy().agg()."""
    return [F.sum(v).alias(k) for k, v in products(columns, target).items()]


def names(p: int) -> list[str]:
    """Names of the sums of a fit with p features."""
    return [f"g_{i}_{j}" for i in range(p + 2) for j in range(i, p + 2)]


def solve(rows: DataFrame, p: int, inverse: bool = False) -> DataFrame:
    """Replaces the sums `g_i_j` of each row by b0 (intercept), b1 to bp, rss, tss, n_rows, rank, and with
    inverse by the inverse of the centred Gram matrix, v_i_j, and the means m1 to mp.

    The centred matrix of features and target is one array, row by row; a fold over the features sweeps it, so the
    expression stays small for any p. Rows without sums or with n_rows 0 have null coefficients.
    """
    other = [c for c in rows.columns if c not in set(names(p))]
    m = p + 1
    n = F.nullif(F.col("g_0_0"), F.lit(0.0))
    centred = [F.col(f"g_{min(i, j)}_{max(i, j)}") - F.col(f"g_0_{i}") * F.col(f"g_0_{j}") / n for i in range(1, m + 1) for j in range(1, m + 1)]
    out = rows.select(
        *other,
        F.col("g_0_0").alias("__n"),
        F.array(*[F.col(f"g_0_{i}") / n for i in range(1, m + 1)]).alias("__mean"),
        F.array(*centred).alias("__start"),
        F.array(*[F.col(f"g_{i}_{i}") for i in range(1, m)]).alias("__square"),
    )

    def usable(a: Column, k: Column) -> Column:
        # spread that is left, against the column's own spread and against rounding of its sum of squares
        left, own = F.get(a, k * m + k), F.get(F.col("__start"), k * m + k)
        return F.coalesce((left > TOLERANCE * own) & (left > 1e-14 * F.get(F.col("__square"), k)), F.lit(False))

    def swept(state: Column, k: Column) -> Column:
        a = state["a"]
        pivot = F.get(a, k * m + k)

        def cell(x: Column, at: Column) -> Column:
            i, j = F.floor(at / m).cast("int"), at % m
            return (
                F.when((i == k) & (j == k), 1 / pivot)
                .when(i == k, x / pivot)
                .when(j == k, -x / pivot)
                .otherwise(x - F.get(a, i * m + k) * F.get(a, k * m + j) / pivot)
            )

        good = usable(a, k)
        return F.struct(F.when(good, F.transform(a, cell)).otherwise(a).alias("a"), F.concat(state["ok"], F.array(good)).alias("ok"))

    start = F.struct(F.col("__start").alias("a"), F.array().cast("array<boolean>").alias("ok"))
    out = out.withColumn("__end", F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), start, swept))
    known, last, ok = F.col("__n") > 0, F.col("__end.a"), F.col("__end.ok")
    slopes = {f"b{i}": F.when(known, F.when(ok[i - 1], last[(i - 1) * m + p]).otherwise(0.0)) for i in range(1, m)}
    out = out.withColumns(slopes)
    intercept = F.col("__mean")[p]
    for i in range(1, m):
        intercept = intercept - F.col(f"b{i}") * F.col("__mean")[i - 1]
    more = []
    if inverse:
        more = [F.when(known, F.when(ok[i - 1] & ok[j - 1], last[(i - 1) * m + j - 1]).otherwise(0.0)).alias(f"v_{i}_{j}") for i in range(1, m) for j in range(i, m)]
        more += [F.col("__mean")[i - 1].alias(f"m{i}") for i in range(1, m)]
    return out.select(
        *other,
        F.when(known, intercept).alias("b0"),
        *slopes,
        F.greatest(last[m * m - 1], F.lit(0.0)).alias("rss"),
        F.col("__start")[m * m - 1].alias("tss"),
        F.col("__n").cast("bigint").alias("n_rows"),
        F.size(F.filter(ok, lambda x: x)).alias("rank"),
        *more,
    )


def fitted(columns: Sequence[Column]) -> Column:
    """The prediction of a solved row for these columns."""
    value = F.col("b0")
    for i, c in enumerate(columns, 1):
        value = value + F.col(f"b{i}") * c
    return value


def leverage(columns: Sequence[Column]) -> Column:
    """Weight of an observation in its own prediction, from a row solved with inverse."""
    value = 1 / F.col("n_rows")
    for i, a in enumerate(columns, 1):
        for j, b in enumerate(columns, 1):
            value = value + (a - F.col(f"m{i}")) * (b - F.col(f"m{j}")) * F.col(f"v_{min(i, j)}_{max(i, j)}")
    return value


def residual_sql(relation: str, group: Sequence[str], columns: Sequence[str], target: str, train: str = "train") -> str:
    """CTEs q0 ... qp for checks in SQL: every row's residual, as column y of qp, of the fit over the group's rows where `train` holds.

    Columns are swept out one after the other (each is made orthogonal to those before it), which is another way to
    the same predictions. relation has the group's columns, `train` and the features.
    """
    by = f"PARTITION BY {', '.join(group)}"
    p = len(columns)
    out = [
        f"q0 AS (SELECT *, {', '.join(f'{c} - avg({c}) FILTER ({train}) OVER ({by}) AS x{i}' for i, c in enumerate(columns))}, {target} - avg({target}) FILTER ({train}) OVER ({by}) AS y FROM {relation})"
    ]
    for k in range(p):
        took = lambda c: f"{c} - CASE WHEN s{k} > 1e-9 * w{k} THEN x{k} * t_{c} / s{k} ELSE 0 END AS {c}"  # noqa: B023, E731
        rest = [*[f"x{i}" for i in range(k + 1, p)], "y"]
        scale = f"sum({columns[k]} * {columns[k]}) FILTER ({train}) OVER ({by}) - pow(sum({columns[k]}) FILTER ({train}) OVER ({by}), 2) / count(*) FILTER ({train}) OVER ({by})"
        out.append(f"m{k} AS (SELECT *, sum(x{k} * x{k}) FILTER ({train}) OVER ({by}) AS s{k}, {scale} AS w{k}, {', '.join(f'sum(x{k} * {c}) FILTER ({train}) OVER ({by}) AS t_{c}' for c in rest)} FROM q{k})")
        drop = [f"s{k}", f"w{k}", *[f"t_{c}" for c in rest]]
        out.append(f"q{k + 1} AS (SELECT * EXCLUDE ({', '.join([*rest, *drop])}), {', '.join(took(c) for c in rest)} FROM m{k})")
    return ",\n".join(out)

