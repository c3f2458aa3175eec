"""Least squares of any terms, by any key, with classical or clustered errors.

A fit is three aggregations: the terms' products by key, the scores by cluster,
their products by key.  What is solved is a row of sums a key, in Arrow batches
where the keys are, so neither rows nor keys meet on the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import Z95
from .keep import few, kept

OUT = "term string, coef double, se double, z double, ci_lo double, ci_hi double, p double"


def _square(flat, k: int) -> np.ndarray:
    """A symmetric matrix from its upper half, row by row."""
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = flat
    return m + np.triu(m, 1).T


def least_norm(gram: np.ndarray) -> np.ndarray:
    """A pseudo-inverse: of all solutions that of least norm in the terms' own units.

    Terms are scaled by powers of two to like sizes first, and what moves along
    the null space of the scaled terms is taken out in their own units."""
    k = len(gram)
    size = np.sqrt(np.maximum(np.diag(gram), 0))
    scale = np.where(size > 0, 2.0 ** np.round(np.log2(np.where(size > 0, size, 1))), 1.0)
    g = gram / np.outer(scale, scale)
    values, vectors = np.linalg.eigh(g)
    good = values > 1e-12 * max(values.max(), 0)
    inverse = (vectors[:, good] / values[good]) @ vectors[:, good].T
    null = vectors[:, ~good] / scale[:, None]
    project = np.eye(k) - null @ np.linalg.pinv(null) if null.shape[1] else np.eye(k)
    return project @ (inverse / np.outer(scale, scale)) @ project.T


def _fit(keys: int, k: int):
    def run(batches):
        for batch in batches:
            betas, inverses = [], []
            for sums in batch.column(keys + 1).to_pylist():
                inverse = least_norm(_square(sums[: k * (k + 1) // 2], k))
                betas.append((inverse @ np.array(sums[k * (k + 1) // 2 :])).tolist())
                inverses.append(inverse.ravel().tolist())
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: keys + 1], pa.array(betas, kind), pa.array(inverses, kind)], [*batch.schema.names[: keys + 1], "_beta", "_inverse"])

    return run


def _rows(keys: int, names: list[str], clustered: bool):
    def run(batches):
        k = len(names)
        for batch in batches:
            n, beta, inverse, groups, meat = (batch.column(keys + i).to_pylist() for i in range(5))
            take, out = [], []
            for i in range(batch.num_rows):
                inv = np.array(inverse[i]).reshape(k, k)
                if clustered:
                    factor = groups[i] / max(1, groups[i] - 1) * (n[i] - 1) / max(1, n[i] - k)
                    cov = factor * inv @ _square(meat[i], k) @ inv
                else:
                    cov = meat[i][0] / max(1, n[i] - k) * inv
                for name, b, v in zip(names, beta[i], np.diag(cov)):
                    e = math.sqrt(max(v, 0.0))
                    z = b / e if e > 0 else None
                    out.append((name, b, e, z, b - Z95 * e, b + Z95 * e, None if z is None else math.erfc(abs(z) / math.sqrt(2))))
                    take.append(i)
            at = pa.array(take, pa.int64())
            cols = zip(*out) if out else [[]] * 7
            kinds = [pa.string()] + [pa.float64()] * 6
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(keys + 1)), *(pa.array(c, t) for c, t in zip(cols, kinds))], [*batch.schema.names[: keys + 1], "term", "coef", "se", "z", "ci_lo", "ci_hi", "p"])

    return run


def ols(df: DataFrame, y: Column, terms: dict[str, Column], by: list[str] | None = None, cluster: str | None = None, min_n: int = 1) -> DataFrame:
    """M1: by, n, and a row a term: coef, se, z, ci_lo, ci_hi, p.

    Rows with a null y, term or cluster take no part; a fit of fewer than min_n
    rows is left out.  Errors are classical, or with `cluster` robust within its
    values (factor G/(G-1) (n-1)/(n-k)).  Terms that others give share the
    solution of least norm.  df is read twice."""
    by, k = by or [], len(terms)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    x = [f"_x{i}" for i in range(k)]
    rows = df.select(*by, *([F.col(cluster).alias("_cluster")] if cluster else []), y.cast("double").alias("_y"), *(c.cast("double").alias(n) for n, c in zip(x, terms.values())))
    rows = rows.na.drop(subset=["_y", *x, *(["_cluster"] if cluster else [])])
    half = F.array(*(F.sum(F.col(x[i]) * F.col(x[j])) for i, j in pairs), *(F.sum(F.col(c) * F.col("_y")) for c in x))
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), half.alias("_sums")).where(F.col("n") >= min_n)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*by).schema) if by else ""
    fit = sums.mapInArrow(_fit(len(by), k), f"{kinds}n bigint, _beta array<double>, _inverse array<double>")
    if by:
        fit = few(kept(fit))
        same = F.lit(True)
        for c in by:
            same = same & rows[c].eqNullSafe(fit[c])
        both = rows.join(fit, same).select(*(rows[c] for c in by), *(c for c in (*rows.columns, *fit.columns) if c not in by))
    else:
        both = rows.crossJoin(F.broadcast(fit))  # one row
    u = F.col("_y")
    for i, c in enumerate(x):
        u = u - F.col("_beta")[i] * F.col(c)
    model = [F.first(c).alias(c) for c in ("n", "_beta", "_inverse")]
    if cluster:
        scores = both.groupBy(*by, "_cluster").agg(*model, *(F.sum(F.col(c) * u).alias(c) for c in x))
        meat = F.array(*(F.sum(F.col(x[i]) * F.col(x[j])) for i, j in pairs))
        done = scores.groupBy(*by).agg(*model, F.count("*").alias("_groups"), meat.alias("_meat"))
    else:
        done = both.groupBy(*by).agg(*model, F.lit(0).cast("bigint").alias("_groups"), F.array(F.sum(u * u)).alias("_meat"))
    # Without keys an empty table still gives a row of nulls.
    done = done.where("n is not null").select(*by, "n", "_beta", "_inverse", "_groups", "_meat")
    return done.mapInArrow(_rows(len(by), list(terms), cluster is not None), f"{kinds}n bigint, {OUT}")
