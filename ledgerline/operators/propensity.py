"""Propensity from positive and unlabelled rows (Elkan and Noto).

A replicate is fitted on the set of rows that its draw holds (a Poisson weight
above zero), not on their multiplicities.

A Newton step of all replicates reads the rows once: a part of the input sums
each replicate's Gram matrix and gradient with the draws made anew from the
rows' keys, so no row is multiplied and what is shuffled is one row of sums a
part and replicate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keep import kept
from .resample import PRIME, mixed, row_key, thresholds

#: Rows whose draws in all replicates are in memory at once.
SLICE = 1024


def _drawn(seed: int, key: np.ndarray, n: int) -> np.ndarray:
    """1 where a row (down) is in the whole (first) and in each replicate (across)."""
    u = mixed(np.int64(seed), np.arange(n, dtype=np.int64)[None, :], key[:, None]) / float(PRIME)
    return np.concatenate([np.ones((len(key), 1)), u >= thresholds()[0]], axis=1).astype(np.float64)


def _slices(batches, k: int):
    """(features and 1, label, key) of some rows at a time, from batches of those columns."""
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        x = np.column_stack([*cols[:k], np.ones(batch.num_rows)])
        for i in range(0, batch.num_rows, SLICE):
            yield x[i : i + SLICE], cols[k][i : i + SLICE], cols[k + 1][i : i + SLICE]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _sums(rows: DataFrame, make, n: int, width: int) -> np.ndarray:
    """Sums over rows of what make(batches) gives for a part: n rows of `width` numbers."""

    def run(batches):
        total = make(batches)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), *(pa.array(total[:, i].copy()) for i in range(width))], ["_r", *(f"s{i}" for i in range(width))])

    parts = rows.mapInArrow(run, "_r int, " + ", ".join(f"s{i} double" for i in range(width)))
    out = np.zeros((n, width))
    for r in parts.groupBy("_r").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(width))).collect():
        out[r["_r"]] = r[1:]
    return out


def logistic_fits(df: DataFrame, features: list[str], label: str, key: Column, n: int = 0, seed: int = 7, penalty: float = 1.0, steps: int = 25) -> np.ndarray:
    """M3: weights (intercept last) of the whole and of n replicates, down.

    An L2 penalty on the summed loss, the intercept free.  A replicate of fewer
    than two positive rows has NaN.  df should be kept: each step reads it."""
    k = len(features)
    rows = df.select(*(F.col(f).cast("double") for f in features), F.col(label).cast("double"), key.cast("bigint"))
    upper = np.triu_indices(k + 1)
    p, models = len(upper[0]), n + 1
    w, done = np.zeros((models, k + 1)), np.zeros(models, dtype=bool)
    ridge = np.diag([penalty] * k + [0.0])

    def part(now: np.ndarray):
        def make(batches):
            total = np.zeros((models, p + k + 2))
            for x, y, keys in _slices(batches, k):
                d = _drawn(seed, keys, n)
                q = _sigmoid(x @ now.T)
                total[:, :p] += (d * q * (1 - q)).T @ (x[:, upper[0]] * x[:, upper[1]])
                total[:, p:-1] += (d * (q - y[:, None])).T @ x
                total[:, -1] += d.T @ y
            return total

        return make

    for step in range(steps):
        sums = _sums(rows, part(w.copy()), models, p + k + 2)
        if not step:
            w[sums[:, -1] < 2] = np.nan
            w[0] = 0.0
            done = np.isnan(w).any(axis=1)
        for r in np.flatnonzero(~done):
            hessian = np.zeros((k + 1, k + 1))
            hessian[upper] = sums[r, :p]
            hessian += np.triu(hessian, 1).T + ridge + 1e-12 * np.eye(k + 1)
            move = np.linalg.solve(hessian, sums[r, p:-1] + ridge @ w[r])
            w[r] -= move
            done[r] = np.abs(move).max() < 1e-9
        if done.all():
            break
    return w


def logistic_fit(df: DataFrame, features: list[str], label: str, penalty: float = 1.0, steps: int = 25) -> list[float]:
    """logistic_fits of all rows only."""
    return logistic_fits(df, features, label, F.lit(0), 0, penalty=penalty, steps=steps)[0].tolist()


def features_of(df: DataFrame) -> list[str]:
    """Columns that are features by their name."""
    return [c for c in df.columns if c.startswith("f_")]


def pu_propensity(df: DataFrame, keys: list[str], features: list[str], positive: str, replicates: int = 100, seed: int = 7, key: Column | None = None) -> DataFrame:
    """M5: keys, p_ai, p_ai_lo, p_ai_hi (to four places), label_source.

    X3: features may be any columns; `features_of` takes those named f_*.  Rows
    with a null feature go.  Under three positives or ten rows the label is the
    propensity.  Without replicates there is no interval (null); one with fewer
    than two positives gives the point estimate.  key: an integer of a row that
    its draws come from, by default a hash of keys."""
    key = row_key(*keys) if key is None else key
    rows = df.select(*keys, *(F.col(f).cast("double").alias(f) for f in features), F.col(positive).cast("double").alias("_y"), key.cast("bigint").alias("_key")).na.drop(subset=features)
    rows = kept(rows.withColumn("_y", F.coalesce("_y", F.lit(0.0))))
    s = rows.agg(F.count("*").alias("n"), F.sum("_y").alias("p"), *(F.avg(f).alias(f"m_{f}") for f in features), *(F.stddev_pop(f).alias(f"s_{f}") for f in features)).first()
    if (s["p"] or 0) < 3 or s["n"] < 10:
        none = F.lit(None).cast("double")
        return rows.select(*keys, F.when(F.col("_y") > 0, 0.95).alias("p_ai"), none.alias("p_ai_lo"), none.alias("p_ai_hi"), F.when(F.col("_y") > 0, "signature").otherwise("insufficient-positives").alias("label_source"))
    z = rows.select(*keys, "_y", "_key", *(((F.col(f) - s[f"m_{f}"]) / (s[f"s_{f}"] if s[f"s_{f}"] >= 1e-9 else 1.0)).alias(f) for f in features))
    w, k = logistic_fits(z, features, "_y", F.col("_key"), replicates, seed), len(features)
    known = ~np.isnan(w).any(axis=1)
    fitted, models = w[known], int(known.sum())

    def labelled(batches):
        total = np.zeros((models, 1))
        for x, y, _ in _slices(batches, k):
            total[:, 0] += _sigmoid(x @ fitted.T)[y > 0].sum(axis=0)
        return total

    # The mean score of the rows that are known to be positive.
    scale = np.maximum(_sums(z.select(*features, "_y", "_key"), labelled, models, 1)[:, 0] / s["p"], 1e-6)
    where = np.cumsum(known) - 1
    where = np.where(known, where, 0)[1:]

    def score(batches):
        for batch in batches:
            x = np.column_stack([*(batch.column(f).to_numpy(zero_copy_only=False) for f in features), np.ones(batch.num_rows)])
            y = batch.column("_y").to_numpy(zero_copy_only=False)
            p, ends = np.empty(batch.num_rows), np.full((2, batch.num_rows), np.nan)
            for i in range(0, batch.num_rows, SLICE):
                each = np.clip(_sigmoid(x[i : i + SLICE] @ fitted.T) / scale, 0, 1)
                p[i : i + SLICE] = each[:, 0]
                if replicates:
                    ends[:, i : i + SLICE] = np.quantile(each[:, where], [0.025, 0.975], axis=1)
            p = np.round(p, 4)
            low, high = (pa.array(np.round(e, 4), from_pandas=True) for e in ends)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(np.where(y > 0, np.maximum(p, 0.99), p)), low, high, pa.array(np.where(y > 0, "signature-positive", "inferred"))], [*keys, "p_ai", "p_ai_lo", "p_ai_hi", "label_source"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in z.select(*keys).schema)
    return z.mapInArrow(score, f"{kinds}p_ai double, p_ai_lo double, p_ai_hi double, label_source string")
