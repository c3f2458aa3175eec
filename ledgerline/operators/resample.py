"""Bootstrap intervals.

Each row gets a Poisson(1) weight for each replicate from an integer mix of
(seed, replicate, row key), the same whatever the partitioning.  A part of the
input sums all its rows for all replicates at once, so what is shuffled is one
row a group and replicate, and no row is multiplied.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime below 2^31: products stay below 2^63.
PRIME = (1 << 31) - 1
ROUNDS = 4


def thresholds() -> list[float]:
    """The distribution function of Poisson(1) at 0 to 7."""
    out, total = [], 0.0
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        out.append(total)
    return out


def mixed(seed, replicate, key):
    """An integer below PRIME from three; works on columns, arrays and numbers.

    key is taken modulo PRIME; rounds of x -> x^2 + (replicate, seed) mix."""
    x = (key % PRIME + PRIME) % PRIME
    for i in range(ROUNDS):
        x = (x * x + (replicate * 69621 + seed * 48271 + i * 16807 + 12345)) % PRIME
    return x


def mixed_sql(seed: int, replicate: str, key: str) -> str:
    """mixed() as SQL text."""
    x = f"(({key} % {PRIME} + {PRIME}) % {PRIME})"
    for i in range(ROUNDS):
        x = f"(({x} * {x} + ({replicate} * 69621 + {seed * 48271 + i * 16807 + 12345})) % {PRIME})"
    return x


def row_key(*keys: str) -> Column:
    """A key of a row from its key columns."""
    return F.pmod(F.xxhash64(*keys), F.lit(PRIME))


def poisson_weight(seed: int, replicate: Column, key: Column) -> Column:
    """Poisson(1) by inverting its distribution at a number in [0, 1)."""
    u = mixed(F.lit(seed), replicate.cast("bigint"), key.cast("bigint")) / F.lit(float(PRIME))
    w = F.lit(0)
    for c in thresholds():
        w = w + (u >= c).cast("int")
    return w


def _weights(seed: int, key: np.ndarray, n: int) -> np.ndarray:
    """Weights of rows (down) in replicates (across)."""
    u = mixed(np.int64(seed), np.arange(n, dtype=np.int64)[None, :], key[:, None]) / float(PRIME)
    return np.searchsorted(np.array(thresholds()), u.ravel(), side="right").reshape(u.shape).astype(np.float64)


def replicate_sums(df: DataFrame, by: list[str], values: list[str], key: Column, n: int, seed: int) -> DataFrame:
    """by, _r, _k (rows drawn) and the sum of each value in each replicate."""
    rows = df.select(*by, key.cast("bigint").alias("_key"), *(F.col(v).cast("double").alias(v) for v in values))
    kinds = rows.select(*by).schema
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kinds)

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            groups = list(zip(*(batch.column(c).to_pylist() for c in by))) if by else [()] * batch.num_rows
            keys = batch.column("_key").to_numpy(zero_copy_only=False)
            x = np.column_stack([np.ones(batch.num_rows), *(batch.column(v).to_numpy(zero_copy_only=False) for v in values)])
            place: dict[tuple, list[int]] = {}
            for i, g in enumerate(groups):
                place.setdefault(g, []).append(i)
            for g, at in place.items():
                for i in range(0, len(at), 512):
                    some = at[i : i + 512]
                    sums = _weights(seed, keys[some], n).T @ x[some]
                    held[g] = held[g] + sums if g in held else sums
        for g, sums in held.items():
            cols = [pa.array([v] * n, t) for v, t in zip(g, types)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.arange(n, dtype=np.int32)), *(pa.array(sums[:, j].copy()) for j in range(sums.shape[1]))], [*by, "_r", "_k", *values])

    from pyspark.sql.pandas.types import to_arrow_schema

    types = [f.type for f in to_arrow_schema(kinds)] if by else []
    out = rows.mapInArrow(run, f"{fields}_r int, _k double, " + ", ".join(f"`{v}` double" for v in values))
    return out.groupBy(*by, "_r").agg(*(F.sum(c).alias(c) for c in ("_k", *values)))


def interval(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """2.5 and 97.5 percentiles of the replicates' values that are finite."""
    v = df.withColumn("_v", value).where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") != F.lit(float("inf"))))
    return v.groupBy(*by).agg(F.percentile("_v", 0.025).alias("lo"), F.percentile("_v", 0.975).alias("hi"), F.count("*").alias("replicates"))


def bootstrap(df: DataFrame, by: list[str], pre: str, post: str, row_key_: list[str] | Column, n: int = 2000, seed: int = 11, percent: bool = True, digits: int | None = None) -> DataFrame:
    """M6, M7: percentile interval of the change of means (percent or difference),
    paired; rows of a null group or value take no part.  P21: digits rounds it."""
    key = row_key_ if isinstance(row_key_, Column) else row_key(*row_key_)
    g = replicate_sums(df.na.drop(subset=[*by, pre, post]), by, [pre, post], key, n, seed)
    a, b, k = F.col(pre), F.col(post), F.col("_k")
    out = interval(g, by, F.when(a != 0, 100 * (b - a) / a) if percent else F.when(k > 0, (b - a) / k))
    return out if digits is None else out.withColumn("lo", F.round("lo", digits)).withColumn("hi", F.round("hi", digits))


def bootstrap_two(df: DataFrame, by: list[str], value: str, after: Column, key: Column, n: int = 2000, seed: int = 23) -> DataFrame:
    """M7 of two samples: interval of the mean of rows where `after` holds less that of the others."""
    g = replicate_sums(df.where(F.col(value).isNotNull()).withColumn("_after", after), [*by, "_after"], [value], key, n, seed)
    mean = F.try_divide(F.col(value), F.col("_k"))
    both = g.groupBy(*by, "_r").agg(F.max(F.when(F.col("_after"), mean)).alias("_b"), F.max(F.when(~F.col("_after"), mean)).alias("_a"))
    return interval(both, by, F.col("_b") - F.col("_a"))
