"""Trends fitted before the anchor, and what comes after in excess of them.

A fit's rows are those with t < 0.  One aggregation by entity has both the
sums of the fit and the entity's rows (its months, a bounded number), which are
exploded again once the fit is solved: the input is read once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import text as T
from ..schemas import DEV_MIN_POST, DEV_MIN_PRE, MIN_PRE, RESID_CLIP


def _rows(df: DataFrame, keys: list[str], *more: Column) -> Column:
    return F.collect_list(F.struct(*(F.col(c) for c in df.columns if c not in keys), *more)).alias("_rows")


def _unrolled(fit: DataFrame, df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Rows of the entities of a fit, with what is in excess of value."""
    out = fit.select(*keys, *(c for c in fit.columns if c.startswith("_") and c != "_rows"), F.inline("_rows"))
    out = out.withColumn("resid", T.clip(F.col("_ly") - value, RESID_CLIP)).withColumn("pct_excess", F.expm1("resid"))
    return out.select(*df.columns, "resid", "pct_excess")


def two_parameter(df: DataFrame, keys: list[str], y: Column, min_pre: int = DEV_MIN_PRE, min_post: int = DEV_MIN_POST) -> DataFrame:
    """log1p(y) on 1 and t by key; adds resid (clipped) and pct_excess."""
    ly = F.log1p(y)
    pre = F.col("t") < 0
    fit = (
        df.groupBy(*keys)
        .agg(
            F.regr_slope(F.when(pre, ly), F.when(pre, F.col("t"))).alias("_b"),
            F.avg(F.when(pre, ly)).alias("_my"),
            F.avg(F.when(pre, F.col("t"))).alias("_mt"),
            F.count_if(pre).alias("_pre"),
            F.count_if(~pre).alias("_post"),
            _rows(df, keys, ly.alias("_ly")),
        )
        .where((F.col("_pre") >= min_pre) & (F.col("_post") >= min_post))
        # A single pre-period month value has no slope: the least-norm fit is flat there.
        .withColumn("_b", F.coalesce("_b", F.lit(0.0)))
    )
    return _unrolled(fit, df, keys, F.col("_my") + F.col("_b") * (F.col("t") - F.col("_mt")))


@F.pandas_udf(ArrayType(DoubleType()))
def least_norm(sums: pd.Series) -> pd.Series:
    """Solutions of 4 x 4 systems of least norm: ten sums of the matrix's upper half, four of the right side."""
    s = np.stack([np.asarray(x, dtype=float) for x in sums]) if len(sums) else np.zeros((0, 14))
    g = np.empty((len(s), 4, 4))
    for k, (i, j) in enumerate((i, j) for i in range(4) for j in range(i, 4)):
        g[:, i, j] = g[:, j, i] = s[:, k]
    return pd.Series(list(np.einsum("nij,nj->ni", np.linalg.pinv(g), s[:, 10:])))


def seasonal(df: DataFrame, keys: list[str], y: Column, min_pre: int = MIN_PRE) -> DataFrame:
    """log1p(y) on 1, t and the month's Fourier pair, by key.

    Ten Gram sums and four right-hand sides in one aggregation; each entity's
    4 x 4 system is solved by least norm, so that a pre-period that does not
    tell all terms apart has its solution too."""
    angle = 2 * F.pi() * F.substring("ym", 6, 2).cast("int") / 12
    cols = [F.lit(1.0), F.col("t").cast("double"), F.sin(angle), F.cos(angle)]
    ly = F.log1p(y)
    pre = F.col("t") < 0
    sums = [F.sum(F.when(pre, cols[i] * cols[j])) for i in range(4) for j in range(i, 4)] + [F.sum(F.when(pre, c * ly)) for c in cols]
    fit = df.groupBy(*keys).agg(F.count_if(pre).alias("_n"), *(x.alias(f"_s{i}") for i, x in enumerate(sums)), _rows(df, keys, ly.alias("_ly"))).where(F.col("_n") >= min_pre)
    fit = fit.select(*keys, "_rows", least_norm(F.array(*(f"_s{i}" for i in range(14)))).alias("_b"))
    b = F.col("_b")
    return _unrolled(fit, df, keys, b[0] + b[1] * cols[1] + b[2] * cols[2] + b[3] * cols[3])


def placebo(df: DataFrame, keys: list[str], y: Column, anchor: str, placebo_anchor: str, window: int, season: bool) -> DataFrame:
    """The same fit about an anchor before the real one; mean excess 0..window."""
    early = df.where(F.col("ym") < anchor).withColumn("t", T.ym_ord(F.col("ym")) - T.anchor_ord(placebo_anchor))
    fitted = seasonal(early, keys, y) if season else two_parameter(early, keys, y)
    return fitted.where(F.col("t").between(0, window)).agg(F.expm1(F.avg("resid")).alias("mean_excess"), F.count("*").alias("n"))
