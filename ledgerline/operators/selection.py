"""Exact medians and percentiles of groups that no task could hold.

A value's sortable form is a 64-bit integer in the same order.  Values are
counted by its highest 16 bits, group by group, which tells the bin that holds
a wanted rank; those of that bin are counted by the next 16 bits, and so on.
A bin of no more than `limit` values is sorted at once.  So a task holds some
65,536 counts or `limit` values of a group, there are four passes at most, and
what is shuffled are counts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from .keep import few, kept

#: Values of a group, or of a bin of one, that one task sorts.
LIMIT = 1 << 16
BITS = 16


def _flip(bits: np.ndarray) -> np.ndarray:
    """Negative numbers' order is the other way round; its own inverse."""
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


@F.pandas_udf(LongType())
def sortable(x: pd.Series) -> pd.Series:
    """An integer for each double, in the same order; one for both zeros and one for NaN."""
    v = x.to_numpy(np.float64) + 0.0
    return pd.Series(_flip(np.where(np.isnan(v), np.nan, v).view(np.int64)))


@F.pandas_udf(DoubleType())
def _value(k: pd.Series) -> pd.Series:
    return pd.Series(_flip(k.to_numpy(np.int64)).view(np.float64))


def unsortable(k: str) -> Column:
    nan = int(np.array(np.nan).view(np.int64))  # a series would make it a null
    return F.when(F.col(k) == nan, F.lit(math.nan)).otherwise(_value(k))


def quantiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]], limit: int = LIMIT) -> DataFrame:
    """by, and for each name the quantile q of a column: wanted is {name: (column, q)}.

    Quantiles lie between neighbours as a straight line does.  Nulls of a column
    take no part in its quantiles; a group without values has null.  NaN is
    greater than all else.  df is read several times: it should be kept."""
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    sizes = kept(df.groupBy(*by).agg(F.count("*").alias("_rows")))
    large = sizes.where(F.col("_rows") > limit).drop("_rows")
    if not large.limit(1).count():
        return df.groupBy(*by).agg(*(F.percentile(c, q).alias(name) for name, (c, q) in wanted.items()))
    large = few(large)
    same = _same(by)
    small = df.join(large, same(df, large), "left_anti").groupBy(*by).agg(*(F.percentile(c, q).alias(name) for name, (c, q) in wanted.items()))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)))).alias("_x")
    rows = df.join(large, same(df, large), "left_semi").select(*by, each).select(*by, "_x.*").where("_v is not null")
    rows = kept(rows.select(*by, "_c", sortable("_v").alias("_k")))
    ask = [(columns.index(c), q, name) for name, (c, q) in wanted.items()]
    found = _selected(rows, [*by, "_c"], ask, limit)
    groups = sizes.where(F.col("_rows") > limit).select(*by)
    found = found.groupBy(*by).agg(*(F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name in wanted))
    out = groups.alias("g").join(found.alias("f"), same(groups.alias("g"), found.alias("f"), "g", "f"), "left").select(*(F.col(f"g.{c}").alias(c) for c in by), *(F.col(f"f.{n}").alias(n) for n in wanted))
    return small.unionByName(out)


def _same(by: list[str]):
    """A condition that two frames' keys are the same, null with null."""

    def of(a: DataFrame, b: DataFrame, left: str = "", right: str = "") -> Column:
        out = F.lit(True)
        for c in by:
            out = out & (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) if left else a[c].eqNullSafe(b[c]))
        return out

    return of


def _selected(rows: DataFrame, by: list[str], ask: list[tuple[int, float, str]], limit: int) -> DataFrame:
    """by, _name, _value for rows of by and _k."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    questions = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.lit(q).alias("q"), F.lit(name).alias("name")) for c, q, name in ask))).alias("_a")
    at = F.col("_q") * (F.col("_n") - 1)
    asked = sizes.select(*by, "_n", questions).where("_a.c = _c").select(*by, F.col("_a.name").alias("_name"), F.col("_a.q").alias("_q"), "_n")
    asked = kept(asked.select(*by, "_name", F.floor(at).alias("_low"), F.ceil(at).alias("_high"), (at - F.floor(at)).alias("_part")))
    # A rank with the bin that holds it, and the values before that bin.
    state = asked.select(*by, F.explode(F.array("_low", "_high")).alias("_rank")).distinct().select(*by, "_rank", F.lit(0).cast("bigint").alias("_bin"), F.lit(0).cast("bigint").alias("_before"))
    shift = 64
    while True:
        width, shift = shift, shift - BITS
        bins = _in_bins(rows, state, by, width).groupBy(*by, "_bin", F.shiftright("_k", shift).alias("_next")).agg(F.count("*").alias("_n"))
        before = Window.partitionBy(*by, "_bin").orderBy("_next").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("_less", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        both = state.alias("s").join(bins.alias("b"), _same([*by, "_bin"])(state, bins, "s", "b") & (F.col("_rank") - F.col("_before") >= F.col("_less")) & (F.col("_rank") - F.col("_before") < F.col("_less") + F.col("_n")))
        state = kept(both.select(*(F.col(f"s.{c}").alias(c) for c in by), "_rank", F.col("_next").alias("_bin"), (F.col("_before") + F.col("_less")).alias("_before"), F.col("_n").alias("_size")))
        if not shift or not state.where(F.col("_size") > limit).limit(1).count():
            break
    if shift:
        place = F.row_number().over(Window.partitionBy(*by, "_bin").orderBy("_k")) - 1
        near = _in_bins(rows, state, by, shift).withColumn("_place", place)
        both = state.alias("s").join(near.alias("b"), _same([*by, "_bin"])(state, near, "s", "b") & (F.col("_rank") - F.col("_before") == F.col("_place")))
        state = both.select(*(F.col(f"s.{c}").alias(c) for c in by), "_rank", "_k")
    else:
        state = state.select(*by, "_rank", F.col("_bin").alias("_k"))
    values = state.withColumn("_value", unsortable("_k"))
    key = _same(by)
    out = asked.alias("a").join(values.alias("l"), key(asked, values, "a", "l") & (F.col("a._low") == F.col("l._rank")))
    out = out.join(values.alias("h"), key(asked, values, "a", "h") & (F.col("a._high") == F.col("h._rank")))
    low, high = F.col("l._value"), F.col("h._value")
    # Neighbours that are equal need no difference, which two infinities do not have.
    return out.select(*(F.col(f"a.{c}").alias(c) for c in by), "_name", F.when((low == high) | (F.col("_part") == 0), low).otherwise(low * (1 - F.col("_part")) + high * F.col("_part")).alias("_value"))


def _in_bins(rows: DataFrame, state: DataFrame, by: list[str], width: int) -> DataFrame:
    """Rows of the bins of a state, with their bin: the bits above `width`."""
    bin_ = F.shiftright("_k", width) if width < 64 else F.lit(0).cast("bigint")
    bins = few(state.select(*by, "_bin").distinct()).alias("s")
    at = rows.withColumn("_bin", bin_).alias("r")
    return at.join(bins, _same([*by, "_bin"])(at, bins, "r", "s"), "left_semi")
