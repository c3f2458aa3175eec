"""Places of rows in a global order, or in that of their groups, in no single task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .keep import few, kept


def ranked(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df with _rank (from 0, within by) and _size, the rows of the group.

    Rows are ranged by (by, order) into parts of like size, whatever values or
    groups repeat; a rank is the rows of the parts before and the place within
    one's own.  Windows run over counts: a row for each part a group lies in.
    Nulls are a group and come first.  Rows that are equal in all of `order` are
    ranked in any order, so it should tell rows apart."""
    rows = kept(df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = kept(rows.groupBy(part.alias("_part"), *by).agg(F.min("_id").alias("_first"), F.count("*").alias("_n")))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = few(counts.select("_part", *by, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(group).alias("_size")))
    same = F.col("r._part") == F.col("s._part")
    for c in by:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}"))
    place = F.col("s._before") + F.col("r._id") - F.col("s._first")
    both = rows.withColumn("_part", part).alias("r").join(starts.alias("s"), same)
    return both.select(*(F.col(f"r.{c}").alias(c) for c in df.columns), place.alias("_rank"), F.col("s._size").alias("_size"))
