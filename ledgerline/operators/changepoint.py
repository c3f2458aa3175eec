"""The largest upward step of a series, and how often chance makes one.

An entity's series is an array in order of months, collected once; splits are
array expressions over it and shuffles are made where it lies, so nothing is
dealt out again.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CP_EFFECT, CP_MARGIN, CP_MIN, CP_P, CP_PERMS, CP_TRIM


def series(rows: DataFrame, keys: list[str], value: str, trim: int = CP_TRIM, least: int = CP_MIN) -> DataFrame:
    """keys, v (array of t, ym, v in order of t), n.  The last `trim` months of
    all entities are left out, then entities of fewer than `least` months."""
    if "ym" not in rows.columns:
        rows = rows.withColumn("ym", F.lit(None).cast("string"))
    fine = rows.where(F.col(value).isNotNull()).select(*keys, F.struct("t", "ym", F.col(value).cast("double").alias("v")).alias("x"))
    got = fine.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("x"))
    last = rows.agg(F.max("t").alias("_last"))  # one row
    cut = got.crossJoin(F.broadcast(last)).withColumn("x", F.filter("x", lambda e: e["t"] <= F.col("_last") - trim))
    return cut.where(F.size("x") >= least).select(*keys, "x", F.size("x").alias("n"))


def gaps(values: str, margin: int) -> str:
    """For an array of numbers, an array of (gap, -i) for each split i: the mean
    from i on less the mean before, null beside the margins."""
    running = f"aggregate({values}, cast(array() as array<double>), (s, e) -> array_append(s, coalesce(try_element_at(s, -1), 0D) + e))"
    return f"""transform(array({running}), cs -> transform(sequence({margin}, size({values}) - {margin} - 1),
      i -> named_struct('gap', (cs[size(cs) - 1] - cs[i - 1]) / (size(cs) - i) - cs[i - 1] / i, 'i', -i)))[0]"""


def best_split(rows: DataFrame, keys: list[str], value: str, trim: int = CP_TRIM, least: int = CP_MIN, margin: int = CP_MARGIN) -> DataFrame:
    """For each entity the split with the largest gap, the first on ties."""
    s = series(rows, keys, value, trim, least)
    return _described(s, keys, margin)


def _described(s: DataFrame, keys: list[str], margin: int, *more: str | Column) -> DataFrame:
    best = F.expr(f"array_max({gaps('transform(x, e -> e.v)', margin)})")
    s = s.withColumn("b", best).withColumn("i", -F.col("b.i"))
    s = s.withColumn("l", F.expr("transform(slice(x, 1, i), e -> e.v)")).withColumn("r", F.expr("transform(slice(x, i + 1, n - i), e -> e.v)"))
    for side in ("l", "r"):
        s = s.withColumn(f"m{side}", F.expr(f"aggregate({side}, 0D, (a, e) -> a + e) / size({side})"))
        s = s.withColumn(f"v{side}", F.expr(f"if(size({side}) > 1, aggregate({side}, 0D, (a, e) -> a + (e - m{side}) * (e - m{side})) / (size({side}) - 1), 0D)"))
    spread = F.sqrt((F.col("vl") + F.col("vr")) / 2)
    at = F.col("x")[F.col("i")]
    return s.select(*keys, at["ym"].alias("breakpoint_ym"), at["t"].alias("breakpoint_t"), F.col("b.gap").alias("gap"), F.when(spread > 0, F.col("b.gap") / spread).otherwise(0.0).alias("effect_size"), *more, F.col("ml").alias("before_mean"), F.col("mr").alias("after_mean"), F.col("n").alias("n_months"))


def hits(who: str, t: np.ndarray, v: np.ndarray, perms: int, margin: int, most: int) -> int:
    """Shuffles of a series whose largest gap reaches its own; once they are `most`
    or more no further ones are made.  A shuffle's order is a digest of its number,
    the keys and the month."""
    n, i = len(v), np.arange(margin, len(v) - margin)
    if not len(i):
        return 0
    tot, ends = np.cumsum(v)[-1], [f"{who}|{m}".encode() for m in t.tolist()]

    def top(rows: np.ndarray) -> np.ndarray:
        before = np.cumsum(rows, axis=1)[:, i - 1]
        return ((tot - before) / (n - i) - before / i).max(axis=1)

    own, k, done, step = top(v[None])[0], 0, 0, perms if most > perms else 4
    while done < perms and k < most:
        qs = [str(q).encode() for q in range(done + 1, min(done + step, perms) + 1)]
        digests = b"".join(md5(q + e, usedforsecurity=False).digest() for q in qs for e in ends)
        d = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(len(qs), n, 2)
        gap = top(v[np.lexsort((d[..., 1], d[..., 0]))])
        k += int(np.count_nonzero(np.isnan(gap) | (gap >= own)))
        done, step = done + len(qs), 2 * step
    return k


def _tested(s: DataFrame, keys: list[str], perms: int, margin: int, effect: float | None = None, p: float | None = None) -> DataFrame:
    """_described with perm_p.  With effect and p only the strong ones: those of
    less effect are not shuffled, and others only until their p can't be under p."""
    most = perms + 1 if p is None else next((k for k in range(perms + 1) if not (k + 1) / (perms + 1) < p), perms + 1)
    who = F.concat(F.lit(""), *(F.coalesce(F.concat(F.lit("|"), F.col(k).cast("string")), F.lit("")) for k in keys))
    s = s.withColumns({"_who": who, "_t": F.expr("transform(x, e -> cast(e.t as bigint))"), "_v": F.expr("transform(x, e -> e.v)")})
    d = _described(s, keys, margin, F.lit(0.0).alias("perm_p"), "_who", "_t", "_v")
    names = [c for c in d.columns if c not in ("_who", "_t", "_v")]

    def chance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if effect is not None:
                b = b.filter(pa.array([e is not None and not e < effect for e in b["effect_size"].to_pylist()], pa.bool_()))
            at, t, v = b["_v"].offsets.to_pylist(), b["_t"].flatten().to_numpy(), b["_v"].flatten().to_numpy()
            at = [x - at[0] for x in at] if at else []
            k = np.array([hits(w, t[i:j], v[i:j], perms, margin, most) for w, i, j in zip(b["_who"].to_pylist(), at, at[1:])], dtype=np.int64)
            out = pa.RecordBatch.from_arrays([pa.array((k + 1) / (perms + 1), pa.float64()) if c == "perm_p" else b[c] for c in names], names=names)
            yield out if p is None else out.filter(pa.array(k < most))

    return d.mapInArrow(chance, d.select(*names).schema)


def detect(rows: DataFrame, keys: list[str], value: str, perms: int = CP_PERMS, trim: int = CP_TRIM, least: int = CP_MIN, margin: int = CP_MARGIN) -> DataFrame:
    """best_split with perm_p, the share of shuffles of the same series
    whose best gap reaches its own, (1 + k) / (1 + perms).  A shuffle's order is
    a digest of its number, the keys and the month: nothing depends on where rows are."""
    return _tested(series(rows, keys, value, trim, least), keys, perms, margin)


def detect_strong(rows: DataFrame, keys: list[str], value: str, effect: float = CP_EFFECT, p: float = CP_P, perms: int = CP_PERMS, trim: int = CP_TRIM, least: int = CP_MIN, margin: int = CP_MARGIN) -> DataFrame:
    """The rows of detect that are strong, perm_p included, without the shuffles
    that cannot change which ones these are."""
    return _tested(series(rows, keys, value, trim, least), keys, perms, margin, effect, p).where(strong(effect, p))


def permutation_p(rows: DataFrame, keys: list[str], value: str, perms: int = CP_PERMS, margin: int = CP_MARGIN) -> DataFrame:
    """M8 of whole series: keys and perm_p of those with a split."""
    return detect(rows, keys, value, perms, 0, 2 * margin + 1, margin).select(*keys, "perm_p")


def strong(effect: float = CP_EFFECT, p: float = CP_P) -> Column:
    return (F.col("effect_size") >= effect) & (F.col("perm_p") < p)


def histogram(found: DataFrame, effect: float = CP_EFFECT, p: float = CP_P) -> DataFrame:
    """Strong breakpoints by calendar month."""
    return found.where(strong(effect, p)).groupBy("breakpoint_ym").agg(F.count("*").alias("n_breakpoints"))
