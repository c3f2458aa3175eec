"""Exact quantiles of groups that are refined bin by bin."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import selection

WANTED = {"p90": ("x", 0.9), "mid": ("x", 0.5), "low": ("y", 0.0), "ymid": ("y", 0.5)}


def groups():
    rng = np.random.default_rng(4)
    ties = np.where(rng.random(3000) < 0.9, 7.25, rng.normal(size=3000))
    return {
        ("a", 1): rng.normal(size=4001) * 10.0 ** rng.integers(-8, 8, 4001),
        ("a", None): ties,
        (None, 2): np.array([1.5, -2.0, 0.0, -0.0, 3.0]),
        ("b", 1): np.arange(2000.0) / 7 - 100,
        ("c", 3): np.array([5.0]),
    }


@pytest.mark.parametrize("limit", [0, 40, 3500])
def test_quantiles_against_numpy(spark, limit):
    data = [(g, h, float(v), float(-v) if i % 3 else None) for (g, h), values in groups().items() for i, v in enumerate(values)]
    data += [("none", 1, None, None)] * 5
    df = spark.createDataFrame(data, "g string, h int, x double, y double").repartition(7).persist()
    got = {(r["g"], r["h"]): r for r in selection.quantiles(df, ["g", "h"], WANTED, limit).collect()}
    assert set(got) == {*groups(), ("none", 1)}
    for key, values in groups().items():
        y = np.array([-v for i, v in enumerate(values) if i % 3])
        want = [np.quantile(values, 0.9), np.quantile(values, 0.5), y.min() if len(y) else None, np.quantile(y, 0.5) if len(y) else None]
        assert all(a is None and b is None or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12) for a, b in zip((got[key][c] for c in WANTED), want)), key
    assert [got[("none", 1)][c] for c in WANTED] == [None] * 4


def test_one_group_of_five_million(spark):
    """No task of the selection holds the group: what is shuffled are counts."""
    n = 5_000_000
    df = spark.range(0, n, 1, 8).select(F.lit("all").alias("g"), ((F.col("id") * 2654435761) % n).cast("double").alias("x")).persist()
    got = selection.quantiles(df, ["g"], {"mid": ("x", 0.5), "p90": ("x", 0.9)}).first()
    assert (got["mid"], got["p90"]) == ((n - 1) / 2, 0.9 * (n - 1))
    df.unpersist()


def test_empty(spark):
    df = spark.createDataFrame([], "g string, x double, y double")
    assert selection.quantiles(df, ["g"], WANTED).count() == 0


def test_sortable_keeps_order(spark):
    v = [-math.inf, -1e300, -2.0, -1e-300, -0.0, 0.0, 1e-300, 1.0, 1e300, math.inf, math.nan]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, x double").select("i", "x", selection.sortable("x").alias("k")).withColumn("back", selection.unsortable("k")).orderBy("i").collect()
    keys = [r["k"] for r in rows]
    assert keys == sorted(keys) and keys[4] == keys[5] and len(set(keys)) == len(keys) - 1
    assert all(a["x"] == a["back"] or a["x"] != a["x"] and a["back"] != a["back"] for a in rows)
