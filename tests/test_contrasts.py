"""Contrasts, models and change points against numpy and numbers worked out by hand."""

import hashlib
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import changepoint, contrasts, developer, panels, propensity, resample


def test_heterogeneity_leaves_clipped_rows_out(spark):
    rows = [("r", "a", 5.0, 0.9), ("r", "b", 0.1, 0.9), ("r", "c", 0.2, 0.9), ("r", "d", 0.5, 0.1), ("r", "e", 0.3, None)]
    df = spark.createDataFrame(rows, "repo_id string, dev string, post_excess double, p_ai double").withColumn("grp", contrasts.group_of(F.col("p_ai")))
    out = {r["grp"]: r for r in contrasts.heterogeneity(df).collect()}
    e = [math.expm1(0.1), math.expm1(0.2)]
    assert set(out) == {"likely_ai", "unlikely_ai"}
    r = out["likely_ai"]
    assert (r["n"], r["share_big_jump"]) == (2, 0.0) and r["share_clipped"] == 0.25  # of the four with a group
    assert r["sd"] == pytest.approx(np.std(e, ddof=1)) and r["median"] == pytest.approx(np.mean(e)) and r["p90"] == pytest.approx(np.quantile(e, 0.9))
    assert out["unlikely_ai"]["share_big_jump"] == 1.0


def test_median_difference_is_of_medians(spark):
    rows = [("g", i, a, b) for i, (a, b) in enumerate([(1.0, 10.0), (2.0, 2.0), (30.0, 3.0)])]
    r = contrasts.difference_by_group(spark.createDataFrame(rows, "grp string, i long, a double, b double"), "a", "b", F.col("i")).first()
    assert r["median_diff"] == 3.0 - 2.0 and r["mean_diff"] == pytest.approx(5.0 - 11.0) and r["share_up"] == pytest.approx(1 / 3)


def test_baseline_has_no_floor(spark):
    rows = [("r", "d", -1, 7), ("r", "d", 2, 9), ("r", "late", 1, 4)]
    out = developer.baseline(spark.createDataFrame(rows, "repo_id string, dev string, t int, churn long")).collect()
    assert [(r["dev"], r["baseline_churn"]) for r in out] == [("d", 7.0)]


def test_repo_features(spark):
    cpd = {-3: 1.0, -2: 2.0, -1: 3.0, 0: 2.0, 1: 4.0, 2: 9.0}
    rows = [("r", t, v, int(2 * v), 2) for t, v in cpd.items()]
    r = developer.repo_features(spark.createDataFrame(rows, "repo_id string, t int, cpd double, churn long, commits long")).first()
    post = [2.0, 4.0, 9.0]
    assert r["f_churn_ratio"] == pytest.approx(math.log(6.0 / 3.0)) and r["f_burst"] == pytest.approx(np.std(post, ddof=1) / 5.0)
    assert r["f_growth"] == pytest.approx(np.polyfit([0, 1, 2], post, 1)[0] / 6.0) and r["f_size_ratio"] == pytest.approx(math.log((30 / 6 + 1) / (12 / 6 + 1)))


def test_change_point_trims_and_has_a_month(spark):
    rows = [("d", t, f"20{t:02d}-01", v) for t, v in enumerate([1.0] * 5 + [4.0] * 5 + [50.0] * 6)]
    out = changepoint.detect(spark.createDataFrame(rows, "k string, t int, ym string, v double"), ["k"], "v").first()
    assert (out["breakpoint_t"], out["breakpoint_ym"], out["gap"], out["n_months"], out["effect_size"]) == (5, "2005-01", 3.0, 10, 0.0)
    short = [("s", t, "x", 1.0) for t in range(5, 16)] + [("l", t, "x", 1.0) for t in range(16)]
    assert [r["k"] for r in changepoint.detect(spark.createDataFrame(short, "k string, t int, ym string, v double"), ["k"], "v").collect()] == ["l"]


def test_strong_change_points_are_those_of_all(spark):
    """The same rows with the same p as where every series is shuffled to the end."""
    rng = np.random.default_rng(8)
    rows = [(k if k else None, d, t, f"{t}", float(rng.integers(0, 9)) + (6.0 if d % 3 and t >= 9 else 0.0)) for k in ("a", "") for d in range(12) for t in range(18)]
    df = spark.createDataFrame(rows, "k string, d int, t int, ym string, v double")
    every = changepoint.detect(df, ["k", "d"], "v", trim=0)
    some = changepoint.detect_strong(df, ["k", "d"], "v", trim=0)
    want = sorted(map(str, every.where(changepoint.strong()).collect()))
    assert some.schema == every.schema and 0 < len(want) < every.count() == 24
    assert sorted(map(str, some.collect())) == want
    assert sorted(map(str, changepoint.histogram(some).collect())) == sorted(map(str, changepoint.histogram(every).collect()))


def test_shuffles_stop_once_it_is_decided(monkeypatch):
    made = []
    monkeypatch.setattr(changepoint, "md5", lambda x, **how: made.append(x) or hashlib.md5(x, **how))
    flat, step, t = np.ones(12), np.array([1.0, 2.0] * 3 + [9.0, 8.0] * 3), np.arange(12)
    assert changepoint.hits("|a", t, flat, 99, 3, 4) >= 4 and len(made) == 4 * 12
    assert made[0] == b"1|a|0"
    made.clear()
    assert changepoint.hits("|a", t, step, 99, 3, 4) < 4 and len(made) == 99 * 12
    assert changepoint.hits("|a", t, flat, 99, 3, 100) == 99


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_queries_of_strong_change_points_leave_out_other_shuffles(spark):
    """Both count what detect_strong gives; no shuffle is an expression that a plan repeats."""
    from ledgerline.plans import queries, source_queries

    for name in ("changepoint_histogram", "fig_changepoints"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "md5(" not in plan, name
    assert source_queries._strong is queries._strong


def test_permutations_against_numpy(spark):
    """Every shuffle's best gap, brute force."""
    import hashlib

    rng = np.random.default_rng(5)
    rows = [(k, t, f"{t}", float(rng.integers(0, 20))) for k in ("a", "b", "c") for t in range(14)]
    got = {r["k"]: r for r in changepoint.detect(spark.createDataFrame(rows, "k string, t int, ym string, v double"), ["k"], "v", trim=0).collect()}

    def best(v):
        n = len(v)
        return max((np.mean(v[i:]) - np.mean(v[:i]), -i) for i in range(3, n - 3))

    for k in "abc":
        mine = [(t, v) for x, t, _, v in rows if x == k]
        gap, at = best([v for _, v in mine])
        assert got[k]["gap"] == pytest.approx(gap) and got[k]["breakpoint_t"] == -at
        reached = 0
        for q in range(1, 100):
            order = sorted(mine, key=lambda x: hashlib.md5(f"{q}|{k}|{x[0]}".encode()).hexdigest())
            reached += best([v for _, v in order])[0] >= gap - 1e-12
        assert got[k]["perm_p"] == pytest.approx((1 + reached) / 100)


def test_bootstrap_weights_are_poisson():
    w = resample._weights(11, np.arange(5000, dtype=np.int64), 40)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.03
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.05 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.6


def test_bootstrap_interval_against_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [("g", i, float(a), float(a + b)) for i, (a, b) in enumerate(zip(rng.gamma(2, 3, 300), rng.normal(1, 2, 300)))]
    df = spark.createDataFrame(rows, "g string, i long, a double, b double")
    r = resample.bootstrap(df, ["g"], "a", "b", F.col("i"), 400).first()
    a, b = np.array([x[2] for x in rows]), np.array([x[3] for x in rows])
    w = resample._weights(11, np.arange(300, dtype=np.int64), 400)
    v = 100 * (w.T @ b - w.T @ a) / (w.T @ a)
    assert (r["lo"], r["hi"]) == pytest.approx(tuple(np.quantile(v, [0.025, 0.975])))
    drawn = [100 * (b[s].mean() / a[s].mean() - 1) for s in (rng.integers(0, 300, 300) for _ in range(400))]
    assert (r["lo"], r["hi"]) == pytest.approx(tuple(np.quantile(drawn, [0.025, 0.975])), abs=4)


def test_backbone_against_numpy(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(12):
        first, suit = int(rng.integers(-30, -12)), float(rng.uniform(0.2, 1))
        rows += [(f"r{k}", t, suit, float(rng.gamma(3, 40) * (1 + suit * (t >= 0)))) for t in range(first, 20)]
    out = {r["term"]: r for r in contrasts.pooled_interaction(spark.createDataFrame(rows, "repo_id string, t int, suitability double, cpd double")).collect()}
    repo, t, s, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows]), np.log1p([r[3] for r in rows])
    age = t - np.array([t[repo == r].min() for r in repo])
    age, s, post = age - age.mean(), s - s.mean(), (t >= 0).astype(float)
    x = np.column_stack([np.ones(len(t)), post, s, post * s, t, age, age**2])
    inv = np.linalg.pinv(x.T @ x)
    beta = inv @ x.T @ y
    u = y - x @ beta
    meat = sum(np.outer(v, v) for v in (x[repo == r].T @ u[repo == r] for r in set(repo)))
    g, n, k = len(set(repo)), *x.shape
    se = np.sqrt(np.diag(g / (g - 1) * (n - 1) / (n - k) * inv @ meat @ inv))
    for i, name in enumerate(["const", "post", "suitability", "post_x_suitability", "t", "age", "age_sq"]):
        assert out[name]["coef"] == pytest.approx(beta[i], rel=1e-5, abs=1e-8) and out[name]["se"] == pytest.approx(se[i], rel=1e-4)
        assert out[name]["p"] == pytest.approx(math.erfc(abs(beta[i] / se[i]) / math.sqrt(2)), rel=1e-3, abs=1e-9)


def test_cluster_errors_have_p(spark):
    rng = np.random.default_rng(6)
    rows = [(f"c{i % 7}", float(x), float(0.5 * x + e)) for i, (x, e) in enumerate(zip(rng.random(60), rng.normal(0, 0.3, 60)))]
    r = contrasts.tested(contrasts.clustered_ols(spark.createDataFrame(rows, "repo_id string, p_ai double, y double"), "y", "p_ai", "repo_id")).first()
    assert r["z"] == pytest.approx(r["slope"] / r["se"]) and r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)))


def test_propensity_against_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(80, 2))
    y = rng.random(80) < 0.6 / (1 + np.exp(-2 * x[:, 0]))
    df = spark.createDataFrame([(i, float(a), float(b), bool(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "k int, f_a double, f_b double, y boolean")
    assert propensity.features_of(df) == ["f_a", "f_b"]
    out = propensity.pu_propensity(df, ["k"], ["f_a", "f_b"], "y", 0).orderBy("k").collect()
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(80)])
    w = np.zeros(3)
    for _ in range(40):
        q = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + np.diag([1, 1, 0]), z.T @ (q - y) + np.diag([1, 1, 0]) @ w)
    q = 1 / (1 + np.exp(-z @ w))
    p = np.clip(q / q[y].mean(), 0, 1)
    want = np.where(y, np.maximum(np.round(p, 4), 0.99), np.round(p, 4))
    assert [r["p_ai"] for r in out] == pytest.approx(want.tolist(), abs=1e-6)
    assert {r["label_source"] for r in out} == {"signature-positive", "inferred"} and all(r["p_ai_lo"] is None for r in out)


def test_shares_and_mentions(spark):
    s = developer.shares(spark.createDataFrame([(0, 0, 0), (4, 1, 2)], "total_commits int, feature_commits int, bugfix_commits int")).collect()
    assert [(r["feature_share"], r["bugfix_share"]) for r in s] == [(None, None), (0.25, 0.5)]
    rows = [("a", "2024-01", 4, 1, 2), ("b", "2024-01", 6, 0, 1), ("a", "2024-02", 0, 0, 0), ("a", "2106-01", 5, 5, 5)]
    m = panels.mention_series(spark.createDataFrame(rows, "repo_id string, ym string, total_commits long, mentions_x long, mentions_y long"), "2026-01").orderBy("ym").collect()
    assert [(r["ym"], r["any_mention"], r["mention_rate"]) for r in m] == [("2024-01", 4, 0.4), ("2024-02", 0, None)]
