"""Regressions, refits, ranks and gates against plain computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.operators import developer, mining, panels, propensity, ranking, regression


def fitted(x, y, groups=None):
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ x.T @ y
    u, (n, k) = y - x @ beta, x.shape
    if groups is None:
        cov = (u @ u) / max(1, n - k) * inverse
    else:
        meat = sum(np.outer(v, v) for v in (x[groups == g].T @ u[groups == g] for g in sorted(set(groups))))
        m = len(set(groups))
        cov = m / max(1, m - 1) * (n - 1) / max(1, n - k) * inverse @ meat @ inverse
    return beta, np.sqrt(np.clip(np.diag(cov), 0, None))


@pytest.mark.parametrize("cluster", [None, "c"])
def test_ols_by_key_against_numpy(spark, cluster):
    rng = np.random.default_rng(5)
    rows = []
    for key, n in (("a", 60), ("b", 41), (None, 30), ("few", 3)):
        for i in range(n):
            a, b = rng.normal(), rng.gamma(2, 50)
            rows.append((key, 1 if key == "b" else None, f"c{i % 7}", float(a), float(b), float(2 * a - b / 10 + rng.normal())))
    rows += [("a", None, "c1", None, 1.0, 1.0), ("a", None, "c1", 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "k string, j int, c string, a double, b double, y double").repartition(5)
    terms = {"one": F.lit(1.0), "a": F.col("a"), "b": F.col("b"), "again": F.col("a") * 2 + 1}  # the last is given by others
    got = {(r["k"], r["j"], r["term"]): r for r in regression.ols(df, F.col("y"), terms, ["k", "j"], cluster, min_n=5).collect()}
    assert {k[0] for k in got} == {"a", "b", None}
    for key in ("a", "b", None):
        mine = [r for r in rows if r[0] == key and r[3] is not None and r[5] is not None]
        a, b, y = (np.array([r[i] for r in mine]) for i in (3, 4, 5))
        x = np.column_stack([np.ones(len(a)), a, b, a * 2 + 1])
        beta, se = fitted(x, y, np.array([r[2] for r in mine]) if cluster else None)
        for i, term in enumerate(terms):
            r = got[(key, 1 if key == "b" else None, term)]
            assert r["n"] == len(a) and r["coef"] == pytest.approx(beta[i], rel=1e-7) and r["se"] == pytest.approx(se[i], rel=1e-6)
            assert r["z"] == pytest.approx(beta[i] / se[i], rel=1e-6) and r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)))
    whole = regression.ols(df, F.col("y"), {"one": F.lit(1.0), "a": F.col("a")}, cluster=cluster).collect()
    kept = [r for r in rows if r[3] is not None and r[5] is not None]
    beta, se = fitted(np.column_stack([np.ones(len(kept)), [r[3] for r in kept]]), np.array([r[5] for r in kept]), np.array([r[2] for r in kept]) if cluster else None)
    assert [r["coef"] for r in whole] == pytest.approx(beta.tolist()) and [r["se"] for r in whole] == pytest.approx(se.tolist())
    assert regression.ols(df.where("a > 1e9"), F.col("y"), terms, ["k"], cluster).count() == regression.ols(df.where("a > 1e9"), F.col("y"), terms, cluster=cluster).count() == 0


def test_refits_against_numpy(spark):
    """Each replicate is the fit of the rows of its draw, in one pass a step."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 2)) * [1, 30]
    y = rng.random(400) < 0.5 / (1 + np.exp(-2 * x[:, 0]))
    df = spark.createDataFrame([(i, float(a), float(b), bool(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "k int, f_a double, f_b double, y boolean").repartition(6)
    out = propensity.pu_propensity(df, ["k"], ["f_a", "f_b"], "y", 30, 7, F.col("k")).orderBy("k").collect()
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(400)])
    drawn = propensity._drawn(7, np.arange(400), 30) > 0
    assert drawn[:, 0].all() and 0.6 < drawn[:, 1:].mean() < 0.67
    fits = []
    for mask in drawn.T:
        w, v, t = np.zeros(3), z[mask], y[mask]
        for _ in range(40):
            q = 1 / (1 + np.exp(-v @ w))
            w -= np.linalg.solve((v * (q * (1 - q))[:, None]).T @ v + np.diag([1, 1, 0]), v.T @ (q - t) + np.diag([1, 1, 0]) @ w)
        q = 1 / (1 + np.exp(-z @ w))
        fits.append(np.clip(q / q[y].mean(), 0, 1))
    lo, hi = np.quantile(np.array(fits[1:]), [0.025, 0.975], axis=0)
    assert [r["p_ai_lo"] for r in out] == pytest.approx(lo.tolist(), abs=6e-5) and [r["p_ai_hi"] for r in out] == pytest.approx(hi.tolist(), abs=6e-5)
    assert all(r["p_ai_lo"] <= r["p_ai_hi"] and round(r["p_ai"], 4) == r["p_ai"] for r in out)
    assert sum(r["p_ai_lo"] < r["p_ai_hi"] for r in out) > 300


def test_replicate_without_positives_takes_the_whole(spark):
    df = spark.createDataFrame([(i, float(i % 5), i < 3) for i in range(40)], "k int, f double, y boolean")
    w = propensity.logistic_fits(df.select("k", "f", F.col("y").cast("double").alias("y")), ["f"], "y", F.col("k"), 50)
    none = np.isnan(w).any(axis=1)
    held = propensity._drawn(7, np.arange(3), 50).sum(axis=0) < 2
    assert none.tolist() == held.tolist() and none.any() and not none.all()


def test_ranks_where_most_values_are_equal(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["x", "x", "x", "y", None]), 7.0 if rng.random() < 0.9 else rng.choice([1.0, 2.5, 9.0]), i) for i in range(20000)]
    df = spark.createDataFrame(rows, "g string, v double, i long").repartition(9)
    got = ranking.ranked(df, ["g"], ["v", "i"]).collect()
    want = {}
    for g in ("x", "y", None):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])
        want |= {r[2]: (k, len(mine)) for k, r in enumerate(mine)}
    assert {r["i"]: (r["_rank"], r["_size"]) for r in got} == want
    # All are ranged into parts of like size, the one value's too.
    parts = ranking.ranked(df, [], ["v", "i"]).select("v", "_rank").collect()
    assert sorted(r["_rank"] for r in parts) == list(range(20000))
    assert [r["v"] for r in sorted(parts, key=lambda r: r["_rank"])] == sorted(r[1] for r in rows)
    assert ranking.ranked(df.where("i < 0"), ["g"], ["v", "i"]).count() == 0


def test_tiers_of_one_baseline(spark):
    rows = [("r", f"d{i:04d}", "go", 5.0 if i % 10 else float(i)) for i in range(3000)] + [("s", "a", None, 1.0), ("s", "b", "c", 1.0)]
    out = {(r["repo_id"], r["dev"]): r for r in developer.tiers(spark.createDataFrame(rows, "repo_id string, dev string, lang string, baseline_churn double")).collect()}
    order = sorted((r for r in rows if r[2] == "go"), key=lambda r: (r[3], r[0], r[1]))
    n = len(order)
    assert all(out[r[:2]]["tier_relative"] == ("low" if 3 * i < n - 1 else "mid" if 3 * i < 2 * (n - 1) else "high") for i, r in enumerate(order))
    assert out[("s", "a")]["tier_relative"] is None and out[("s", "b")]["tier_relative"] == "mid"


def test_gates_change_no_flag(spark):
    from ledgerline.plans.queries import BODIES

    texts = [*BODIES, "anthropic", "Über Cursor und KI", "the ai generated", "CODY AI", "x aider.chat", "Cognition Labs", "cursor\nprompt", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, body string")
    gated, plain = T.mention_flags(F.col("body")), T.mention_flags(F.col("body"), T.PRECISE_TERMS, T.AMBIGUOUS_TERMS)
    for r in df.select(*(c.alias(f"a_{k}") for k, c in gated.items()), *(c.alias(f"b_{k}") for k, c in plain.items())).collect():
        assert all(bool(r[f"a_{k}"]) == bool(r[f"b_{k}"]) for k in gated)
    flags = T.signature_flags(F.lit("Ann"), F.lit("x@y.z"), F.col("body"))
    text = F.concat_ws("\n", F.lit("Ann"), "body")
    for r in df.select(*(c.alias(f"a_{k}") for k, c in flags.items()), *(text.rlike(T.U + "|".join(f"(?:{p})" for p in ps)).alias(f"b_{k}") for k, ps in T.SIGNATURES.items())).collect():
        assert all(bool(r[f"a_{k}"]) == bool(r[f"b_{k}"]) for k in flags)


def test_counts_without_expand(spark):
    """Distinct counts of a month come from levels, not from rows that are multiplied."""
    rng = random.Random(6)
    rows = [(f"r{rng.randrange(2)}", f"2024-0{m}", f"2024-0{m}-{rng.randint(1, 28):02d} 0{rng.randrange(9)}:00:00", f"d{s % 5}", f"s{s}", rng.choice(["go", "c"]), rng.randrange(9), 1) for m in (1, 2) for s in range(60) for _ in range(3)]
    df = spark.createDataFrame(rows, "repo_id string, ym string, ts string, dev string, sha string, lang string, ins long, del long").withColumn("ts", F.to_timestamp("ts"))
    a, b = mining.activity_months(df), panels.repo_months_of(df, "2024-01")
    assert not any("Expand" in x._jdf.queryExecution().executedPlan().toString() for x in (a, b))
    for r in a.collect():
        mine = [x for x in rows if x[:2] == (r["repo_id"], r["ym"])]
        assert (r["commits"], r["authors"], r["active_days"]) == (len({x[4] for x in mine}), len({x[3] for x in mine}), len({x[2][:10] for x in mine}))
    for r in b.collect():
        mine = [x for x in rows if x[:2] == (r["repo_id"], r["ym"])]
        assert (r["commits"], r["devs"], r["ins"]) == (len({(x[5], x[4]) for x in mine}), len({x[3] for x in mine}), sum(x[6] for x in mine))
