import json

import numpy as np
from pyspark.sql import functions as F

from ledgerline.operators import changepoint, contrasts, counterfactual, developer, panels, propensity, resample
from ledgerline.sources import records


def test_gap_and_reactivation(spark):
    m = spark.createDataFrame([("r", "2020-01"), ("r", "2020-02"), ("r", "2020-06")], "repo_id string, ym string")
    assert panels.max_gap(m, ["repo_id"]).first()["max_gap_months"] == 3
    d = spark.createDataFrame([("r", "d", t) for t in (-10, -3, 5)], "repo_id string, dev string, t int")
    assert sorted((r["gap_months"], r["resumption_t"]) for r in developer.gap_episodes(d).collect()) == [(6, -3), (7, 5)]


def test_event_study_of_one_entity_has_no_interval(spark):
    r = contrasts.event_study(spark.createDataFrame([(0, 0.5)], "t int, resid double")).first()
    assert r["sem"] is None and r["lo"] is None and r["n"] == 1


def test_percent_change_from_zero_is_null(spark):
    rows = [("a", t, 0.0 if t < 0 else 1.0) for t in range(-4, 4)]
    out = contrasts.before_after(spark.createDataFrame(rows, "k string, t int, v double"), ["k"], {"v": F.col("v")}, 1, 1).first()
    assert out["pct_change_v"] is None


def test_terciles(spark):
    rows = [("r", str(i), "l", float(i)) for i in range(10)] + [("r", f"x{i}", "m", float(i)) for i in range(5)]
    out = developer.tiers(spark.createDataFrame(rows, "repo_id string, dev string, lang string, baseline_churn double"))
    n = {(r["lang"], r["tier_relative"]): r["count"] for r in out.groupBy("lang", "tier_relative").count().collect()}
    assert n == {("l", "low"): 3, ("l", "mid"): 3, ("l", "high"): 4, ("m", "mid"): 5}


def test_best_split(spark):
    rows = [("d", t, float(v)) for t, v in enumerate([1, 1, 1, 1, 5, 5, 5, 5])]
    r = changepoint.best_split(spark.createDataFrame(rows, "d string, t int, v double"), ["d"], "v", trim=0).first()
    assert (r["gap"], r["breakpoint_t"]) == (4.0, 4)
    p = changepoint.permutation_p(spark.createDataFrame(rows, "d string, t int, v double"), ["d"], "v").first()["perm_p"]
    assert 0 < p <= 0.2


def test_small_samples(spark):
    few = spark.createDataFrame([(float(i), float(i)) for i in range(4)], "x double, y double")
    r = contrasts.simple_ols(few, "y", "x").first()
    assert r["n"] == 4 and r["slope"] is None
    rows = [(str(i), float(i), i < 2) for i in range(12)]
    out = propensity.pu_propensity(spark.createDataFrame(rows, "k string, f double, y boolean"), ["k"], ["f"], "y").collect()
    assert {(r["p_ai"], r["label_source"]) for r in out} == {(0.95, "signature"), (None, "insufficient-positives")}


def test_seasonal_singular_is_least_norm(spark):
    rows = [("r", f"{2000 + i // 2:04d}-{1 + 6 * (i % 2):02d}", (i - 14) * 6, float(10 + i)) for i in range(20)]
    out = counterfactual.seasonal(spark.createDataFrame(rows, "repo_id string, ym string, t int, cpd double"), ["repo_id"], F.col("cpd")).orderBy("t").toPandas()
    t, y = np.array([r[2] for r in rows], float), np.log1p([r[3] for r in rows])
    a = np.array([2 * np.pi * (int(r[1][5:]) - 1) / 12 for r in rows])
    x = np.column_stack([np.ones(20), t, np.sin(a), np.cos(a)])
    beta = np.linalg.pinv(x[t < 0].T @ x[t < 0]) @ x[t < 0].T @ y[t < 0]
    assert np.allclose(out["resid"], y - x @ beta, atol=1e-6)


def test_logistic_matches_newton(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    y = (rng.random(200) < 1 / (1 + np.exp(-x))).astype(float)
    w = propensity.logistic_fit(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "f double, y double"), ["f"], "y")
    q = 1 / (1 + np.exp(-(w[0] * x + w[1])))
    assert abs((q - y) @ x + w[0]) < 1e-6 and abs((q - y).sum()) < 1e-6


def test_bootstrap_covers_the_point(spark):
    rows = [("g", i, float(i % 7), float(i % 7 + 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i int, a double, b double")
    r = resample.bootstrap(df, ["g"], "a", "b", ["i"], 200, percent=False).first()
    assert r["lo"] <= 1.0 <= r["hi"] and r["replicates"] == 200
    again = resample.bootstrap(df.repartition(3), ["g"], "a", "b", ["i"], 200, percent=False).first()
    assert abs(r["lo"] - again["lo"]) < 1e-9


def test_propensity_has_an_interval(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=120)
    rows = [(i, float(a), bool(rng.random() < 0.5 / (1 + np.exp(-2 * a)))) for i, a in enumerate(x)]
    out = propensity.pu_propensity(spark.createDataFrame(rows, "k int, f double, y boolean"), ["k"], ["f"], "y").collect()
    assert len(out) == 120 and all(0 <= r["p_ai_lo"] <= r["p_ai_hi"] <= 1 for r in out)
    assert sum(r["p_ai_lo"] < r["p_ai_hi"] for r in out) > 60


def test_bootstrap_ci_takes_2000_replicates(monkeypatch):
    from ledgerline.plans import queries

    seen = []
    monkeypatch.setattr(queries, "_dev_ba", lambda *a: None)
    monkeypatch.setattr(resample, "bootstrap", lambda *a, n=2000, **k: seen.append(a[5] if len(a) > 5 else n))
    queries.bootstrap_ci(None, None)
    assert seen == [2000]


def test_records(spark, tmp_path):
    rec = {"schema": 1, "provider": "p", "repo_id": "42", "name": "o/r", "months": [{"ym": "2024-01", "lang": "python", "ins": 3, "del": 1, "files": 1, "commits": 1}], "signatures": {"repo": {}, "authors": {"d1": {"x": "2024-01"}}}, "style": {"d1": {"2024-01": {"chars": 23.0, "total": 1}}}, "authors": [{"dev": "d1", "ym": "2024-01", "ins": 3, "del": 1, "commits": 1, "langs": ["python"]}]}
    lines = [json.dumps(rec), "", "{broken", json.dumps(rec | {"repo_id": "43"})]
    (tmp_path / "records-0.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "failures-0.jsonl").write_text("{}\n")
    got = records.read_records(spark, str(tmp_path))
    assert [r["repo_id"] for r in got.collect()] == ["42"]
    a = records.authors_of(got).first()
    assert a["dev_has_sig"] and a["msg_chars"] == 23.0 and a["size_mean"] == 0.0 and a["churn"] == 4
    assert records.months_of(got).count() == 1


def test_repo_list(spark):
    lines = ["https://github.com/o/r.git", "o/r", "git@github.com:o/r.git", '{"clone_url":"https://h/o/r.git","meta":{}}', "# note", ""]
    got = [(r["name"], r["clone_url"]) for r in records.read_repo_list(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert got == [("o/r", "https://github.com/o/r.git"), ("o/r", "https://github.com/o/r.git"), ("git@github.com:o/r", "git@github.com:o/r.git"), ("o/r", "https://h/o/r.git")]


def test_logs(spark, tmp_path):
    churn = tmp_path / "churn.log"
    churn.write_text("\x01abc\x1f2024-01-06T10:00:00+02:00\x1fa@b.C\x1fAnn\n\n3\t1\tsrc/{old => new}/a.py\n-\t-\tsrc/b.py\n1\t1\tvendor/x.py\n")
    got = {(r["path"], r["ins"], r["del"], r["ym"]) for r in records.read_churn_log(spark, str(churn)).collect()}
    assert got == {("src/new/a.py", 3, 1, "2024-01"), ("src/b.py", 0, 0, "2024-01")}
    messages = tmp_path / "messages.log"
    messages.write_text("2024-01-06T10:00:00+02:00\x1fa@b\x1fAnn\x1ffix: x\nbody\n\x1e\n2024-02-06T10:00:00+02:00\x1fa@b\x1fAnn\x1fadd y\n\x1e")
    assert [r["ym"] for r in records.read_message_log(spark, str(messages)).collect()] == ["2024-01", "2024-02"]
