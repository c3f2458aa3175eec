"""Developers: tiers, breadth, onboarding, gaps, feature batteries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import AI_GROUP, DEV_MIN_POST, DEV_MIN_PRE, REACTIVATION_GAP, TIER_LOW, TIER_MID
from . import ranking, resample
from .keep import few


def baseline(months: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """A developer's mean churn of the months before, with the repository's language."""
    out = months.where("t < 0").groupBy("repo_id", "dev").agg(F.avg("churn").alias("baseline_churn"))
    return out if meta is None else out.join(meta.select("repo_id", "primary_language"), "repo_id", "left")


def tiers(baseline: DataFrame, lang: str = "lang") -> DataFrame:
    """Terciles of the baseline's rank within a language ('mid' for small or
    constant groups), and fixed bins.  Input: repo_id, dev, lang, baseline_churn.
    Ties rank by repo_id and dev; rows without a language have no relative tier.

    A language may hold most developers, and most of those one baseline: ranks
    come from parts of like size (see ranking), not from one task for each.
    """
    rows = ranking.ranked(baseline, [lang], ["baseline_churn", "repo_id", "dev"])
    values = few(rows.groupBy(F.col(lang).alias("_l")).agg(F.count_distinct("baseline_churn").alias("_d")))
    rows = rows.join(values, F.col(lang).eqNullSafe(F.col("_l")))
    third = F.when(F.col(lang).isNull(), None).when((F.col("_size") < 6) | (F.col("_d") < 3), "mid")
    relative = third.when(3 * F.col("_rank") < F.col("_size") - 1, "low").when(3 * F.col("_rank") < 2 * (F.col("_size") - 1), "mid").otherwise("high")
    fixed = F.when(F.col("baseline_churn") <= TIER_LOW, "low").when(F.col("baseline_churn") <= TIER_MID, "mid").otherwise("high")
    return rows.withColumn("tier_relative", relative).withColumn("tier_absolute", fixed).select(*baseline.columns, "tier_relative", "tier_absolute")


def overlap(rows: DataFrame) -> DataFrame:
    """Developers, those in several repositories, the most repositories."""
    d = rows.groupBy("dev").agg(F.count_distinct("repo_id").alias("k"))
    return d.agg(F.count("*").alias("n_devs"), F.count_if(F.col("k") > 1).alias("n_multi"), F.avg((F.col("k") > 1).cast("int")).alias("share_multi"), F.max("k").alias("max_repos"))


def breadth(rows: DataFrame, propensity: DataFrame | None = None) -> DataFrame:
    """Repositories a month and over all, before and after, by developer;
    J8: with the developer's greatest p_ai of any repository."""
    # Once dealt by developer, all that follows stays where it is.
    once = rows.select("dev", "repo_id", "t").repartition("dev").distinct()
    month = once.where("repo_id is not null").groupBy("dev", "t").agg(F.count("*").alias("k"))
    a = month.groupBy("dev").agg(F.avg(F.when(F.col("t") < 0, F.col("k"))).alias("avg_monthly_repos_pre"), F.avg(F.when(F.col("t") >= 0, F.col("k"))).alias("avg_monthly_repos_post"))
    repos = once.where("repo_id is not null").groupBy("dev", "repo_id").agg(F.bool_or(F.col("t") < 0).alias("_pre"), F.bool_or(F.col("t") >= 0).alias("_post"))
    b = repos.groupBy("dev").agg(F.count_if("_pre").alias("lifetime_repos_pre"), F.count_if("_post").alias("lifetime_repos_post"))
    out = a.join(b, "dev").where("avg_monthly_repos_pre is not null and avg_monthly_repos_post is not null")
    return out if propensity is None else out.join(propensity.groupBy("dev").agg(F.max("p_ai").alias("p_ai")), "dev", "left")


def shares(months: DataFrame) -> DataFrame:
    """Share of a month's commits that are features and bug fixes, null without commits."""
    total = F.col("total_commits")
    return months.withColumn("feature_share", F.when(total > 0, F.col("feature_commits") / total)).withColumn("bugfix_share", F.when(total > 0, F.col("bugfix_commits") / total))


def feature_battery(rows: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Mean of each feature before and after by entity; features not in the
    input are left out.  One aggregation of all features side by side; what it
    gives, a row an entity, is dealt to rows of one feature after it."""
    have = [f for f in features if f in rows.columns]
    pre, post = F.col("t") < 0, F.col("t") >= 0
    value = lambda side, f: F.avg(F.when(side, F.col(f).cast("double")))
    g = rows.groupBy(*keys).agg(F.count_if(pre).alias("_a"), F.count_if(post).alias("_b"), *(value(pre, f).alias(f"_pre_{i}") for i, f in enumerate(have)), *(value(post, f).alias(f"_post_{i}") for i, f in enumerate(have)))
    g = g.where((F.col("_a") >= DEV_MIN_PRE) & (F.col("_b") >= DEV_MIN_POST))
    each = F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"_pre_{i}").alias("pre"), F.col(f"_post_{i}").alias("post")) for i, f in enumerate(have))))
    return g.select(*keys, each).select("feature", *keys, "pre", "post")


def first_contributors(rows: DataFrame) -> DataFrame:
    """Share of a repository's developers of a month who are there first."""
    d = rows.select("repo_id", "dev", "t").distinct()
    first = d.withColumn("_f", (F.col("t") == F.min("t").over(Window.partitionBy("repo_id", "dev"))).cast("int"))
    return first.groupBy("repo_id", "t").agg(F.avg("_f").alias("first_share"), F.count("*").alias("devs"))


def onboarding(rows: DataFrame, key: Column, n: int = 2000, seed: int = 23) -> DataFrame:
    """Mean share of newcomers before and after, and the difference's interval.
    key: an integer for each (repo_id, t)."""
    m = first_contributors(rows)
    after = F.col("t") >= 0
    g = m.agg(F.count_if(~after).alias("n_pre"), F.count_if(after).alias("n_post"), F.avg(F.when(~after, F.col("first_share"))).alias("mean_pre"), F.avg(F.when(after, F.col("first_share"))).alias("mean_post"))
    ci = resample.bootstrap_two(m, [], "first_share", after, key, n, seed).select(F.col("lo").alias("mean_diff_lo"), F.col("hi").alias("mean_diff_hi"))
    return g.withColumn("mean_diff", F.col("mean_post") - F.col("mean_pre")).crossJoin(F.broadcast(ci))  # a row each


def gap_episodes(rows: DataFrame, gap: int = REACTIVATION_GAP) -> DataFrame:
    """Silences of at least `gap` months that ended, by developer."""
    d = rows.select("repo_id", "dev", "t").distinct()
    d = d.withColumn("gap_months", F.col("t") - F.lag("t").over(Window.partitionBy("repo_id", "dev").orderBy("t")) - 1)
    return d.where(F.col("gap_months") >= gap).select("repo_id", "dev", "gap_months", F.col("t").alias("resumption_t"))


def reactivation(rows: DataFrame, gap: int = REACTIVATION_GAP, propensity: DataFrame | None = None) -> DataFrame:
    """Episodes before and after the anchor, and a month of either era; with
    a propensity, resumers after the anchor by group."""
    d = rows.select("repo_id", "dev", "t").distinct()
    d = d.withColumn("gap_months", F.col("t") - F.lag("t").over(Window.partitionBy("repo_id", "dev").orderBy("t")) - 1)
    late, back = F.col("t") >= 0, F.col("gap_months") >= gap
    if propensity is not None:
        d = d.join(propensity.select("repo_id", "dev", "p_ai"), ["repo_id", "dev"], "left")
    groups = [] if propensity is None else [F.count_if(back & late & (F.col("p_ai") >= AI_GROUP)).alias("likely_ai"), F.count_if(back & late & (F.col("p_ai") < AI_GROUP)).alias("unlikely_ai")]
    out = d.agg(
        F.count_if(back).alias("n_gap_episodes"), F.count_if(back & ~late).alias("resumptions_pre_anchor"), F.count_if(back & late).alias("resumptions_post_anchor"), *groups,
        F.greatest(F.lit(1), -F.min("t")).alias("pre_era_months"), F.greatest(F.lit(1), F.max("t") + 1).alias("post_era_months"),
    )
    return out.withColumn("per_month_pre", F.col("resumptions_pre_anchor") / F.col("pre_era_months")).withColumn("per_month_post", F.col("resumptions_post_anchor") / F.col("post_era_months"))


def repo_features(months: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Change of churn a developer and of commit size, burstiness and growth;
    J4: with the repository's suitability as f_suit and its has_signature."""
    pre, post = F.col("t") < 0, F.col("t") >= 0
    when = lambda c, x: F.when(c, F.col(x).cast("double"))
    g = months.groupBy("repo_id").agg(
        F.avg(when(pre, "cpd")).alias("a"), F.avg(when(post, "cpd")).alias("b"),
        F.sum(when(pre, "churn")).alias("pc"), F.sum(when(pre, "commits")).alias("pk"), F.sum(when(post, "churn")).alias("qc"), F.sum(when(post, "commits")).alias("qk"),
        F.stddev_samp(when(post, "cpd")).alias("sd"), F.regr_slope(when(post, "cpd"), when(post, "t")).alias("slope"),
        F.count_if(pre).alias("n0"), F.count_if(post).alias("n1"),
    ).where("n0 >= 3 and n1 >= 3")
    size = lambda c, k: F.col(c) / F.greatest(F.lit(1), F.col(k))
    out = g.select(
        "repo_id",
        F.log((F.col("b") + 1) / (F.col("a") + 1)).alias("f_churn_ratio"),
        F.log((size("qc", "qk") + 1) / (size("pc", "pk") + 1)).alias("f_size_ratio"),
        F.coalesce(F.when(F.col("b") != 0, F.col("sd") / F.col("b")), F.lit(0.0)).alias("f_burst"),
        F.coalesce(F.col("slope") / (F.col("b") + 1), F.lit(0.0)).alias("f_growth"),
    )
    return out if meta is None else out.join(meta.select("repo_id", F.col("suitability_weighted").alias("f_suit"), "has_signature"), "repo_id", "left")


def author_features(months: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Change of churn (all months where there are none before), commits and
    active months after; J4: with the repository's suitability as f_suit."""
    pre, post = F.col("t") < 0, F.col("t") >= 0
    g = months.groupBy("repo_id", "dev").agg(F.coalesce(F.avg(F.when(pre, F.col("churn"))), F.avg("churn")).alias("a"), F.avg(F.when(post, F.col("churn"))).alias("b"), F.sum(F.when(post, F.col("commits"))).alias("k"), F.count_if(post).alias("m"), F.bool_or("dev_has_sig").alias("has_sig")).where("m >= 2")
    out = g.select("repo_id", "dev", F.log((F.col("b") + 1) / (F.col("a") + 1)).alias("f_churn_ratio"), F.log1p("k").alias("f_commits"), F.col("m").cast("double").alias("f_active_post"), "has_sig")
    return out if meta is None else out.join(meta.select("repo_id", F.col("suitability_weighted").alias("f_suit")), "repo_id", "left")
