"""The whole study: records to panels, panels to result tables and a summary.

`build_panels` and `run` return data frames by name; nothing is written or
collected but the few rows that the summary and small JSON files need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import changepoint, contrasts, counterfactual, developer, panels, propensity
from ..operators.resample import row_key
from ..schemas import ANCHOR, CP_EFFECT, CP_P, GATE, PLACEBO_ANCHOR, PLACEBO_WINDOW, POST_WINDOW
from ..sources import records as R
from ..sources import sinks

STYLE_FEATURES = ["msg_chars", "msg_words", "msg_has_bullets", "msg_unique_word_ratio", "size_std"]
LANGUAGE_FEATURES = ["n_langs"]
TIME_FEATURES = ["weekend_share", "evening_share"]
SHARE_FEATURES = ["feature_share", "bugfix_share"]
BATTERIES = {"stylometry": STYLE_FEATURES, "language_breadth": LANGUAGE_FEATURES, "time_patterns": TIME_FEATURES, "bugfix_feature_share": SHARE_FEATURES}
DEV = ["repo_id", "dev"]


def build_panels(records: DataFrame, anchor: str = ANCHOR, gate: dict = GATE) -> dict[str, DataFrame]:
    """The five panels of deduplicated records."""
    months = R.months_of(records)
    churn = F.col("ins") + F.col("del")
    summary = panels.inclusion(R.summaries(records), anchor, gate)
    weighted = F.aggregate("months", F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c")), lambda a, m: F.struct((a["s"] + T.suitability(m["lang"]) * (m["ins"] + m["del"])).alias("s"), (a["c"] + m["ins"] + m["del"]).alias("c")))
    first = T.suitability(F.coalesce(F.try_element_at("languages", F.lit(1)), F.lit("")))
    primary = panels.primary_language(F.nullif("meta.primary_language", F.lit("")), F.when(F.size("languages") > 0, F.col("languages")))
    meta = summary.withColumn("_w", weighted).select(
        "repo_id", "provider", "name", "url", primary.alias("primary_language"), T.suitability(primary).alias("suitability_primary"),
        F.round(F.when(F.col("_w.c") > 0, F.col("_w.s") / F.col("_w.c")).otherwise(first), 4).alias("suitability_weighted"),
        "contributors", "commits", "source_added", "source_deleted", "first_month", "last_month", "span_months", "active_months", "max_gap_months", "included", "exclusion_reasons",
        (F.size("ai_signatures") > 0).alias("has_signature"), F.coalesce("first_ai_month", F.lit("")).alias("first_ai_month"), F.round("ai_author_share", 4).alias("ai_author_share"), F.col("meta.stars").alias("stars"),
    )
    month = months.select("repo_id", "ym", "lang", "ins", "del", churn.alias("churn"), (F.col("ins") - F.col("del")).alias("net"), "files", "commits", T.suitability(F.col("lang")).alias("suitability"))
    t = lambda df: panels.with_t(df, anchor)
    return {"repo-meta": meta, "repo-month": t(month), "repo-activity": t(R.activity_of(records)), "author-month": t(R.authors_of(records)), "mentions-month": t(R.mentions_of(records))}


def _groups(df: DataFrame) -> DataFrame:
    return df.withColumn("grp", contrasts.group_of(F.col("p_ai")))


def run(frames: dict[str, DataFrame], anchor: str = ANCHOR, placebo_anchor: str = PLACEBO_ANCHOR, now: str | None = None, replicates: int = 2000) -> dict[str, DataFrame]:
    """Result tables by name.  Sorted tables carry their order."""
    meta, am = frames["repo-meta"], frames["author-month"]
    rm = panels.repo_months(frames["repo-month"], am, anchor)
    inc = panels.included_only(rm, meta)
    am_inc = panels.included_only(am, meta)
    out: dict[str, DataFrame] = {}

    excess = counterfactual.seasonal(inc, ["repo_id"], F.col("cpd"))
    out["event-study"] = contrasts.event_study(excess).orderBy("t")
    dose = panels.with_meta(contrasts.post_excess(excess, ["repo_id"]), meta, "suitability_weighted", "primary_language").where("suitability_weighted is not null")
    out["dose-response"] = dose.orderBy("suitability_weighted")
    out["dose-response-fit"] = contrasts.tested(contrasts.simple_ols(dose, "post_excess", "suitability_weighted"))
    out["backbone"] = contrasts.pooled_interaction(panels.with_meta(inc, meta, "suitability_weighted").withColumnRenamed("suitability_weighted", "suitability"))
    out["management-kpi"] = contrasts.management_kpi(inc)
    out["placebo"] = counterfactual.placebo(rm, ["repo_id"], F.col("cpd"), anchor, placebo_anchor, PLACEBO_WINDOW, True)

    rf = developer.repo_features(rm, meta)
    prop_repo = propensity.pu_propensity(rf, ["repo_id"], propensity.features_of(rf), "has_signature", 200)
    out["propensity-repo"] = panels.with_meta(prop_repo, meta, "name", "url").orderBy(F.desc_nulls_last("p_ai"), "repo_id")
    af = developer.author_features(am, meta)
    prop = propensity.pu_propensity(af, DEV, propensity.features_of(af), "has_sig", 100)
    out["propensity-author"] = prop.orderBy(F.desc_nulls_last("p_ai"), *DEV)

    per_dev = {"ins": F.col("ins") / F.col("devs"), "churn": F.col("churn") / F.col("devs"), "net": (F.col("ins") - F.col("del")) / F.col("devs")}
    ba = contrasts.with_propensity(panels.with_meta(contrasts.before_after(inc, ["repo_id"], per_dev, 3, 3), meta, "name", "url", "primary_language"), prop_repo, ["repo_id"])
    out["before-after"] = ba.orderBy(F.desc_nulls_last("p_ai"), "repo_id")
    out["before-after-groups"] = contrasts.percent_by_group(_groups(ba), "pre_churn", "post_churn", row_key("repo_id"), n=replicates)

    dev_excess = counterfactual.two_parameter(am_inc, DEV, F.col("churn"))
    out["dev-event-study"] = contrasts.event_study(dev_excess).orderBy("t")
    dev_dose = contrasts.with_propensity(contrasts.post_excess(dev_excess, DEV), prop, DEV).where("p_ai is not null")
    out["dev-dose-response"] = dev_dose.orderBy(F.desc("p_ai"), *DEV)
    out["dev-dose-response-fit"] = contrasts.tested(contrasts.clustered_ols(dev_dose, "post_excess", "p_ai", "repo_id"))
    out["dev-placebo"] = counterfactual.placebo(am_inc, DEV, F.col("churn"), anchor, placebo_anchor, PLACEBO_WINDOW, False)
    dev_ba = contrasts.with_propensity(contrasts.before_after(am_inc, DEV, {"churn": F.col("churn")}, 4, 3), prop, DEV)
    out["dev-before-after"] = dev_ba.orderBy(F.desc_nulls_last("p_ai"), *DEV)
    key = row_key(*DEV)
    out["dev-before-after-groups"] = contrasts.percent_by_group(_groups(dev_ba), "pre_churn", "post_churn", key, n=replicates)
    out["dev-difference-groups"] = contrasts.difference_by_group(_groups(dev_ba), "pre_churn", "post_churn", key, n=replicates)
    out["dev-heterogeneity"] = contrasts.heterogeneity(_groups(dev_dose))
    out["dev-top-gainers"] = contrasts.top_gainers(dev_dose)

    out["dev-overlap"] = developer.overlap(am_inc)
    multi = am_inc.groupBy("dev").agg(F.count_distinct("repo_id").alias("k")).where("k > 1").select("dev")
    pooled = am_inc.join(multi, "dev", "left_semi").groupBy("dev", "ym", "t").agg(F.sum("churn").alias("churn"))
    out["dev-pooled-event-study"] = contrasts.event_study(counterfactual.two_parameter(pooled, ["dev"], F.col("churn"))).orderBy("t")

    tiers = developer.tiers(developer.baseline(am_inc, meta), "primary_language")
    out["dev-productivity-tiers"] = tiers
    out["dev-tier-slopes"] = contrasts.tested(contrasts.tier_slopes(dev_dose, tiers))
    by = ["scheme", "tier"]
    out["dev-tier-heterogeneity"] = contrasts.heterogeneity(_groups(contrasts.by_tier(dev_dose, tiers, DEV)), by)
    out["dev-tier-differences"] = contrasts.difference_by_group(_groups(contrasts.by_tier(dev_ba, tiers, DEV)), "pre_churn", "post_churn", key, [*by, "grp"], replicates)
    early = contrasts.placebo_rows(am_inc, anchor, placebo_anchor)
    early_dose = contrasts.with_propensity(contrasts.post_excess(counterfactual.two_parameter(early, DEV, F.col("churn")), DEV), prop, DEV)
    out["dev-tier-placebo"] = contrasts.tested(contrasts.tier_slopes(early_dose, developer.tiers(developer.baseline(early, meta), "primary_language")))

    breadth = developer.breadth(am_inc, prop)
    out["dev-portfolio-breadth"] = breadth
    out["dev-breadth-groups"] = contrasts.difference_by_group(_groups(breadth), "avg_monthly_repos_pre", "avg_monthly_repos_post", row_key("dev"), n=replicates, seed=13)
    for name, months in (("features", am_inc), ("features-placebo", early)):
        battery = developer.feature_battery(developer.shares(months), [f for fs in BATTERIES.values() for f in fs], DEV)
        out[f"dev-{name}"] = contrasts.difference_by_group(_groups(contrasts.with_propensity(battery, prop, DEV)), "pre", "post", key, ["feature", "grp"], replicates)
    out["onboarding"] = developer.onboarding(am_inc, row_key("repo_id", "t"), replicates)
    out["reactivation"] = developer.reactivation(am, propensity=prop)

    out["mentions-timeseries"] = panels.mention_series(frames["mentions-month"], now).orderBy("ym")
    found = changepoint.detect(am_inc, DEV, "msg_chars")
    out["style-changepoints"] = found
    out["style-changepoint-histogram"] = changepoint.histogram(found).orderBy("breakpoint_ym")
    return out


def _one(df: DataFrame) -> dict | None:
    row = df.first()
    return row.asDict(True) if row else None


def _by(df: DataFrame, *keys: str) -> dict:
    """A small table as nested dictionaries of its keys."""
    out: dict = {}
    for r in df.collect():
        d = r.asDict(True)
        at = out
        for k in keys[:-1]:
            at = at.setdefault(str(d.pop(k)), {})
        at[str(d.pop(keys[-1]))] = d
    return out


def summary(frames: dict[str, DataFrame], results: dict[str, DataFrame]) -> dict:
    """Headline numbers.  Only tables of a few rows are collected."""
    counts = frames["repo-meta"].agg(F.count("*").alias("repos_total"), F.count_if("included").alias("repos_included"), F.count_if("has_signature").alias("repos_with_signature")).first().asDict()
    window = lambda name: _one(results[name].where(F.col("t").between(0, POST_WINDOW)).agg(F.avg("mean_excess").alias("m")))["m"]
    m = results["mentions-timeseries"]
    rated = F.when(F.col("mention_rate").isNotNull(), F.struct("mention_rate", "ym"))
    mentions = _one(m.agg(F.count("*").alias("n_months"), F.max_by("ym", F.struct("mention_rate", F.negate(T.ym_ord(F.col("ym"))))).alias("peak_month"), F.max("mention_rate").alias("peak_rate"), F.max("ym").alias("latest_month"), F.max_by("mention_rate", "ym").alias("latest_rate"), F.count(rated).alias("n_rated")))
    changes = _one(results["style-changepoints"].agg(F.count("*").alias("n_devs_evaluated"), F.count_if(changepoint.strong()).alias("n_strong_jumps"), F.count_if(F.col("effect_size") >= CP_EFFECT).alias("n_strong_jumps_effect_only_uncorrected")))
    features = {k: _by(results[k], "feature", "grp") for k in ("dev-features", "dev-features-placebo")}
    batteries = {b: {f: {"by_p_ai_group": features["dev-features"].get(f, {}), "placebo_by_p_ai_group": features["dev-features-placebo"].get(f, {})} for f in fs} for b, fs in BATTERIES.items()}
    tier = lambda name, *keys: _by(results[name], *keys)
    return counts | {
        "mean_post_excess": window("event-study"),
        "dose_response": _one(results["dose-response-fit"]),
        "management_kpi": _one(results["management-kpi"]),
        "placebo_mean_excess": _one(results["placebo"])["mean_excess"],
        "backbone_post_x_suitability": _one(results["backbone"].where("term = 'post_x_suitability'")),
        "before_after_by_ai_group": _by(results["before-after-groups"], "grp"),
        "developer_level": {
            # U4: distinct developers of the study
            "n_devs_analyzed": results["dev-dose-response"].select(*DEV).distinct().count(),
            "mean_post_excess": window("dev-event-study"),
            "dose_response_by_own_p_ai": _one(results["dev-dose-response-fit"]),
            "placebo_mean_excess": _one(results["dev-placebo"])["mean_excess"],
            "before_after_by_p_ai_group": _by(results["dev-before-after-groups"], "grp"),
            "absolute_lines_per_month_by_p_ai_group": _by(results["dev-difference-groups"], "grp"),
            "heterogeneity_by_p_ai_group": _by(results["dev-heterogeneity"], "grp"),
            "cross_repo_overlap": _one(results["dev-overlap"]),
            "cross_repo_pooled": {"mean_post_excess": window("dev-pooled-event-study")},
            "productivity_tiers": {"slopes": tier("dev-tier-slopes", "scheme", "tier"), "log_excess_by_p_ai_group": tier("dev-tier-heterogeneity", "scheme", "tier", "grp"), "absolute_lines_per_month_by_p_ai_group": tier("dev-tier-differences", "scheme", "tier", "grp"), "placebo": tier("dev-tier-placebo", "scheme", "tier")},
            "portfolio_breadth_by_p_ai_group": _by(results["dev-breadth-groups"], "grp"),
            **batteries,
            "first_contributor_rate": _one(results["onboarding"]),
            "reactivation": _one(results["reactivation"]),
        },
        "dedicated_standalone_analyses": {"mentions_timeseries": mentions, "style_changepoints": changes | {"effect_threshold": CP_EFFECT, "perm_p_threshold": CP_P}},
    }


#: Results of a row or two that are written as JSON.
SMALL = ("management-kpi", "placebo", "dev-placebo")


def write(spark: SparkSession, frames: dict[str, DataFrame], results: dict[str, DataFrame], folder: str) -> dict:
    """SK3, SK5: every table, the small ones as JSON, and the summary, which is read
    from the tables as written, so that nothing is worked out twice."""
    for name, df in results.items():
        sinks.write_table(df, folder, name)
    written = {name: R.load_table(spark, folder, name) for name in results}
    for name in SMALL:
        sinks.write_json(spark, folder, name, _one(written[name]) or {})
    found = summary(frames, written)
    sinks.write_json(spark, folder, "stats-summary", found)
    return found
