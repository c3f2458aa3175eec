"""Event studies, regressions and group contrasts."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T
from ..schemas import AI_GROUP, BIG_JUMP, ES_HI, ES_LO, POST_WINDOW, RESID_CLIP, Z95
from . import regression, resample, selection
from .keep import kept


@F.pandas_udf(DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """M2: 2 (1 - Phi(|z|)), for tables of a few result rows; null stays null."""
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)), na_action="ignore")


def tested(df: DataFrame, coef: str = "slope", se: str = "se") -> DataFrame:
    """M2: adds z and p; both null where the error is null or zero."""
    z = F.when(F.col(se) > 0, F.col(coef) / F.col(se))
    return df.withColumn("z", z).withColumn("p", two_sided_p("z"))


def event_study(fitted: DataFrame, lo: int = ES_LO, hi: int = ES_HI) -> DataFrame:
    """Mean excess at each t, averaged in logs; no interval from one entity."""
    g = fitted.where(F.col("t").between(lo, hi)).groupBy("t").agg(F.avg("resid").alias("m"), F.stddev_samp("resid").alias("sd"), F.count("*").alias("n"))
    sem = F.when(F.col("n") > 1, F.col("sd") / F.sqrt("n"))
    return g.select("t", F.expm1("m").alias("mean_excess"), sem.alias("sem"), "n", F.expm1(F.col("m") - 1.96 * sem).alias("lo"), F.expm1(F.col("m") + 1.96 * sem).alias("hi"))


def post_excess(fitted: DataFrame, keys: list[str], window: int = POST_WINDOW) -> DataFrame:
    return fitted.where(F.col("t").between(0, window)).groupBy(*keys).agg(F.avg("resid").alias("post_excess"))


def simple_ols(df: DataFrame, y: str, x: str, min_n: int = 5) -> DataFrame:
    """Slope, intercept and classical error of y on x; only n below min_n."""
    both = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    g = both.agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"))
    se = F.sqrt((F.col("syy") - F.col("b") * F.col("sxy")) / (F.col("n") - 2) / F.col("sxx"))
    ok = F.col("n") >= min_n
    return g.select("n", F.when(ok, F.col("b")).alias("slope"), F.when(ok, F.col("a")).alias("intercept"), F.when(ok, se).alias("se"), F.when(ok, F.col("b") - Z95 * se).alias("ci_lo"), F.when(ok, F.col("b") + Z95 * se).alias("ci_hi"))


def _float_divide(a: Column, b: Column) -> Column:
    """a / b as floating point has it: infinite or not a number where b is zero."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def clustered_ols(df: DataFrame, y: str, x: str, cluster: str, by: list[str] | None = None, min_n: int | None = 5) -> DataFrame:
    """Slope with a cluster-robust error, factor G/(G-1) (n-1)/(n-2).
    Null below min_n rows; min_n None: a fit of any rows, and where these are too
    few for one, what floating point makes of the formulas.

    Fit and scores are two aggregations; the sandwich of two parameters is
    written out.  by: further keys, each with a fit of its own.
    """
    by = by or []
    both = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    b = F.regr_slope(y, x) if min_n is not None else F.coalesce(F.regr_slope(y, x), F.lit(float("nan")))
    fit = both.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), b.alias("b"), F.regr_sxx(y, x).alias("sxx"))
    scored = both.join(fit, by) if by else both.crossJoin(F.broadcast(fit))  # one row
    u = F.col(y) - F.col("my") - F.col("b") * (F.col(x) - F.col("mx"))
    score = scored.groupBy(*by, cluster).agg(F.sum(u * (F.col(x) - F.col("mx"))).alias("s"), F.min("n").alias("n"), F.min("b").alias("slope"), F.min("sxx").alias("sxx"))
    out = score.groupBy(*by).agg(F.min("n").alias("n"), F.min("slope").alias("slope"), F.count("*").alias("g"), F.min("sxx").alias("sxx"), F.sum(F.col("s") * F.col("s")).alias("ss"))
    if min_n is None:
        ss, ok = _float_divide(F.col("ss") * F.col("g"), F.col("g") - 1), F.lit(True)
        se = _float_divide(F.sqrt(_float_divide(ss * (F.col("n") - 1), F.col("n") - 2)), F.col("sxx"))
    else:
        se = F.sqrt(F.col("ss") * F.try_divide(F.col("g").cast("double"), F.col("g") - 1) * F.try_divide(F.col("n") - 1, F.col("n") - 2)) / F.col("sxx")
        ok = F.col("n") >= min_n
    return out.select(*by, "n", F.when(ok, F.col("slope")).alias("slope"), F.when(ok, se).alias("se"), F.when(ok, F.col("slope") - Z95 * se).alias("ci_lo"), F.when(ok, F.col("slope") + Z95 * se).alias("ci_hi"))


def group_of(p: Column) -> Column:
    return F.when(p >= AI_GROUP, "likely_ai").when(p.isNotNull(), "unlikely_ai")


def before_after(df: DataFrame, keys: list[str], values: dict[str, Column], min_pre: int, min_post: int) -> DataFrame:
    """Mean of each value before and after, and the change in percent."""
    pre, post = F.col("t") < 0, F.col("t") >= 0
    aggs = [F.avg(F.when(side, c)).alias(f"{n}_{v}") for v, c in values.items() for n, side in (("pre", pre), ("post", post))]
    g = df.groupBy(*keys).agg(*aggs, F.count_if(pre).alias("_a"), F.count_if(post).alias("_b")).where((F.col("_a") >= min_pre) & (F.col("_b") >= min_post)).drop("_a", "_b")
    for v in values:
        a, b = F.col(f"pre_{v}"), F.col(f"post_{v}")
        g = g.withColumn(f"pct_change_{v}", F.when(a != 0, 100 * (b - a) / F.abs(a)))
    return g


def with_propensity(df: DataFrame, propensity: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their p_ai and label_source, null where there is none."""
    return df.join(propensity.select(*keys, "p_ai", "label_source"), keys, "left")


def heterogeneity(df: DataFrame, within: list[str] | None = None, x: str = "post_excess", group: str = "grp") -> DataFrame:
    """How the excess spreads within a group, over rows that are not clipped.

    share_clipped is that of all rows of `within` (of all rows, if empty)
    before the clipped ones go; a group of clipped rows only has n 0.
    """
    within = within or []
    by = [*within, group]
    rows = df.where(F.col(x).isNotNull() & F.col(group).isNotNull())
    # No excess where it is clipped: such a row counts among all rows only.
    rows = kept(rows.select(*by, F.when(F.abs(F.col(x)) < RESID_CLIP - 1e-6, F.expm1(x)).alias("_e")))
    e = F.col("_e")
    g = rows.groupBy(*by).agg(F.count("*").alias("_all"), F.count(e).alias("n"), F.avg((e >= BIG_JUMP).cast("int")).alias("share_big_jump"), F.stddev_samp(e).alias("sd"))
    g = g.join(selection.quantiles(rows, by, {"p90": ("_e", 0.9), "median": ("_e", 0.5)}), by)
    w = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    clipped = F.sum(F.col("_all") - F.col("n")).over(w) / F.sum("_all").over(w)
    return g.withColumn("share_clipped", clipped).select(*by, "n", "share_clipped", "share_big_jump", "sd", "p90", "median")


def top_gainers(df: DataFrame, n: int = 25, x: str = "post_excess") -> DataFrame:
    """The n rows of largest excess that is not clipped, ties by repo_id and dev."""
    free = df.where(F.col("p_ai").isNotNull() & (F.abs(F.col(x)) < RESID_CLIP - 1e-6))
    return free.select("repo_id", "dev", "p_ai", "label_source", F.round(F.expm1(x), 3).alias("pct_excess")).orderBy(F.desc("pct_excess"), "repo_id", "dev").limit(n)


def percent_by_group(df: DataFrame, pre: str, post: str, key: Column, by: list[str] | None = None, n: int = 2000, seed: int = 11) -> DataFrame:
    """Means before and after by group, the change in percent and its interval."""
    by = by or ["grp"]
    rows = df.where(F.col(by[-1]).isNotNull())
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(pre).alias("mean_pre"), F.avg(post).alias("mean_post"))
    g = g.withColumn("pct_change", F.when(F.col("mean_pre") != 0, 100 * (F.col("mean_post") - F.col("mean_pre")) / F.col("mean_pre")))
    ci = resample.bootstrap(rows, by, pre, post, key, n, seed).select(*by, F.col("lo").alias("pct_change_lo"), F.col("hi").alias("pct_change_hi"))
    return g.join(ci, by, "left")


def difference_by_group(df: DataFrame, pre: str, post: str, key: Column, by: list[str] | None = None, n: int = 2000, seed: int = 17) -> DataFrame:
    """Differences of the groups' means (with interval) and of their medians."""
    by = by or ["grp"]
    rows = df.where(F.col(by[-1]).isNotNull() & F.col(pre).isNotNull() & F.col(post).isNotNull())
    rows = kept(rows.select(*by, F.col(pre).alias("_pre"), F.col(post).alias("_post"), key.cast("bigint").alias("_key")))
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_pre").alias("mean_pre"), F.avg("_post").alias("mean_post"), F.avg((F.col("_post") > F.col("_pre")).cast("int")).alias("share_up"))
    g = g.join(selection.quantiles(rows, by, {"median_pre": ("_pre", 0.5), "median_post": ("_post", 0.5)}), by)
    g = g.withColumn("mean_diff", F.col("mean_post") - F.col("mean_pre")).withColumn("median_diff", F.col("median_post") - F.col("median_pre"))
    ci = resample.bootstrap(rows, by, "_pre", "_post", F.col("_key"), n, seed, percent=False).select(*by, F.col("lo").alias("mean_diff_lo"), F.col("hi").alias("mean_diff_hi"))
    return g.join(ci, by, "left")


def by_tier(dose: DataFrame, tiers: DataFrame, keys: list[str], schemes: tuple[str, ...] = ("tier_relative", "tier_absolute")) -> DataFrame:
    """Rows once for each scheme, with its name and the row's tier; rows without one go."""
    long = tiers.select(*keys, F.explode(F.array(*(F.struct(F.lit(s).alias("scheme"), F.col(s).alias("tier")) for s in schemes))).alias("_s")).select(*keys, "_s.*")
    return dose.join(long, keys)


def tier_slopes(dose: DataFrame, tiers: DataFrame, y: str = "post_excess", x: str = "p_ai", cluster: str = "repo_id", min_n: int | None = 5) -> DataFrame:
    """The clustered slope within each tier of both schemes."""
    return clustered_ols(by_tier(dose, tiers, ["repo_id", "dev"]), y, x, cluster, ["scheme", "tier"], min_n)


def placebo_rows(df: DataFrame, anchor: str, placebo_anchor: str) -> DataFrame:
    """rows before the anchor, with t about another one before it."""
    return df.where(F.col("ym") < anchor).withColumn("t", T.ym_ord(F.col("ym")) - T.anchor_ord(placebo_anchor))


def pooled_interaction(panel: DataFrame) -> DataFrame:
    """Pooled regression of log churn a developer on post, suitability
    (centred), their product, t, age (centred, in months) and its square,
    clustered by repository.  Under 30 rows give none.  Where all repositories
    start together t and age say the same and share the solution of least norm."""
    w = Window.partitionBy("repo_id")
    x = panel.where(F.col("suitability").isNotNull()).select("repo_id", "suitability", "t", (F.col("t") >= 0).cast("double").alias("post"), (F.col("t") - F.min("t").over(w)).cast("double").alias("age"), F.log1p("cpd").alias("y"))
    x = kept(x)
    means = x.agg(F.avg("suitability").alias("s"), F.avg("age").alias("a")).first()
    suit, age = F.col("suitability") - F.lit(means["s"]), F.col("age") - F.lit(means["a"])
    terms = {"const": F.lit(1.0), "post": F.col("post"), "suitability": suit, "post_x_suitability": F.col("post") * suit, "t": F.col("t"), "age": age, "age_sq": age * age}
    return regression.ols(x, F.col("y"), terms, cluster="repo_id", min_n=30).drop("n")


def management_kpi(panel: DataFrame) -> DataFrame:
    """Lines added a developer-month before and after, as an index and in percent."""
    x = F.col("ins") / F.col("devs")
    k = panel.agg(F.avg(F.when(F.col("t") < 0, x)).alias("pre"), F.avg(F.when(F.col("t") >= 0, x)).alias("post"))
    return k.withColumn("index", F.when(F.col("pre") != 0, 100 * F.col("post") / F.col("pre"))).withColumn("pct", F.col("index") - 100)
