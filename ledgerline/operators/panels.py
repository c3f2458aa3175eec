"""Records and panels: dedup, repository summary, inclusion gate, months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import GATE


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """SC2: of rows with equal keys (null is a value) the first in order."""
    w = Window.partitionBy(*(F.coalesce(F.col(k).cast("string"), F.lit("None")) for k in keys)).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def max_gap(months: DataFrame, keys: list[str]) -> DataFrame:
    """The longest run of months without a row between two that have one."""
    o = T.ym_ord(F.col("ym"))
    step = months.select(*keys, "ym").distinct().withColumn("gap", o - F.lag(o).over(Window.partitionBy(*keys).orderBy("ym")) - 1)
    return step.groupBy(*keys).agg(F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap_months"))


def repo_summary(language_months: DataFrame, author_months: DataFrame) -> DataFrame:
    """Totals, months, gap and contributors of each repository."""
    o = T.ym_ord(F.col("ym"))
    a = language_months.groupBy("repo_id").agg(
        F.sum("ins").alias("source_added"),
        F.sum("del").alias("source_deleted"),
        F.min("ym").alias("first_month"),
        F.max("ym").alias("last_month"),
        (F.max(o) - F.min(o) + 1).alias("span_months"),
        F.count_distinct("ym").alias("active_months"),
        F.array_min(F.collect_set("lang")).alias("first_language"),
    )
    b = author_months.groupBy("repo_id").agg(F.count_distinct("dev").alias("contributors"), F.sum("commits").alias("commits"))
    return a.join(b, "repo_id", "left").join(max_gap(language_months, ["repo_id"]), "repo_id")


def percent(x: Column) -> Column:
    return F.concat(F.bround(100 * x, 0).cast("int").cast("string"), F.lit("%"))


def inclusion(summary: DataFrame, anchor: str, gate: dict = GATE) -> DataFrame:
    """included, and the rules that a repository fails."""
    a = F.lit(T.anchor_ord(anchor))
    pre, post = a - T.ym_ord(F.col("first_month")), T.ym_ord(F.col("last_month")) - a
    ratio = F.when(F.col("span_months") > 0, F.col("active_months") / F.col("span_months")).otherwise(0.0)
    s = lambda c: c.cast("string")
    rules = [
        F.when(pre < gate["pre"], F.concat(F.lit(f"pre-span<{gate['pre']}m (has "), s(pre), F.lit(")"))),
        F.when(post < gate["post"], F.concat(F.lit(f"post-span<{gate['post']}m (has "), s(post), F.lit(")"))),
        F.when(ratio < gate["ratio"], F.concat(F.lit(f"active-ratio<{gate['ratio']:.0%} (has "), percent(ratio), F.lit(")"))),
        F.when(F.col("max_gap_months") > gate["gap"], F.concat(F.lit(f"gap>{gate['gap']}m (has "), s(F.col("max_gap_months")), F.lit(")"))),
        F.when(F.col("contributors") < gate["devs"], F.concat(F.lit(f"contributors<{gate['devs']} (has "), s(F.col("contributors")), F.lit(")"))),
        F.when(F.col("commits") < gate["commits"], F.concat(F.lit(f"commits<{gate['commits']} (has "), s(F.col("commits")), F.lit(")"))),
    ]
    reasons = F.when(F.col("first_month").isNull() | F.col("last_month").isNull(), F.array(F.lit("no-activity"))).otherwise(F.filter(F.array(*rules), lambda x: x.isNotNull()))
    return summary.withColumn("_r", reasons).withColumn("included", F.size("_r") == 0).withColumn("exclusion_reasons", F.array_join("_r", "; ")).drop("_r")


def weighted_suitability(language_months: DataFrame, scores: dict | None = None) -> DataFrame:
    """Churn-weighted mean; without churn that of the first language."""
    c = F.col("ins") + F.col("del")
    s = T.suitability(F.col("lang"), scores)
    first = T.suitability(F.array_min(F.collect_set("lang")), scores)
    return language_months.groupBy("repo_id").agg(F.coalesce(F.try_divide(F.sum(s * c), F.sum(c)), first).alias("suitability_weighted"))


def repo_months(language_months: DataFrame, author_months: DataFrame, anchor: str) -> DataFrame:
    """Churn over languages, developers (1 at least), t, churn a developer."""
    a = language_months.groupBy("repo_id", "ym").agg(F.sum("ins").alias("ins"), F.sum("del").alias("del"), F.sum(F.col("ins") + F.col("del")).alias("churn"), F.sum("commits").alias("commits"))
    d = author_months.groupBy("repo_id", "ym").agg(F.count_distinct("dev").alias("devs"))
    out = a.join(d, ["repo_id", "ym"], "left").withColumn("devs", F.greatest(F.coalesce("devs", F.lit(1)), F.lit(1)))
    return with_t(out, anchor).withColumn("cpd", F.col("churn") / F.col("devs"))


def repo_months_of(rows: DataFrame, anchor: str) -> DataFrame:
    """The same from commit rows: commits count once a language.

    A commit has one author, so what a developer's month tells apart is counted
    there, where it was dealt once, and summed for the month."""
    dealt = rows.select("repo_id", "ym", "dev", "lang", "sha", "ins", "del").repartition("repo_id", "ym", "dev")
    commit = dealt.groupBy("repo_id", "ym", "dev", "lang", "sha").agg(F.sum("ins").alias("ins"), F.sum("del").alias("del"))
    dev = commit.groupBy("repo_id", "ym", "dev").agg(F.sum("ins").alias("ins"), F.sum("del").alias("del"), F.count_if(F.col("lang").isNotNull() & F.col("sha").isNotNull()).alias("commits"))
    out = dev.groupBy("repo_id", "ym").agg(F.sum("ins").alias("ins"), F.sum("del").alias("del"), F.sum(F.col("ins") + F.col("del")).alias("churn"), F.sum("commits").alias("commits"), F.greatest(F.lit(1), F.count("dev")).alias("devs"))
    return with_t(out, anchor).withColumn("cpd", F.col("churn") / F.col("devs"))


def included_only(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Rows of repositories that passed the gate."""
    return df.join(meta.where(T.as_bool(F.col("included"))).select("repo_id"), "repo_id", "left_semi")


def with_meta(df: DataFrame, meta: DataFrame, *columns: str) -> DataFrame:
    """Rows with columns of their repository, null where it has none."""
    return df.join(meta.select("repo_id", *columns), "repo_id", "left")


def with_t(df: DataFrame, anchor: str) -> DataFrame:
    return df.withColumn("t", T.ym_ord(F.col("ym")) - T.anchor_ord(anchor))


def mention_series(months: DataFrame, now: str | None = None) -> DataFrame:
    """Mentions of all repositories by month, up to the present one.

    any_mention is the sum over terms, the rate that of commits; null without
    commits.  now: 'yyyy-MM', by default today's."""
    terms = [c for c in months.columns if c.startswith("mentions_")]
    last = F.date_format(F.current_timestamp(), "yyyy-MM") if now is None else F.lit(now)
    g = months.where(F.col("ym") <= last).groupBy("ym").agg(*(F.sum(c).alias(c) for c in terms), F.sum("total_commits").alias("total_commits"))
    any_ = F.lit(0)
    for c in terms:
        any_ = any_ + F.col(c)
    return g.withColumn("any_mention", any_).withColumn("mention_rate", F.try_divide("any_mention", "total_commits"))


def primary_language(declared: Column, langs: Column) -> Column:
    """The declared one, else the first by name."""
    return F.lower(F.coalesce(declared, F.array_min(langs), F.lit(T.OTHER)))
