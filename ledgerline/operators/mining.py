"""Commit-level rows to monthly aggregates.

A commit file row has repo_id, dev, sha, ts (timestamp in the author's own
offset), ym, lang, ins, del.  Each function is one or two partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def language_months(rows: DataFrame) -> DataFrame:
    """A1: churn, files and distinct commits by repository, month, language."""
    return rows.groupBy("repo_id", "ym", "lang").agg(F.sum("ins").alias("ins"), F.sum("del").alias("del"), F.count("*").alias("files"), F.count_distinct("sha").alias("commits"))


def activity_months(rows: DataFrame) -> DataFrame:
    """A2: commits, authors and active days by repository and month.

    A commit has one author, and a month is that of ts.  Commits first, then
    developers, then the month: each level counts what the one below has told
    apart, where a developer's month was dealt once, and days are bits."""
    dealt = rows.select("repo_id", "ym", "dev", "sha", F.call_function("shiftleft", F.lit(1).cast("bigint"), F.dayofmonth("ts")).alias("_days")).repartition("repo_id", "ym", "dev")
    commit = dealt.groupBy("repo_id", "ym", "dev", "sha").agg(F.bit_or("_days").alias("_days"))
    dev = commit.groupBy("repo_id", "ym", "dev").agg(F.count("sha").alias("commits"), F.bit_or("_days").alias("_days"))
    return dev.groupBy("repo_id", "ym").agg(F.sum("commits").alias("commits"), F.count("dev").alias("authors"), F.bit_count(F.bit_or("_days")).cast("bigint").alias("active_days"))


#: A language's bit in a set of languages: by name, the last for unknown ones.
KNOWN = sorted({*T.EXTENSIONS.values()})


def language_bit(lang: Column) -> Column:
    at = F.try_element_at(F.create_map(*(F.lit(x) for i, k in enumerate(KNOWN) for x in (k, i))), lang)
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.coalesce(at, F.lit(len(KNOWN))))


def languages_of(bits: Column) -> Column:
    """The names of a set of languages, in order."""
    names = F.array(*map(F.lit, [*KNOWN, T.OTHER]))
    return F.array_sort(F.filter(names, lambda _, i: F.getbit(bits, i) == 1))


def author_months(rows: DataFrame) -> DataFrame:
    """A3-A5 in one pass: a commit's sums first, then the month's.

    Languages are bits of a number, so both steps are plain sums.  Shares are of
    commits whose time is known (a timestamp in the author's own offset)."""
    commit = rows.groupBy("repo_id", "dev", "ym", "sha").agg(F.sum("ins").alias("ins"), F.sum("del").alias("del"), F.bit_or(language_bit(F.col("lang"))).alias("langs"), F.min("ts").alias("ts"))
    size = F.col("ins") + F.col("del")
    hour = F.hour("ts")
    return commit.groupBy("repo_id", "dev", "ym").agg(
        F.sum("ins").alias("ins"),
        F.sum("del").alias("del"),
        F.sum(size).alias("churn"),
        F.count("*").alias("commits"),
        F.bit_or("langs").alias("lang_bits"),
        F.bit_count(F.bit_or("langs")).alias("n_langs"),
        F.avg(size).alias("size_mean"),
        F.stddev_pop(size).alias("size_std"),
        F.max(size).alias("size_max"),
        F.avg((F.weekday("ts") >= 5).cast("int")).alias("weekend_share"),
        F.avg(((hour < 8) | (hour >= 20)).cast("int")).alias("evening_share"),
    )


def first_seen(rows: DataFrame, flags: dict, keys: list[str]) -> DataFrame:
    """The first month of each signature class; flags: class to condition."""
    found = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in flags.items())), lambda x: x.isNotNull())
    return rows.select(*keys, "ym", F.explode(found).alias("cls")).groupBy(*keys, "cls").agg(F.min("ym").alias("first_ym"))


def style_months(rows: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Mean message features and counts of commit classes."""
    # A message's words and class are found once, before its features are.
    rows = rows.select(*keys, F.col(body).alias("_body"), T.words_of(F.col(body)).alias("_words"), T.classify_commit(F.col(body)).alias("_class"))
    cls = F.col("_class")
    return rows.groupBy(*keys).agg(
        *(F.avg(c).alias(n) for n, c in T.message_features(F.col("_body"), F.col("_words")).items()),
        F.count("*").alias("total"),
        F.count_if(cls == "bugfix").alias("bugfix"),
        F.count_if(cls == "feature").alias("feature"),
    )


def mention_months(rows: DataFrame, keys: list[str], flags: dict) -> DataFrame:
    """Commits and those that mention each term."""
    return rows.groupBy(*keys).agg(F.count("*").alias("total_commits"), *(F.count_if(c).alias(f"mentions_{t}") for t, c in flags.items()))
