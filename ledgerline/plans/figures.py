"""SK7 to SK15: the figures' data, a table each; drawing them is left to others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ranking
from ..operators.resample import interval, replicate_sums, row_key
from ..schemas import MENTION_TERMS

GRID, REFITS, BINS, FOREST = 50, 300, 20, 14


def event_study(results: DataFrame) -> DataFrame:
    """SK8: percent excess by t."""
    return results.select("t", *((100 * F.col(c)).alias(c) for c in ("mean_excess", "lo", "hi"))).orderBy("t")


def dose_points(dose: DataFrame, x: str, y: str = "post_excess") -> DataFrame:
    """SK9, SK13: the points, y in log points times 100."""
    return dose.where(F.col(x).isNotNull()).select(F.col(x).alias("x"), (100 * F.col(y)).alias("y"))


def dose_line(dose: DataFrame, x: str, keys: list[str], y: str = "post_excess", grid: int = GRID, refits: int = REFITS, key: Column | None = None) -> DataFrame:
    """SK9, SK13: the fitted line on a grid over x with the band of refits of
    resampled points; no rows under two points."""
    rows = dose.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), (100 * F.col(y)).alias("_y"))
    key = row_key(*keys) if key is None else key
    fit = rows.agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.regr_slope("_y", "_x").alias("b"), F.regr_intercept("_y", "_x").alias("a")).where("n >= 2")
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: F.struct(i.alias("i"), (F.col("lo") + (F.col("hi") - F.col("lo")) * i / (grid - 1)).alias("x"))))
    line = fit.select(at.alias("g"), "a", "b").select("g.i", "g.x", (F.col("a") + F.col("b") * F.col("g.x")).alias("y"))
    products = rows.withColumn("_xx", F.col("_x") * F.col("_x")).withColumn("_xy", F.col("_x") * F.col("_y"))
    g = replicate_sums(products, [], ["_x", "_y", "_xx", "_xy"], key, refits, 0)
    k = F.col("_k")
    slope = F.try_divide(k * F.col("_xy") - F.col("_x") * F.col("_y"), k * F.col("_xx") - F.col("_x") * F.col("_x"))
    fits = g.withColumn("b", slope).where("b is not null").withColumn("a", (F.col("_y") - F.col("b") * F.col("_x")) / k).select(F.col("a").alias("ra"), F.col("b").alias("rb"))
    band = interval(line.select("i", "x").crossJoin(F.broadcast(fits)), ["i"], F.col("ra") + F.col("rb") * F.col("x"))  # grid times refits
    return line.join(band.drop("replicates"), "i", "left").orderBy("i").select("x", "y", "lo", "hi")


def management_kpi(kpi: DataFrame) -> DataFrame:
    """SK10: two bars, 100 and the index, with the change in percent."""
    bar = lambda label, v, p: F.struct(F.lit(label).alias("label"), v.alias("value"), p.alias("pct"))
    return kpi.select(F.inline(F.array(bar("before", F.lit(100.0), F.lit(None).cast("double")), bar("after", F.col("index"), F.col("pct")))))


def propensity_bins(prop: DataFrame) -> DataFrame:
    """SK11: rows of each label in BINS bins of [0, 1]; the last one is closed."""
    b = F.least(F.width_bucket("p_ai", F.lit(0.0), F.lit(1.0), F.lit(BINS)), F.lit(BINS))
    rows = prop.where(F.col("p_ai").isNotNull() & F.col("label_source").isin("inferred", "signature-positive"))
    return rows.groupBy("label_source", b.alias("bin")).agg(F.count("*").alias("n")).select("label_source", ((F.col("bin") - 1) / BINS).alias("from"), (F.col("bin") / BINS).alias("to"), "n").orderBy("label_source", "from")


def propensity_forest(prop: DataFrame, keys: list[str], show: int = FOREST) -> DataFrame:
    """SK11, S5: inferred rows even by rank of p_ai, at most `show`.

    Rows are ranged by p_ai into parts of like size, so no task ranks them all
    and ties of one p_ai, which keys order, are no more to a task than others."""
    rows = prop.where("p_ai is not null and label_source = 'inferred'").select(*keys, "p_ai", "p_ai_lo", "p_ai_hi")
    rows = ranking.ranked(rows, [], ["p_ai", *keys])
    n, last = F.col("_size"), F.least(F.lit(show), F.col("_size")) - 1
    # The i-th of those shown has rank round(i (n - 1) / (m - 1)), halves to even.
    wanted = lambda i: F.bround(F.try_divide(i * (n - 1), last), 0)
    i = F.round(F.try_divide(F.col("_rank") * last, n - 1), 0)
    shown = F.when(n <= show, True).when(last == 0, F.col("_rank") == 0).otherwise(wanted(i) == F.col("_rank"))
    return rows.where(shown).withColumn("rank", F.col("_rank").cast("int")).drop("_rank", "_size").orderBy("rank")


def before_after(groups: DataFrame) -> DataFrame:
    """SK12: grouped bars with the change and its interval."""
    return groups.where("n > 0").select("grp", F.col("mean_pre").alias("pre"), F.col("mean_post").alias("post"), "pct_change", "pct_change_lo", "pct_change_hi").orderBy("grp")


def mentions(series: DataFrame) -> DataFrame:
    """SK14: each term's share of a month's commits in percent; terms that never
    occur are left out, the most frequent come first."""
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"mentions_{t}").alias("n")) for t in MENTION_TERMS if f"mentions_{t}" in series.columns)))
    long = series.select("ym", "total_commits", each.alias("x")).select("ym", "total_commits", "x.*")
    total = long.groupBy("term").agg(F.sum("n").alias("total")).where("total > 0")
    return long.join(F.broadcast(total), "term").select("ym", "term", F.try_divide(100 * F.col("n"), "total_commits").alias("share"), "total").orderBy(F.desc("total"), "term", "ym")


def changepoints(histogram: DataFrame) -> DataFrame:
    """SK15: strong breakpoints by month."""
    return histogram.select("breakpoint_ym", "n_breakpoints").orderBy("breakpoint_ym")


def all_figures(load) -> dict[str, DataFrame]:
    """SK7: every figure whose tables are there; load(name) raises FileNotFoundError
    for a table that isn't, which leaves out that figure only."""
    wanted = {
        "fig-event-study": lambda: event_study(load("event-study")),
        "fig-dose-response-points": lambda: dose_points(load("dose-response"), "suitability_weighted"),
        "fig-dose-response-line": lambda: dose_line(load("dose-response"), "suitability_weighted", ["repo_id"]),
        "fig-management-kpi": lambda: management_kpi(load("management-kpi")),
        "fig-propensity-bins": lambda: propensity_bins(load("propensity-repo")),
        "fig-propensity-forest": lambda: propensity_forest(load("propensity-repo"), ["repo_id"]),
        "fig-before-after": lambda: before_after(load("before-after-groups")),
        "fig-dev-before-after": lambda: before_after(load("dev-before-after-groups")),
        "fig-dev-dose-response-points": lambda: dose_points(load("dev-dose-response"), "p_ai"),
        "fig-dev-dose-response-line": lambda: dose_line(load("dev-dose-response"), "p_ai", ["repo_id", "dev"]),
        "fig-mentions-timeseries": lambda: mentions(load("mentions-timeseries")),
        "fig-style-changepoints": lambda: changepoints(load("style-changepoint-histogram")),
    }
    out = {}
    for name, make in wanted.items():
        try:
            out[name] = make()
        except FileNotFoundError:
            continue
    return out
