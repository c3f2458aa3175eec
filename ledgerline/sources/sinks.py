"""Sinks: shards, failures, tables, results as JSON, the manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Panels that have a CSV beside their Parquet table.
CSV_PANELS = ("repo-meta", "repo-month", "mentions-month")
#: The manifest's fields, fixed.
MANIFEST = ["url", "provider", "repo_id", "name", "used_for_analysis", "exclusion_reasons", "contributors", "commits", "source_sloc_added", "source_sloc_deleted", "first_month", "last_month", "span_months", "active_months", "max_gap_months", "languages", "ai_signatures", "first_ai_month", "ai_author_share", "p_ai", "p_ai_detail"]


def write_records(records: DataFrame, folder: str, shard: int = 200, mode: str = "append") -> None:
    """SK1: JSON lines in files that read_records finds, `shard` records a file.

    Files are written under other names and renamed when they are whole, so a
    reader (or a stream of this folder) never sees half a shard."""
    spark = records.sparkSession
    stage = f"{folder}/.stage-{id(records):x}"
    records.write.mode("overwrite").option("maxRecordsPerFile", shard).json(stage)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(stage).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if mode == "overwrite":
        for old in fs.globStatus(path(f"{folder}/records-*.jsonl")) or []:
            fs.delete(old.getPath(), False)
    run = spark.sql("select uuid()").first()[0][:8]
    for i, f in enumerate(fs.globStatus(path(f"{stage}/part-*")) or []):
        fs.rename(f.getPath(), path(f"{folder}/records-{run}-{i:05d}.jsonl"))
    fs.delete(path(stage), True)


def write_failures(failures: DataFrame, folder: str) -> None:
    """SK2: provider, repo_id, name and reason as JSON lines, beside the records."""
    failures.select("provider", "repo_id", "name", "reason").write.mode("append").json(f"{folder}/failures")


def write_table(df: DataFrame, folder: str, name: str, csv: bool = True) -> None:
    """SK3: Parquet of one table, and CSV."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    if csv:
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}-csv")


def write_panels(frames: dict[str, DataFrame], folder: str) -> None:
    """SK4: all panels as Parquet, some as CSV too."""
    for name, df in frames.items():
        write_table(df, folder, name, name in CSV_PANELS)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text to any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_json(spark: SparkSession, folder: str, name: str, value: dict) -> None:
    """SK5: a result of a few numbers as one JSON file."""
    write_text(spark, f"{folder}/{name}.json", json.dumps(value, indent=2, default=float))


def manifest(summary: DataFrame, propensity: DataFrame | None = None) -> DataFrame:
    """SK6, P19, J13: 21 fields of each repository (summaries with the gate's verdict),
    the model's p_ai where it has one, else the preliminary one; included first,
    then by contributors and name."""
    blank = summary.sparkSession.createDataFrame([], "repo_id string, p_ai double, p_ai_lo double, p_ai_hi double, label_source string")
    model = blank if propensity is None else propensity.select(F.col("repo_id").cast("string").alias("repo_id"), "p_ai", "p_ai_lo", "p_ai_hi", "label_source")
    x = summary.withColumn("repo_id", F.col("repo_id").cast("string")).join(model.select("repo_id", *(F.col(c).alias(f"_{c}") for c in ("p_ai", "p_ai_lo", "p_ai_hi", "label_source"))), "repo_id", "left")
    first = F.round(T.preliminary_p_ai(F.size("ai_signatures"), F.col("ai_author_share")), 3)
    ci = F.when(F.col("_p_ai_lo").isNotNull(), F.format_string(" [%.2f, %.2f]", "_p_ai_lo", "_p_ai_hi")).otherwise("")
    detail = F.when(F.col("_p_ai").isNotNull(), F.concat(F.format_string("%.3f", "_p_ai"), ci, F.format_string(" (%s)", F.coalesce("_label_source", F.lit("model")))))
    detail = detail.when(first.isNotNull(), F.concat(F.format_string("%.3f", first), F.lit(" (preliminary: signature)"))).otherwise("n/a (pending PU model)")
    out = x.select(
        "url", "provider", "repo_id", "name", F.when(F.col("included"), "yes").otherwise("no").alias("used_for_analysis"), "exclusion_reasons", "contributors", "commits",
        F.col("source_added").alias("source_sloc_added"), F.col("source_deleted").alias("source_sloc_deleted"), "first_month", "last_month", "span_months", "active_months", "max_gap_months",
        F.array_join("languages", ",").alias("languages"), F.array_join("ai_signatures", ",").alias("ai_signatures"), F.coalesce("first_ai_month", F.lit("")).alias("first_ai_month"), F.round("ai_author_share", 3).alias("ai_author_share"),
        F.coalesce("_p_ai", first).alias("p_ai"), detail.alias("p_ai_detail"),
    )
    return out.orderBy(F.col("used_for_analysis").desc(), F.desc("contributors"), "name").select(*MANIFEST)


def manifest_text(rows: DataFrame) -> DataFrame:
    """SK6: the manifest's rows as text, a block of lines each, in their order."""
    c, n = F.col, F.format_string
    listed = lambda k, empty: F.when(c(k) == "", empty).otherwise(F.replace(c(k), F.lit(","), F.lit(", ")))
    lines = [
        c("url"), F.concat(F.lit("    used_for_analysis: "), c("used_for_analysis")), F.when(c("exclusion_reasons") != "", F.concat(F.lit("    exclusion_reasons: "), c("exclusion_reasons"))),
        n("    contributors:      %d", c("contributors")), n("    commits:           %d", c("commits")),
        n("    span:              %s..%s (%dm span, %d active, max gap %dm)", F.coalesce("first_month", F.lit("")), F.coalesce("last_month", F.lit("")), c("span_months"), c("active_months"), c("max_gap_months")),
        n("    source_sloc:       +%d / -%d", c("source_sloc_added"), c("source_sloc_deleted")), F.concat(F.lit("    languages:         "), listed("languages", "-")),
        F.concat(F.lit("    ai_signatures:     "), listed("ai_signatures", "none visible"), F.when(c("first_ai_month") != "", F.concat(F.lit(" (first "), c("first_ai_month"), F.lit(")"))).otherwise("")),
        n("    ai_author_share:   %.2f", c("ai_author_share")), F.concat(F.lit("    p_ai:              "), c("p_ai_detail"), F.lit("\n")),
    ]
    return rows.select(F.concat_ws("\n", *lines).alias("value"))


def write_manifest(rows: DataFrame, folder: str) -> None:
    """A sorted file of each form; a row a repository is a small table."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/repo-manifest-csv")
    manifest_text(rows).coalesce(1).write.mode("overwrite").text(f"{folder}/repo-manifest-txt")


def expose(frames: dict[str, DataFrame]) -> None:
    """Panels as views, `repo-month` as repo_month."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name.replace("-", "_"))


