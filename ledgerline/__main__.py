"""Command line (X4): python -m ledgerline gather|panel|stats|plots|manifest|synth."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .operators import panels
from .plans import figures, study
from .schemas import ANCHOR, GATE
from .sources import hosting, ingest, records, sinks, synth


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerline", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    g = sub.add_parser("gather", help="list, clone and read repositories into records")
    g.add_argument("--provider", default="github", choices=["github", "gitlab", "list"])
    g.add_argument("--query", help="GitHub search")
    g.add_argument("--list", help="file of repositories")
    g.add_argument("--tag", default="github", help="provider of a list's repositories")
    g.add_argument("--token", help="else GITHUB_TOKEN or GITLAB_TOKEN")
    g.add_argument("--base-url", help="GitLab's address")
    g.add_argument("--group", help="GitLab group; all projects without")
    g.add_argument("--include-archived", action="store_true")
    g.add_argument("--no-verify-ssl", action="store_true")
    g.add_argument("--max-pages", type=int, default=10)
    g.add_argument("--no-code-language-filter", action="store_true")
    g.add_argument("--min-recent-commits", type=int, default=20)
    g.add_argument("--recent-window-days", type=int, default=30)
    g.add_argument("--recorded", help="folder of recorded answers, for tests")
    g.add_argument("--target", type=int, default=500)
    g.add_argument("--since", default=ingest.SINCE)
    g.add_argument("--scratch", default="data/raw-cache")
    g.add_argument("--records", default="data/records")
    g.add_argument("--shard-size", type=int, default=200)
    g.add_argument("--per-repo-cap-gb", type=float, default=3.0, help="0: no cap")
    g.add_argument("--clone-timeout", type=float, default=ingest.CLONE_S)
    g.add_argument("--log-timeout", type=float, default=ingest.LOG_S)
    g.add_argument("--time-budget", type=float, help="seconds after which no further page is asked for")
    g.add_argument("--max-concurrency", type=int, help="repositories at a time; by default as many as the cluster has tasks")
    g.add_argument("--min-free-disk-gb", type=float, default=0.0, help="a clone waits until so much is free")
    g.add_argument("--salt", default=os.environ.get("LEDGERLINE_SALT", "ledgerline-v1"), help="of the hashed emails")
    for name, text in (("panel", "records to panels"), ("manifest", "records to the manifest")):
        q = sub.add_parser(name, help=text)
        q.add_argument("--records", default="data/records")
        q.add_argument("--out", default="data/panels" if name == "panel" else "data/results")
        q.add_argument("--anchor", default=ANCHOR)
    s = sub.add_parser("stats", help="panels to results")
    s.add_argument("--panels", default="data/panels")
    s.add_argument("--out", default="data/results")
    f = sub.add_parser("plots", help="results to the figures' tables")
    f.add_argument("--results", default="data/results")
    f.add_argument("--out", default="data/figures")
    y = sub.add_parser("synth", help="synthetic records")
    y.add_argument("-n", "--repos", type=int, default=80)
    y.add_argument("--records", default="data/records")
    y.add_argument("--results", default="data/results")
    y.add_argument("--seed", type=int, default=42)
    return p


def gather(spark: SparkSession, a: argparse.Namespace) -> str:
    options = {"max_pages": a.max_pages, "min_recent_commits": a.min_recent_commits, "recent_window_days": a.recent_window_days, "require_code_language": not a.no_code_language_filter, "include_archived": a.include_archived, "verify_ssl": not a.no_verify_ssl}
    options |= {k: v for k, v in (("query", a.query), ("path", a.list), ("tag", a.tag), ("token", a.token), ("base_url", a.base_url), ("group", a.group), ("recorded", a.recorded)) if v}
    run, pages = f"{a.scratch}/run-{os.getpid()}-{int(time.time())}", iter(range(1 << 30))

    def work(page: DataFrame) -> int:
        """Records of a page's repositories that have none yet."""
        stage = f"{run}/{next(pages)}"
        found = page.dropDuplicates(["provider", "name"])
        try:
            found = records.not_yet_gathered(found, records.read_records(spark, a.records))
        except AnalysisException as e:  # no folder of records yet
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        found.limit(a.target).write.parquet(f"{stage}/repos")
        repos = spark.read.parquet(f"{stage}/repos")
        many = max(1, min(repos.count(), a.max_concurrency or 4 * spark.sparkContext.defaultParallelism))
        logs = ingest.mine_logs(repos.repartition(many), "clone_url", a.since, a.clone_timeout, a.log_timeout, int(a.per_repo_cap_gb * (1 << 30)) or None, a.token, int(a.min_free_disk_gb * (1 << 30)))
        logs.write.parquet(f"{stage}/logs")
        ok, failed = ingest.gather(repos, spark.read.parquet(f"{stage}/logs"), a.salt, time.strftime("%Y-%m", time.gmtime()), a.since)
        ok.write.parquet(f"{stage}/records")
        ok = spark.read.parquet(f"{stage}/records")
        sinks.write_records(ok, a.records, a.shard_size)
        sinks.write_failures(failed, a.records)
        return ok.where(records.FIRST_PART).count()

    if a.provider == "list":
        made = work(hosting.candidates(spark, a.provider, options))
    else:
        made = hosting.page_by_page(hosting.listing(spark, a.provider, options), work, f"{a.scratch}/listing-{a.provider}", a.target, a.time_budget)
    return f"[gather] {made} repositories -> {a.records}"


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("ledgerline").getOrCreate()
    if a.command == "gather":
        said = gather(spark, a)
    elif a.command == "panel":
        frames = study.build_panels(records.read_records(spark, a.records), a.anchor)
        sinks.write_panels(frames, a.out)
        said = f"[panel] {frames['repo-meta'].count()} repositories -> {a.out}"
    elif a.command == "manifest":
        summary = panels.inclusion(records.summaries(records.read_records(spark, a.records)), a.anchor, GATE)
        try:
            model = records.load_table(spark, a.out, "propensity-repo")
        except FileNotFoundError:
            model = None
        rows = sinks.manifest(summary, model)
        sinks.write_manifest(rows, a.out)
        said = f"[manifest] {rows.count()} repositories -> {a.out}"
    elif a.command == "stats":
        frames = {n: records.load_table(spark, a.panels, n) for n in ("repo-meta", "repo-month", "repo-activity", "author-month", "mentions-month")}
        sinks.expose(frames)
        found = study.write(spark, frames, study.run(frames), a.out)
        said = f"[stats] included={found['repos_included']} -> {a.out}"
    elif a.command == "plots":
        made = figures.all_figures(lambda n: records.load_table(spark, a.results, n))
        for name, df in made.items():
            sinks.write_table(df, a.out, name)
        said = f"[plots] {len(made)} figures -> {a.out}"
    else:
        synth.write(spark, a.records, a.results, a.repos, a.seed)
        said = f"[synth] {a.repos} repositories -> {a.records}"
    print(said, file=sys.stderr)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
