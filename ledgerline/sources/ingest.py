"""Ingest tier: bounded clones and their logs, a repository a task at a time.

Git is not a thing Spark can express, so this is a map over partitions of
repositories.  A clone lives in a task's own temporary folder and goes when its
logs are read; log text leaves the task in pieces of whole commits, so no
history is ever held at once.  X5: how many run at a time is the cluster's
affair; the disk cap and the time limits are kept here.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
import threading
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import records

#: What git prints: fixed formats of the two logs.
CHURN_FORMAT = "%x01%H%x1f%aI%x1f%ae%x1f%an"
MESSAGE_FORMAT = "%aI%x1f%ae%x1f%an%x1f%B%x1e"
SINCE = "2019-01-01"
CLONE_S, LOG_S, DISK_CAP = 900.0, 600.0, 3 << 30
SCHEMA = "provider string, repo_id string, name string, kind string, value string"
PIECE = 1 << 20


class GitFailure(RuntimeError):
    pass


#: SC8b: providers whose repositories are cloned with a token, and where a worker finds it.
TOKENS = {"gitlab": "GITLAB_TOKEN"}
#: Git asks this for a name and a password; the token stays in the environment.
HELPER = '!f() { echo username=oauth2; echo "password=$LEDGERLINE_GIT_TOKEN"; }; f'


def credentials(provider: str | None, token: str | None = None) -> tuple[list[str], dict[str, str]]:
    """SC8b: git's arguments and environment to clone as the token's owner."""
    variable = TOKENS.get(provider or "")
    token = (token or os.environ.get(variable)) if variable else None
    return (["-c", "credential.helper=", "-c", f"credential.helper={HELPER}"], {"LEDGERLINE_GIT_TOKEN": token}) if token else ([], {})


def environment() -> dict[str, str]:
    return os.environ | {"GIT_TERMINAL_PROMPT": "0", "GIT_ASKPASS": "true", "GCM_INTERACTIVE": "never", "LC_ALL": "C"}


def folder_bytes(path: str) -> int:
    total = 0
    for d, _, names in os.walk(path):
        for n in names:
            try:
                total += os.lstat(os.path.join(d, n)).st_size
            except OSError:
                pass
    return total


def _attempt(url: str, dest: str, args: list[str], limit_s: float, cap: int | None, auth: tuple[list[str], dict[str, str]] = ([], {})) -> str:
    """'ok', 'failed', 'timeout' or 'disk_cap'."""
    run = subprocess.Popen(["git", *auth[0], "clone", *args, url, dest], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, env=environment() | auth[1])
    end = time.monotonic() + limit_s
    try:
        while run.poll() is None:
            if time.monotonic() > end:
                return "timeout"
            if cap and folder_bytes(dest) > cap:
                return "disk_cap"
            time.sleep(0.05)
        return "ok" if run.returncode == 0 else "failed"
    finally:
        if run.poll() is None:
            run.kill()
            run.wait()


def clone(url: str, dest: str, since: str = SINCE, limit_s: float = CLONE_S, cap: int | None = DISK_CAP, auth: tuple[list[str], dict[str, str]] = ([], {})) -> bool:
    """SC10: bare, one branch, no tags, history since a day; True if shallow.

    A clone that was too large or too slow is not tried again; one that the
    server refused is tried once more with its whole history."""
    base = ["--bare", "--single-branch", "--no-tags", "--quiet"]
    got = _attempt(url, dest, [*base, f"--shallow-since={since}"], limit_s, cap, auth)
    if got == "ok":
        return True
    shutil.rmtree(dest, ignore_errors=True)
    if got != "failed":
        raise GitFailure(f"clone {got}")
    got = _attempt(url, dest, base, limit_s, cap, auth)
    if got != "ok":
        shutil.rmtree(dest, ignore_errors=True)
        raise GitFailure(f"clone {got}")
    return False


def log(repo: str, args: list[str], cut: bytes, limit_s: float = LOG_S) -> Iterator[str]:
    """SC11, F4: a log's records, parted by `cut`, as they come; the whole must end in time."""
    run = subprocess.Popen(["git", "-C", repo, "log", "--no-merges", *args], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=environment())
    late = threading.Timer(limit_s, run.kill)
    late.start()
    begin, rest = time.monotonic(), b""
    try:
        while chunk := run.stdout.read1(PIECE):
            parts = (rest + chunk).split(cut)
            rest = parts.pop()
            for p in parts:
                yield p.decode("utf-8", "replace")
        run.wait()
        if time.monotonic() - begin >= limit_s:
            raise GitFailure(f"log took more than {limit_s:g} s")
        if rest.strip():
            yield rest.decode("utf-8", "replace")
    finally:
        late.cancel()
        if run.poll() is None:
            run.kill()
            run.wait()


def await_free(folder: str, free: int, limit_s: float, step: float = 1.0) -> None:
    """Hold a clone back until so many bytes are free."""
    end = time.monotonic() + limit_s
    while free and shutil.disk_usage(folder).free < free:
        if time.monotonic() > end:
            raise GitFailure("too little free disk")
        time.sleep(step)


def mine_logs(repos: DataFrame, url: str = "clone_url", since: str = SINCE, clone_s: float = CLONE_S, log_s: float = LOG_S, cap: int | None = DISK_CAP, token: str | None = None, free: int = 0) -> DataFrame:
    """provider, repo_id, name, kind ('churn', 'message', 'shallow' or 'failure'), value.

    token: of the providers in TOKENS, else the worker's environment has it.
    free: bytes that must be free where clones go; a task waits for them as long
    as a clone may take."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["provider", "repo_id", "name", "kind", "value"]
        for batch in batches:
            for r in batch.to_pylist():
                who = [r["provider"], r["repo_id"], r["name"]]

                def rows(kind: str, values: list[str], who=who):
                    return pa.RecordBatch.from_arrays([*(pa.array([x] * len(values), pa.string()) for x in [*who, kind]), pa.array(values, pa.string())], names)

                top = tempfile.mkdtemp(prefix="ledgerline-git-")
                dest = os.path.join(top, "r.git")
                try:
                    await_free(top, free, clone_s)
                    yield rows("shallow", [str(clone(r["url"], dest, since, clone_s, cap, credentials(r["provider"], token))).lower()])
                    for kind, args, cut in (("churn", [f"--since={since}", "--numstat", f"--pretty=format:{CHURN_FORMAT}"], b"\x01"), ("message", [f"--since={since}", f"--pretty=format:{MESSAGE_FORMAT}"], b"\x1e")):
                        held, size = [], 0
                        for value in log(dest, args, cut, log_s):
                            held.append(value)
                            size += len(value)
                            if size > PIECE:
                                yield rows(kind, held)
                                held, size = [], 0
                        if held:
                            yield rows(kind, held)
                except (GitFailure, OSError) as e:
                    yield rows("failure", [f"git: {e}"])
                finally:
                    shutil.rmtree(top, ignore_errors=True)

    return repos.select("provider", "repo_id", "name", F.col(url).alias("url")).mapInArrow(run, SCHEMA)


def gather(repos: DataFrame, logs: DataFrame, salt: str, now_ym: str, since: str = SINCE, gathered_at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Records and failures of mined repositories (logs saved by the caller, as
    both come from them).  Months are kept from `since` to the present one; a
    repository whose log failed half-way has no record."""
    failed = logs.where("kind = 'failure'").select("provider", "repo_id", "name", F.col("value").alias("reason"))
    good = logs.join(failed.select("provider", "repo_id"), ["provider", "repo_id"], "left_anti")
    churn = records.churn_rows(good.where("kind = 'churn'"), "value", "repo_id").where(records.within(F.col("ym"), since[:7], now_ym))
    said = records.message_rows(good.where("kind = 'message'"), "value", "repo_id").where(records.within(F.col("ym"), since[:7], now_ym))
    shallow = good.where("kind = 'shallow'").select("provider", "repo_id", (F.col("value") == "true").alias("shallow"))
    whole = repos.join(shallow, ["provider", "repo_id"])
    at = F.lit(gathered_at) if gathered_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    found = records.assemble(churn, said, whole, salt).withColumn("gathered_at", at).withColumn("baseline_since", F.lit(since))
    empty = whole.join(found.select("provider", "repo_id"), ["provider", "repo_id"], "left_anti").select("provider", "repo_id", "name", F.lit("empty: no source churn in window").alias("reason"))
    return found, failed.unionByName(empty)
