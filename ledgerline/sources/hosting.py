"""Repository listings of hosting services as Python data sources.

`github_search` reads a page of search results a partition, `gitlab_projects`
follows the service's cursor in one partition, `repo_list` is a text file of
repositories.  All give the same columns.  As streams both services give a page
a micro-batch: one cursor and one quota, the page and the quota's reset are the
stream's offset, so a listing ends with what its reader needs and resumes at the
next page.  Requests go through a transport: the network, or with the option
`recorded` a folder of recorded answers, so that every reader can be tested
offline.  Tokens come from the environment of the process that reads, or from an
option; they are in no plan and on no command line.

Another service is one more subclass of RepoSource (X1).
"""

from __future__ import annotations

import json
import os
import ssl
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

META = "primary_language string, stars bigint, forks bigint, created_at string, pushed_at string, size_kb bigint, archived boolean, visibility string, description string"
REPO = f"provider string, repo_id string, name string, clone_url string, default_branch string, meta struct<{', '.join(c.replace(' ', ':', 1) for c in META.split(', '))}>"
FIELDS = [c.split(" ")[0] for c in META.split(", ")]
TRIES = 5
#: Fixed value: the search that a listing starts from.
QUERY = "stars:>100 pushed:>2024-01-01 created:<2021-06-01"


# --- requests ---------------------------------------------------------------


class Answer:
    def __init__(self, status: int, headers: dict[str, str], body: bytes) -> None:
        self.status, self.headers, self.body = status, {k.lower(): v for k, v in headers.items()}, body


def network(verify: bool = True, timeout: float = 30.0) -> Callable[[str, dict], Answer]:
    context = None
    if not verify:
        context = ssl.create_default_context()
        context.check_hostname, context.verify_mode = False, ssl.CERT_NONE

    def get(url: str, headers: dict) -> Answer:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout, context=context) as r:
                return Answer(r.status, dict(r.headers), r.read())
        except urllib.error.HTTPError as e:
            return Answer(e.code, dict(e.headers or {}), b"")

    return get


def recorded(folder: str) -> Callable[[str, dict], Answer]:
    """Answers from answers.json, a list of {url, status, headers, body} in the
    order they are given for a url; the last is given again.  Each request is noted in requests.log."""
    with open(os.path.join(folder, "answers.json"), encoding="utf-8") as f:
        answers = json.load(f)
    given: dict[str, int] = {}

    def get(url: str, headers: dict) -> Answer:
        mine = [a for a in answers if a["url"] == url]
        if not mine:
            return Answer(404, {}, b"")
        with open(os.path.join(folder, "requests.log"), "a", encoding="utf-8") as f:
            f.write(url + "\n")
        i = given.get(url, 0)
        given[url] = i + 1
        a = mine[min(i, len(mine) - 1)]
        if a.get("status") == 0:
            raise urllib.error.URLError("recorded failure")
        return Answer(a.get("status", 200), a.get("headers", {}), json.dumps(a.get("body")).encode())

    return get


class Client:
    """SC9: a GET that retries and keeps to the service's rate limit.

    `limited` statuses wait until the limit's reset (or 1, 2, 4 ... seconds up to
    `longest`), failures of the network 1, 2, 4 ... up to 30; other errors and
    five tries without an answer give None.  After an answer that leaves no more
    than one request it waits too, at once, or with `defer` before the next request
    only (`until` says up to when)."""

    def __init__(self, get: Callable[[str, dict], Answer], headers: dict, prefix: str, limited: tuple[int, ...], longest: float, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.time, defer: bool = False) -> None:
        self.defer, self.until = defer, 0.0
        self.get, self.headers, self.prefix, self.limited, self.longest, self.sleep, self.now = get, headers, prefix.lower(), limited, longest, sleep, now

    def pause(self, headers: dict[str, str], attempt: int) -> float:
        reset = headers.get(f"{self.prefix}-reset", "")
        return max(1.0, int(reset) - self.now()) + 1.0 if reset.strip().isdigit() and int(reset) else min(2.0**attempt, self.longest)

    def wait(self, headers: dict[str, str], attempt: int) -> None:
        self.sleep(self.pause(headers, attempt))

    def json(self, url: str) -> tuple[object, dict[str, str]] | None:
        for attempt in range(TRIES):
            if self.until > self.now():
                self.sleep(self.until - self.now())
            self.until = 0.0
            try:
                a = self.get(url, self.headers)
            except (urllib.error.URLError, TimeoutError):
                self.sleep(min(2.0**attempt, 30.0))
                continue
            if a.status in self.limited:
                self.wait(a.headers, attempt)
                continue
            if a.status >= 400:
                return None
            left = a.headers.get(f"{self.prefix}-remaining", "")
            if left.strip().isdigit() and int(left) <= 1:
                if self.defer:
                    self.until = self.now() + self.pause(a.headers, 0)
                else:
                    self.wait(a.headers, 0)
            return json.loads(a.body.decode("utf-8")), a.headers
        return None


# --- sources ----------------------------------------------------------------


def flag(options: dict, name: str, default: bool) -> bool:
    return str(options.get(name, default)).lower() not in ("0", "false", "")


class RepoSource(DataSource):
    """SC8: a source of repositories.  A subclass names its reader; columns are REPO."""

    def schema(self) -> str:
        return REPO


class _Page(InputPartition):
    def __init__(self, page: int) -> None:
        super().__init__(page)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def transport(self) -> Callable[[str, dict], Answer]:
        return recorded(self.options["recorded"]) if "recorded" in self.options else network(flag(self.options, "verify_ssl", True))

    def token(self, variable: str) -> str | None:
        return self.options.get("token") or os.environ.get(variable)


class _Listing(SimpleDataSourceStreamReader):
    """A service's pages, one a micro-batch.

    The offset is the page to read next (0: there is none), how many were read,
    and the time the quota is there again: what is waited for once, by whoever
    reads on."""

    def __init__(self, pages: _Reader) -> None:
        self.pages = pages

    def initialOffset(self) -> dict:
        return {"page": 1, "read": 0, "until": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if not start["page"]:
            return iter([]), start
        rows, after, until = self._page(start)
        return iter(rows), {"page": after, "read": start["read"] + 1, "until": until}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._page(start)[0])

    def _page(self, start: dict) -> tuple[list[tuple], int, int]:
        client = self.pages.client(defer=True)
        client.until = float(start["until"])
        rows, after = self.pages.page(client, start["page"])
        more = after and start["read"] + 1 < int(self.pages.options.get("max_pages", self.pages.most))
        return list(rows), after if more else 0, int(client.until + 0.999)


class GitHubReader(_Reader):
    most = 10

    def client(self, defer: bool = False) -> Client:
        headers = {"Accept": "application/vnd.github+json", "User-Agent": "ledgerline", "X-GitHub-Api-Version": "2022-11-28"}
        token = self.token("GITHUB_TOKEN")
        return Client(self.transport(), headers | ({"Authorization": f"Bearer {token}"} if token else {}), "X-RateLimit", (403, 429), 60.0, defer=defer)

    def partitions(self) -> list[InputPartition]:
        return [_Page(i) for i in range(1, int(self.options.get("max_pages", self.most)) + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.page(self.client(), partition.value)[0]

    def page(self, client: Client, number: int) -> tuple[Iterator[tuple], int]:
        """A page's repositories and the number of the next page, 0 after the last."""
        o = self.options
        base = o.get("base_url", "https://api.github.com").rstrip("/")
        query = {"q": o.get("query", QUERY), "sort": "updated", "order": "desc", "per_page": min(int(o.get("per_page", 100)), 100), "page": number}
        got = client.json(f"{base}/search/repositories?{urllib.parse.urlencode(query)}")
        items = (got[0].get("items") or []) if got and isinstance(got[0], dict) else []
        return self.rows(client, base, items), number + 1 if items else 0

    def rows(self, client: Client, base: str, items: list[dict]) -> Iterator[tuple]:
        # One call a candidate: without a token the quota does not allow it.
        least = int(self.options.get("min_recent_commits", 20)) if self.token("GITHUB_TOKEN") else 0
        for it in items:
            meta = {"primary_language": it.get("language"), "stars": it.get("stargazers_count"), "forks": it.get("forks_count"), "created_at": it.get("created_at"), "pushed_at": it.get("pushed_at"), "size_kb": it.get("size"), "archived": it.get("archived"), "description": it.get("description")}
            if least and not self.active(client, base, it, least):
                continue
            yield ("github", str(it.get("id")), str(it.get("full_name")), str(it.get("clone_url")), it.get("default_branch") or None, tuple(meta.get(f) for f in FIELDS))

    def active(self, client: Client, base: str, it: dict, least: int) -> bool:
        """enough commits of late; a service that does not say counts as yes."""
        since = self.options.get("since") or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(time.time() - 86400 * int(self.options.get("recent_window_days", 30))))
        query = {"since": since, "per_page": least} | ({"sha": it["default_branch"]} if it.get("default_branch") else {})
        got = client.json(f"{base}/repos/{it.get('full_name')}/commits?{urllib.parse.urlencode(query)}")
        return got is None or not isinstance(got[0], list) or len(got[0]) >= least


class GitHubSearch(RepoSource):
    """SC5: options query, token, max_pages, per_page, base_url, min_recent_commits,
    recent_window_days.  Search answers end after the last page, so pages are
    independent partitions."""

    @classmethod
    def name(cls) -> str:
        return "github_search"

    def reader(self, schema) -> DataSourceReader:
        return GitHubReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Listing(GitHubReader(self.options))


class GitLabReader(_Reader):
    most = 200

    def client(self, defer: bool = False) -> Client:
        token = self.token("GITLAB_TOKEN")
        return Client(self.transport(), {"Accept": "application/json", "User-Agent": "ledgerline"} | ({"PRIVATE-TOKEN": token} if token else {}), "RateLimit", (429,), 30.0, defer=defer)

    def partitions(self) -> list[InputPartition]:
        return [_Page(1)]  # each page names the next

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        client, page = self.client(), 1
        while 0 < page <= int(self.options.get("max_pages", self.most)):
            rows, page = self.page(client, page)
            yield from rows

    def page(self, client: Client, number: int) -> tuple[Iterator[tuple], int]:
        """A page's repositories and the number of the next page, 0 after the last."""
        o = self.options
        if not o.get("base_url"):
            raise ValueError("gitlab_projects needs the option base_url")
        base, group = o["base_url"].rstrip("/"), o.get("group")
        path = f"/api/v4/groups/{urllib.parse.quote(group, safe='')}/projects" if group else "/api/v4/projects"
        fixed = {"include_subgroups": "true"} if group else {"order_by": "id", "sort": "asc", "statistics": "false"}
        if not flag(o, "include_archived", False):
            fixed["archived"] = "false"
        got = client.json(f"{base}{path}?{urllib.parse.urlencode(fixed | {'per_page': min(int(o.get('per_page', 100)), 100), 'page': number})}")
        if got is None or not isinstance(got[0], list):
            return iter([]), 0
        after = got[1].get("x-next-page", "").strip()
        return self.rows(got[0]), int(after) if after else 0

    def rows(self, items: list[dict]) -> Iterator[tuple]:
        for it in items:
            meta = {"stars": it.get("star_count"), "forks": it.get("forks_count"), "created_at": it.get("created_at"), "pushed_at": it.get("last_activity_at"), "archived": it.get("archived"), "visibility": it.get("visibility"), "description": it.get("description")}
            yield ("gitlab", str(it.get("id")), str(it.get("path_with_namespace")), str(it.get("http_url_to_repo")), it.get("default_branch") or None, tuple(meta.get(f) for f in FIELDS))


class GitLabProjects(RepoSource):
    """SC6: options base_url, token, group, per_page, max_pages, include_archived, verify_ssl."""

    @classmethod
    def name(cls) -> str:
        return "gitlab_projects"

    def reader(self, schema) -> DataSourceReader:
        return GitLabReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Listing(GitLabReader(self.options))


SOURCES = {"github": GitHubSearch, "gitlab": GitLabProjects}


def register(spark: SparkSession) -> None:
    for source in SOURCES.values():
        spark.dataSource.register(source)


def candidates(spark: SparkSession, provider: str, options: dict[str, str], target: int | None = None) -> DataFrame:
    """SC7: repositories of a provider; S3: at most `target` of them."""
    from . import records

    if provider == "list":
        out = records.read_repo_list(spark.read.text(options["path"]), options.get("tag", "github"))
        kinds = dict(c.split(" ") for c in META.split(", "))
        meta = F.struct(*(F.try_element_at("meta", F.lit(f)).try_cast(k).alias(f) for f, k in kinds.items()))
        out = out.withColumn("meta", meta)
    elif provider in SOURCES:
        register(spark)
        out = spark.read.format(SOURCES[provider].name()).options(**{k: str(v) for k, v in options.items()}).load()
        if provider == "github" and flag(options, "require_code_language", True):
            out = records.code_repos(out)
    else:
        raise ValueError(f"unknown provider: {provider!r}")
    return out if target is None else out.limit(target)


def listing(spark: SparkSession, provider: str, options: dict[str, str]) -> DataFrame:
    """SC7, SC9, S3: a service's repositories as a stream, a page a micro-batch."""
    from . import records

    register(spark)
    out = spark.readStream.format(SOURCES[provider].name()).options(**{k: str(v) for k, v in options.items()}).load()
    return records.code_repos(out) if provider == "github" and flag(options, "require_code_language", True) else out


def page_by_page(pages: DataFrame, work: Callable[[DataFrame], int], checkpoint: str, target: int, seconds: float | None = None, now: Callable[[], float] = time.monotonic) -> int:
    """S3: gives pages of a listing to work(page), which says how many of it were
    of use, until they are `target`, or `seconds` have gone, or there is no page.

    Nothing is asked of the service after that.  A later call with the same
    checkpoint goes on at the next page; a page whose work failed comes again."""
    began, total = now(), 0
    while total < target and (seconds is None or now() - began <= seconds):
        given: list[int] = []
        run = pages.writeStream.foreachBatch(lambda page, _: given.append(work(page))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
        if not given:
            break
        total += sum(given)
    return total
