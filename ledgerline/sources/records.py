"""Scans of records, repository lists, logs and tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import mining
from ..operators.panels import first_wins
from ..schemas import MENTION_TERMS, RECORD


#: Holds for a record's only or first line.
FIRST_PART = "coalesce(part, 0) = 0"
#: Developers' months that a line holds, about.
DEV_MONTHS = 1 << 15


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """SC1, SC2: records-*.jsonl without blank or malformed lines, first of a name wins.

    A very large repository's record is several lines, its parts: the first has
    all but developers, each has some of those.  With the winning first part
    come the others that were gathered with it."""
    rows = spark.read.schema(RECORD).option("pathGlobFilter", "records-*.jsonl").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(folder)
    rows = rows.withColumn("_file", F.col("_metadata.file_path")).withColumn("_at", F.col("_metadata.file_block_start")).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.where(~(F.col("_corrupt").isNotNull() & F.col("name").isNull() & F.col("provider").isNull()))
    order = ["_file", "_at", "_row"]
    first = first_wins(rows.where(FIRST_PART), ["provider", "name"], order)
    won = first.select(*(F.col(c).alias(f"_{c}") for c in ("provider", "name", "gathered_at")))
    same = F.col("provider").eqNullSafe(F.col("_provider")) & F.col("name").eqNullSafe(F.col("_name")) & F.col("gathered_at").eqNullSafe(F.col("_gathered_at"))
    more = first_wins(rows.where(f"not ({FIRST_PART})").join(won, same, "left_semi"), ["provider", "name", "part"], order)
    return first.unionByName(more).drop("_corrupt", *order)


def months_of(records: DataFrame) -> DataFrame:
    return records.select("repo_id", F.inline("months"))


def activity_of(records: DataFrame) -> DataFrame:
    return records.select("repo_id", F.inline("activity"))


def authors_of(records: DataFrame) -> DataFrame:
    """Author months with the signature flag and style of the developer's month."""
    sig = F.map_contains_key("signatures.authors", F.col("a.dev"))
    style = F.try_element_at(F.try_element_at("style", F.col("a.dev")), F.col("a.ym"))
    get = lambda k: F.coalesce(F.try_element_at(style, F.lit(k)), F.lit(0.0))
    rows = records.select("repo_id", "signatures", "style", F.explode("authors").alias("a"))
    return rows.select(
        "repo_id", "a.dev", "a.ym", "a.ins", "a.del", (F.col("a.ins") + F.col("a.del")).alias("churn"), "a.commits", F.size("a.langs").alias("n_langs"), F.coalesce(sig, F.lit(False)).alias("dev_has_sig"),
        *(F.coalesce(F.col(f"a.{c}").cast("double"), F.lit(0.0)).alias(c) for c in ("size_mean", "size_std", "size_max", "weekend_share", "evening_share")),
        *(get(k).alias(f"msg_{k}") for k in ("chars", "words", "lines", "has_bullets", "unique_word_ratio")),
        get("bugfix").cast("int").alias("bugfix_commits"), get("feature").cast("int").alias("feature_commits"), get("total").cast("int").alias("total_commits"),
    )


def mentions_of(records: DataFrame) -> DataFrame:
    """Commits of a repository's month and those that mention each term."""
    rows = records.select("repo_id", F.explode("mentions").alias("ym", "k"))
    get = lambda k: F.coalesce(F.try_element_at("k", F.lit(k)), F.lit(0).cast("bigint"))
    return rows.select("repo_id", "ym", get("total").alias("total_commits"), *(get(t).alias(f"mentions_{t}") for t in MENTION_TERMS))


def summaries(records: DataFrame) -> DataFrame:
    """A record's totals, months and signatures, all within its row.

    first_month and last_month are null, spans and gaps 0, without activity.
    Developers of further parts are counted there and added."""
    n_devs = F.size(F.array_distinct(F.transform(F.coalesce("authors", F.array()), lambda a: a["dev"])))
    n_signed = F.coalesce(F.size(F.map_keys("signatures.authors")), F.lit(0))
    yms = F.array_sort(F.transform(F.coalesce("activity", F.array()), lambda a: a["ym"]))
    total = lambda array, value: F.aggregate(F.coalesce(array, F.array()), F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(value(x), F.lit(0)))
    rows = records.select(
        "provider", "repo_id", "name", F.coalesce("clone_url", "name").alias("url"), "meta", "months", yms.alias("yms"),
        total("activity", lambda x: x["commits"]).alias("commits"), total("months", lambda x: x["ins"]).alias("source_added"), total("months", lambda x: x["del"]).alias("source_deleted"),
        F.array_sort(F.array_distinct(F.transform(F.coalesce("months", F.array()), lambda m: m["lang"]))).alias("languages"),
        n_devs.alias("contributors"),
        F.array_sort(F.coalesce(F.map_keys("signatures.repo"), F.array().cast("array<string>"))).alias("ai_signatures"),
        F.coalesce(F.map_values("signatures.repo"), F.array().cast("array<string>")).alias("_first"),
        n_signed.alias("_signed"), *(["part"] if "part" in records.columns else []),
    )
    if "part" in rows.columns:
        # Lines are counted each where it lies, then added to their first.
        is_first = F.expr(FIRST_PART)
        lines = rows.groupBy(F.col("provider").alias("_p"), F.col("name").alias("_n")).agg(F.collect_list(F.when(is_first, F.struct(*rows.columns))).alias("_lines"), *(F.coalesce(F.sum(F.when(~is_first, F.col(c))), F.lit(0)).alias(f"_more{c}") for c in ("contributors", "_signed")))
        rows = lines.select("_morecontributors", "_more_signed", F.inline("_lines"))
        rows = rows.withColumns({c: (F.col(c) + F.col(f"_more{c}")).cast("int") for c in ("contributors", "_signed")})
    ords = F.transform("yms", T.ym_ord)
    gaps = F.transform(F.slice("ords", 2, F.greatest(F.lit(0), F.size("ords") - 1)), lambda o, i: o - F.col("ords")[i] - 1)
    rows = rows.withColumn("ords", ords)
    return rows.select(
        "provider", "repo_id", "name", "url", "meta", "months", "languages", "contributors", "commits", "source_added", "source_deleted",
        F.try_element_at("yms", F.lit(1)).alias("first_month"), F.try_element_at("yms", F.lit(-1)).alias("last_month"),
        F.when(F.size("yms") > 0, F.element_at("ords", -1) - F.element_at("ords", 1) + 1).otherwise(0).alias("span_months"), F.size("yms").alias("active_months"),
        F.coalesce(F.array_max(gaps), F.lit(0)).alias("max_gap_months"), "ai_signatures", F.array_min(F.transform("_first", T.clean_ym)).alias("first_ai_month"),
        F.when(F.col("contributors") > 0, F.col("_signed") / F.col("contributors")).otherwise(0.0).alias("ai_author_share"),
    )


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """SC3: the Parquet table of this name, else the CSV with its header; ids and
    months are strings.  FileNotFoundError if there is neither."""
    for path in (f"{folder}/{name}", f"{folder}/{name}.parquet"):
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    for path in (f"{folder}/{name}-csv", f"{folder}/{name}.csv"):
        try:
            kinds = dict(spark.read.option("header", True).option("inferSchema", True).csv(path).dtypes)
            kinds |= {c: "string" for c in ("repo_id", "ym", "first_month", "last_month") if c in kinds}
            return spark.read.option("header", True).schema(", ".join(f"`{c}` {t}" for c, t in kinds.items())).csv(path)
        except AnalysisException:
            pass
    raise FileNotFoundError(f"no table {name} in {folder}")


def repo_name(url: Column) -> Column:
    """The last two parts of an address, without .git."""
    parts = F.split(F.regexp_replace(url, "/+$", ""), "/")
    return F.regexp_replace(F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), F.lit(2)), "/"), r"\.git$", "")


def read_repo_list(lines: DataFrame, tag: str = "github") -> DataFrame:
    """SC4: rows `value` of a list: URL, owner/name or JSON; notes and blanks go."""
    v = F.trim("value")
    obj = F.from_json(v, "name string, clone_url string, repo_id string, default_branch string, meta map<string,string>")
    url = F.when(v.startswith("{"), obj["clone_url"]).when(v.contains("://") | v.startswith("git@"), v).otherwise(F.concat(F.lit("https://github.com/"), v, F.lit(".git")))
    rows = lines.select(v.alias("v"), url.alias("clone_url"), obj.alias("o")).where((F.col("v") != "") & ~F.col("v").startswith("#"))
    is_json = F.col("v").startswith("{")
    name = F.coalesce(F.when(is_json, F.nullif("o.name", F.lit(""))), repo_name(F.col("clone_url")))
    rows = rows.withColumn("name", name)
    return rows.select(F.lit(tag).alias("provider"), F.coalesce(F.when(is_json, F.nullif("o.repo_id", F.lit(""))), "name").alias("repo_id"), "name", "clone_url", F.when(is_json, F.col("o.default_branch")).alias("default_branch"), F.when(is_json, F.col("o.meta")).alias("meta"))


def within(ym: Column, min_ym: str | None, max_ym: str | None) -> Column:
    """A month between floor and ceiling, each only if given."""
    ok = F.lit(True)
    if min_ym:
        ok = ok & (ym >= min_ym)
    if max_ym:
        ok = ok & (ym <= max_ym)
    return ok


def local_time(iso: Column) -> Column:
    """The author's own clock: the time as written, its offset left out; null if malformed."""
    return F.substring(iso, 1, 19).try_cast("timestamp_ntz")


def churn_rows(commits: DataFrame, value: str = "value", *keep: str) -> DataFrame:
    """SC12: a row a commit file of `value`, a commit's header line and numstat lines."""
    commits = commits.where(F.col(value) != "").select(*keep, F.split(value, "\n").alias("_l"))
    head = F.split(F.element_at("_l", 1), "\x1f", 4)
    rows = commits.where(F.size(head) == 4).select(*keep, head[0].alias("sha"), head[1].alias("iso"), F.lower(head[2]).alias("email"), head[3].alias("author"), F.explode(F.slice("_l", 2, F.greatest(F.lit(0), F.size("_l") - 1))).alias("line"))
    f = F.split("line", "\t", 3)
    path = T.resolve_path(f[2])
    rows = rows.where((F.col("line") != "") & (F.size(f) == 3))
    out = rows.select(*keep, "sha", "iso", F.substring("iso", 1, 7).alias("ym"), local_time(F.col("iso")).alias("ts"), "email", F.col("author").alias("name"), T.numstat_int(f[0]).alias("ins"), T.numstat_int(f[1]).alias("del"), path.alias("path"), T.classify_language(path).alias("lang"))
    return out.where(~T.is_excluded(F.col("path")) & T.is_source(F.col("lang")))


def read_churn_log(spark: SparkSession, path: str, min_ym: str | None = None, max_ym: str | None = None) -> DataFrame:
    """SC12, F3: one row a commit file of a numstat log whose commits begin with \\x01."""
    return churn_rows(spark.read.option("lineSep", "\x01").text(path)).where(within(F.col("ym"), min_ym, max_ym))


def message_rows(records: DataFrame, value: str = "value", *keep: str) -> DataFrame:
    """SC13: a row a commit message of `value`, four fields after line ends that lead."""
    f = F.split(F.regexp_replace(value, "^\n+", ""), "\x1f", 4)
    g = F.col("_f")
    return records.select(*keep, f.alias("_f")).where(F.size("_f") == 4).select(*keep, g[0].alias("iso"), F.substring(g[0], 1, 7).alias("ym"), F.lower(g[1]).alias("email"), g[2].alias("name"), g[3].alias("body"))


def read_message_log(spark: SparkSession, path: str, min_ym: str | None = None, max_ym: str | None = None) -> DataFrame:
    """SC13, F3: one row a commit message of a log whose records end with \\x1e."""
    return message_rows(spark.read.option("lineSep", "\x1e").text(path)).where(within(F.col("ym"), min_ym, max_ym))


def _map_of(df: DataFrame, keys: list[str], key: str, value: Column) -> DataFrame:
    by_key = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), value.alias("value"))), by_key)
    return df.groupBy(*keys).agg(F.map_from_entries(entries).alias("_m"))


def assemble(churn: DataFrame, messages: DataFrame, repos: DataFrame, salt: str, dev_months: int = DEV_MONTHS) -> DataFrame:
    """Records from commit file rows and message rows (both with repo_id), of the
    repositories of `repos` that have months; developers are hashed emails throughout.

    Each view is aggregated first, then nested.  A repository of more than
    dev_months developers' months is several rows (part from 0), developers dealt
    to them by hash, so no task nests them all; `part` is null for the others."""
    dev = T.hash_email(F.col("email"), salt)
    rows = churn.withColumn("dev", dev)
    sort = lambda *cols: F.array_sort(F.collect_list(F.struct(*cols)))
    months = mining.language_months(rows).groupBy("repo_id").agg(sort("ym", "lang", "ins", "del", "files", "commits").alias("months"))
    activity = mining.activity_months(rows).groupBy("repo_id").agg(sort("ym", "commits", "authors", "active_days").alias("activity"))
    am = mining.author_months(rows).withColumn("langs", mining.languages_of(F.col("lang_bits")))
    rounded = [F.round("size_mean", 2).alias("size_mean"), F.round("size_std", 2).alias("size_std"), "size_max", *(F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in ("weekend_share", "evening_share"))]
    sizes = am.groupBy("repo_id").agg(F.ceil(F.count("*") / dev_months).cast("int").alias("_parts"))
    dealt = lambda df: df.join(sizes, "repo_id").withColumn("_part", F.pmod(F.xxhash64("dev"), F.col("_parts")).cast("int"))
    authors = dealt(am).groupBy("repo_id", "_part").agg(sort("dev", "ym", "ins", "del", "commits", "langs", *rounded).alias("authors"))
    said = messages.withColumn("dev", dev)
    flags = T.signature_flags(F.col("name"), F.col("email"), F.col("body"))
    by_author = mining.first_seen(said, flags, ["repo_id", "dev"])
    by_repo = by_author.groupBy("repo_id", "cls").agg(F.min("first_ym").alias("first_ym"))
    repo_sig = _map_of(by_repo, ["repo_id"], "cls", F.col("first_ym")).withColumnRenamed("_m", "sig_repo")
    author_sig = _map_of(dealt(_map_of(by_author, ["repo_id", "dev"], "cls", F.col("first_ym"))), ["repo_id", "_part"], "dev", F.col("_m")).withColumnRenamed("_m", "sig_authors")
    style = mining.style_months(said, ["repo_id", "dev", "ym"])
    of = ["chars", "words", "lines", "has_bullets", "unique_word_ratio", "bugfix", "feature", "total"]
    features = F.create_map(*(x for c in of for x in (F.lit(c), F.round(F.col(c).cast("double"), 4))), F.lit("n"), F.col("total").cast("double"))
    style = _map_of(dealt(_map_of(style.withColumn("_f", features), ["repo_id", "dev"], "ym", F.col("_f"))), ["repo_id", "_part"], "dev", F.col("_m")).withColumnRenamed("_m", "style")
    mm = mining.mention_months(said, ["repo_id", "ym"], T.mention_flags(F.col("body")))
    counts = F.map_filter(F.create_map(F.lit("total"), F.col("total_commits"), *(x for t in MENTION_TERMS for x in (F.lit(t), F.col(f"mentions_{t}")))), lambda k, v: (k == "total") | (v > 0))
    mentions = _map_of(mm.withColumn("_c", counts), ["repo_id"], "ym", F.col("_c")).withColumnRenamed("_m", "mentions")
    out = repos.join(months, "repo_id")
    for view in (activity, repo_sig, mentions):
        out = out.join(view, "repo_id", "left")
    out = out.join(sizes, "repo_id").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    out = out.withColumns({c: F.when(F.col("_part") == 0, F.col(c)) for c in ("months", "activity", "sig_repo", "mentions")})
    for view in (authors, author_sig, style):
        out = out.join(view, ["repo_id", "_part"], "left")
    out = out.withColumn("part", F.when(F.col("_parts") > 1, F.col("_part"))).drop("_part", "_parts")
    none = lambda c, kind: F.coalesce(F.col(c), F.map_from_arrays(F.array(), F.array()).cast(kind))
    signatures = F.struct(none("sig_repo", "map<string,string>").alias("repo"), none("sig_authors", "map<string,map<string,string>>").alias("authors"))
    return out.withColumn("schema", F.lit(1)).withColumn("signatures", signatures).withColumn("status", F.lit("ok")).drop("sig_repo", "sig_authors")


def not_yet_gathered(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """Candidates without a record of their provider and name; missing ones are a value."""
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(f"_{c}")
    have = records.select(key("provider"), key("name")).distinct()
    wanted = candidates.withColumn("_p", key("provider")).withColumn("_n", key("name"))
    return wanted.join(have, (F.col("_p") == F.col("_provider")) & (F.col("_n") == F.col("_name")), "left_anti").drop("_p", "_n")


def useful(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """F16: records with months, and the others as failures (provider, repo_id, name, reason)."""
    some = F.coalesce(F.size("months"), F.lit(0)) > 0
    return records.where(some), records.where(~some).select("provider", "repo_id", "name", F.lit("empty: no source churn in window").alias("reason"))


def recently_active(candidates: DataFrame, counts: DataFrame, least: int) -> DataFrame:
    """candidates with at least so many recent commits; unknown counts pass."""
    both = candidates.join(counts.select("provider", "name", F.col("n").alias("_n")), ["provider", "name"], "left")
    return both.where(F.coalesce(F.col("_n") >= least, F.lit(True))).drop("_n")


def code_repos(candidates: DataFrame) -> DataFrame:
    """candidates that look like source code by language, name and description."""
    return candidates.where(F.coalesce(T.is_code_repo(F.col("meta.primary_language"), F.col("name"), F.col("meta.description")), F.lit(False)))


def safe_name(provider: Column, repo_id: Column) -> Column:
    """P20: a name for files, of letters, digits and ._- only."""
    return F.substring(F.regexp_replace(F.concat_ws("-", provider, repo_id), "[^A-Za-z0-9._-]+", "-"), 1, 120)


