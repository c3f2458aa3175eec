"""Star-schema tables as commit rows and panels, in Spark and as SQL text.

Repository: the customer's nation; developer: the customer; commit: the order;
language: the part's type; month: the ship month; hour: from the order's number,
as ship dates have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import mining, panels

ANCHOR, PLACEBO = "1998-06", "1996-09"
#: The part types stand for languages, by the length of their names.
LANGS = ["python", "java", "ruby", "cpp", "css"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    customer, part = read(spark, sf_dir, "customer"), read(spark, sf_dir, "part")
    x = line.join(orders.select("o_orderkey", "o_custkey"), line["l_orderkey"] == orders["o_orderkey"]).join(customer.select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).join(part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return x.select(F.col("c_nationkey").alias("repo_id"), F.col("o_custkey").alias("dev"), F.col("l_orderkey").alias("sha"), (F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(hours=F.col("l_orderkey") % 24)).alias("ts"), F.date_format("l_shipdate", "yyyy-MM").alias("ym"), F.element_at(F.array(*map(F.lit, LANGS)), (F.length("p_type") % 5 + 1).cast("int")).alias("lang"), F.col("l_quantity").cast("bigint").alias("ins"), F.col("l_linenumber").cast("bigint").alias("del"), (F.col("c_mktsegment") == "BUILDING").alias("dev_has_sig"), F.col("l_suppkey"))


def language_months(spark, sf_dir) -> DataFrame:
    return mining.language_months(commit_files(spark, sf_dir))


def author_months(spark, sf_dir, anchor: str = ANCHOR) -> DataFrame:
    return panels.with_t(mining.author_months(commit_files(spark, sf_dir)), anchor)


def repo_months(spark, sf_dir, anchor: str = ANCHOR) -> DataFrame:
    return panels.repo_months_of(commit_files(spark, sf_dir), anchor)


def churn_months(spark, sf_dir, keys=("repo_id", "dev"), anchor: str = ANCHOR) -> DataFrame:
    rows = commit_files(spark, sf_dir)
    return panels.with_t(rows.groupBy(*keys, "ym").agg(F.sum(F.col("ins") + F.col("del")).alias("churn")), anchor)


def cross_rows(spark, sf_dir, anchor: str = ANCHOR) -> DataFrame:
    """A customer's rows by the supplier's nation, for operators over repositories."""
    rows = commit_files(spark, sf_dir).join(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return panels.with_t(rows.withColumn("repo_id", F.col("s_nationkey")), anchor)


def repo_meta(spark, sf_dir) -> DataFrame:
    """A row a nation: name, url, language, suitability, whether it is included and signed."""
    n = read(spark, sf_dir, "nation")
    lang = F.element_at(F.array(*map(F.lit, LANGS[:4])), (F.col("n_nationkey") % 4 + 1).cast("int"))
    meta = n.select(F.col("n_nationkey").alias("repo_id"), F.col("n_name").alias("name"), F.concat(F.lit("https://h/"), "n_name").alias("url"), lang.alias("primary_language"), (F.col("n_nationkey") % 5 != 0).alias("included"), (F.col("n_nationkey") % 3 == 0).alias("has_signature"))
    return meta.join(panels.weighted_suitability(language_months(spark, sf_dir)), "repo_id", "left")


def included(df: DataFrame, spark, sf_dir) -> DataFrame:
    return panels.included_only(df, read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("repo_id"), (F.col("n_nationkey") % 5 != 0).alias("included")))


def propensity(spark, sf_dir) -> DataFrame:
    """A stand-in that SQL can have too; some developers have none."""
    c = read(spark, sf_dir, "customer").where("c_custkey % 7 <> 0")
    return c.select(F.col("c_nationkey").alias("repo_id"), F.col("c_custkey").alias("dev"), (F.col("c_custkey") % 100 / 100.0).alias("p_ai"), F.when(F.col("c_mktsegment") == "BUILDING", "signature-positive").otherwise("inferred").alias("label_source"))


def repo_propensity(spark, sf_dir) -> DataFrame:
    n = read(spark, sf_dir, "nation").where("n_nationkey % 6 <> 1")
    return n.select(F.col("n_nationkey").alias("repo_id"), (F.col("n_nationkey") * 4 / 100.0).alias("p_ai"), F.when(F.col("n_nationkey") % 3 == 0, "signature-positive").otherwise("inferred").alias("label_source"))


A = T.anchor_ord(ANCHOR)
T_SQL = f"(cast(substr(ym,1,4) as int)*12+cast(substr(ym,6,2) as int)-1-{A})"
CF = """cf as (select c.c_nationkey as repo_id, o.o_custkey as dev, l.l_orderkey as sha, l.l_shipdate + to_hours((l.l_orderkey%24)::int) as ts,
  strftime(l.l_shipdate,'%Y-%m') as ym, ['python','java','ruby','cpp','css'][length(p.p_type)%5+1] as lang, cast(l.l_quantity as bigint) as ins, cast(l.l_linenumber as bigint) as del,
  c.c_mktsegment='BUILDING' as dev_has_sig, l.l_suppkey
  from lineitem l join orders o on o.o_orderkey=l.l_orderkey join customer c on c.c_custkey=o.o_custkey join part p on p.p_partkey=l.l_partkey)"""
SUIT_SQL = "case lang when 'python' then 1.0 when 'java' then 0.9 when 'ruby' then 0.85 when 'cpp' then 0.8 when 'css' then 0.55 else 0.4 end"
PR = """pr as (select c_nationkey repo_id, c_custkey dev, (c_custkey%100)/100.0 p_ai, case when c_mktsegment='BUILDING' then 'signature-positive' else 'inferred' end label_source from customer where c_custkey%7<>0)"""
RP = """rp as (select n_nationkey repo_id, n_nationkey*4/100.0 p_ai, case when n_nationkey%3=0 then 'signature-positive' else 'inferred' end label_source from nation where n_nationkey%6<>1)"""
#: Needs LM.
MT = f"""sw as (select repo_id, sum({SUIT_SQL}*(ins+del))/sum(ins+del) as s from lm group by 1),
 mt as (select n_nationkey repo_id, n_name as name, 'https://h/'||n_name as url, ['python','java','ruby','cpp'][n_nationkey%4+1] primary_language, n_nationkey%5<>0 included, n_nationkey%3=0 has_signature, s suitability_weighted from nation left join sw on sw.repo_id=n_nationkey)"""
LM = CF + """, lm as (select repo_id, ym, lang, cast(sum(ins) as bigint) ins, cast(sum(del) as bigint) del, count(*) files, count(distinct sha) commits from cf group by all)"""
AM = CF + f""", co as (select repo_id, dev, ym, sha, sum(ins) ins, sum(del) del, min(ts) ts from cf group by all),
 am1 as (select repo_id, dev, ym, cast(sum(ins) as bigint) ins, cast(sum(del) as bigint) del, cast(sum(ins+del) as bigint) churn, count(*) commits, avg(ins+del) size_mean, stddev_pop(ins+del) size_std, cast(max(ins+del) as bigint) size_max,
   avg(case when isodow(ts)>=6 then 1 else 0 end) weekend_share, avg(case when hour(ts)<8 or hour(ts)>=20 then 1 else 0 end) evening_share from co group by all),
 am2 as (select repo_id, dev, ym, cast(count(distinct lang) as int) n_langs from cf group by all),
 am as (select *, {T_SQL} as t from am1 join am2 using (repo_id, dev, ym))"""
RM = LM + f""", dv as (select repo_id, ym, count(distinct dev) devs from cf group by all),
 rm as (select repo_id, ym, cast(sum(ins) as bigint) ins, cast(sum(del) as bigint) del, cast(sum(ins+del) as bigint) churn, cast(sum(commits) as bigint) commits from lm group by all),
 rmt as (select rm.*, greatest(coalesce(devs,1),1) devs, {T_SQL} as t, churn/greatest(coalesce(devs,1),1) as cpd from rm left join dv using (repo_id, ym))"""


def churn_sql(keys: str = "repo_id, dev", source: str = "cf") -> str:
    return f"cm as (select {keys}, ym, cast(sum(ins+del) as bigint) churn, {T_SQL} as t from {source} group by {keys}, ym)"


def trend_sql(keys: str = "repo_id, dev", pre: int = 4, post: int = 3, shift: str = "t") -> str:
    return f"""tf as (select {keys}, coalesce(regr_slope(case when {shift}<0 then ln(1+churn) end, case when {shift}<0 then {shift} end),0) b,
   avg(case when {shift}<0 then ln(1+churn) end) my, avg(case when {shift}<0 then {shift} end) mt from cm group by {keys}
   having count(*) filter ({shift}<0) >= {pre} and count(*) filter ({shift}>=0) >= {post}),
 fit as (select cm.*, least(greatest(ln(1+churn)-(my+b*({shift}-mt)),-5.0),5.0) as resid from cm join tf using ({keys}))"""
