"""Queries of the list: filters, orders, pages, totals, details."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.functions.classify import tier_rank
from jobscope.operators.keywords import build_index, keyword_jobs
from jobscope.operators.search import JobFilters, count_jobs, job_sources, search_jobs, set_status
from jobscope.plans.postings import COMPANIES, POSTINGS, companies, postings, sql_rank, wide_postings
from jobscope.store import new_path

_TIER = f"ORDER BY {sql_rank('sponsor_tier')} DESC, posted_at DESC NULLS LAST, id"
_DATE = "ORDER BY posted_at DESC NULLS LAST, id"
_SHOWN = "p.id, title, c.name AS company, country, city, array_to_string(categories, ',') AS categories, level, sponsor_tier, user_status, posted_at, url"


def _page(filters: JobFilters):  # noqa: ANN202
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search_jobs(wide_postings(spark, sf_dir), companies(spark, sf_dir), filters).withColumn("categories", F.array_join("categories", ","))

    return run


def _sql(where: str, order: str = _TIER, limit: int = 50, offset: int = 0) -> str:
    return f"WITH {POSTINGS}, {COMPANIES} SELECT {_SHOWN} FROM postings p JOIN companies c ON p.company_id = c.id WHERE canonical_id IS NULL AND {where} {order} LIMIT {limit} OFFSET {offset}"


_PAGES: dict[str, tuple[JobFilters, str]] = {
    "list_default": (JobFilters(), _sql("user_status <> 'hidden'")),
    "list_by_date": (JobFilters(sort="date"), _sql("user_status <> 'hidden'", _DATE)),
    "list_paged": (JobFilters(limit=20, offset=40), _sql("user_status <> 'hidden'", limit=20, offset=40)),
    "list_keyword": (JobFilters(q="visa SPONSOR"), _sql("user_status <> 'hidden' AND (title ILIKE '%visa SPONSOR%' OR description ILIKE '%visa SPONSOR%')")),
    "list_keyword_wildcard": (JobFilters(q="r_act"), _sql("user_status <> 'hidden' AND (title ILIKE '%r_act%' OR description ILIKE '%r_act%')")),
    "list_country_in": (JobFilters(countries=("se", "us")), _sql("user_status <> 'hidden' AND country IN ('SE', 'US')")),
    "list_category_any": (JobFilters(categories=("ios", "backend")), _sql("user_status <> 'hidden' AND list_has_any(categories, ['ios', 'backend'])")),
    "list_level": (JobFilters(levels=("senior", "staff")), _sql("user_status <> 'hidden' AND level IN ('senior', 'staff')")),
    "list_since": (JobFilters(posted_since=datetime(2026, 2, 10)), _sql("user_status <> 'hidden' AND posted_at >= TIMESTAMP '2026-02-10 00:00:00'")),
    "list_tier_optin": (JobFilters(tiers=("explicit_yes", "registry_inferred")), _sql("user_status <> 'hidden' AND sponsor_tier IN ('explicit_yes', 'registry_inferred')")),
    "list_status_starred": (JobFilters(status="starred"), _sql("user_status = 'starred'")),
    "list_status_all": (JobFilters(status="all", limit=200), _sql("TRUE", limit=200)),
    "list_match_without_resume": (JobFilters(sort="match"), _sql("user_status <> 'hidden'")),
    "list_combined": (JobFilters(q="e", countries=("SE", "DE", "GB"), levels=("senior", "unspecified"), sort="date"), _sql("user_status <> 'hidden' AND (title ILIKE '%e%' OR description ILIKE '%e%') AND country IN ('SE', 'DE', 'GB') AND level IN ('senior', 'unspecified')", _DATE)),
}


def _by_index(name: str):  # noqa: ANN202
    """A page whose keyword goes through an index of trigrams."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root, filters = new_path(spark, "keywords"), _PAGES[name][0]
        build_index(wide_postings(spark, sf_dir), root)
        return search_jobs(keyword_jobs(spark, root, filters.q), companies(spark, sf_dir), filters).withColumn("categories", F.array_join("categories", ","))

    return run


def list_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_jobs(wide_postings(spark, sf_dir), JobFilters(countries=("SE", "US")))


def detail_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = F.array_join(F.transform("sources", lambda s: F.concat_ws("|", s["id"].cast("string"), s["source_id"], s["url"])), ",")
    return job_sources(postings(spark, sf_dir)).select("canonical", sources.alias("sources"))


def status_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_status(postings(spark, sf_dir), 22, "starred").groupBy("user_status").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


def orders_ranked_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rank by value, then date, over orders with customers and nations: the list's shape on larger tables."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    rank = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 2).otherwise(1)
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    return joined.orderBy(rank.desc(), F.col("o_totalprice").desc(), "o_orderkey").limit(100).select("o_orderkey", F.col("n_name").alias("nation"), "o_totalprice")


def tier_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(spark, sf_dir).groupBy("sponsor_tier").agg(F.max(tier_rank(F.col("sponsor_tier"))).alias("rank"), F.count(F.lit(1)).alias("n"))


QUERIES = {name: _page(f) for name, (f, _) in _PAGES.items()} | {"list_total": list_total, "detail_sources": detail_sources, "status_set": status_set, "orders_ranked_topk": orders_ranked_topk, "tier_ranks": tier_ranks, "list_keyword_indexed": _by_index("list_keyword"), "list_wildcard_indexed": _by_index("list_keyword_wildcard")}

ORACLES = {name: sql for name, (_, sql) in _PAGES.items()} | {
    "list_keyword_indexed": _PAGES["list_keyword"][1],
    "list_wildcard_indexed": _PAGES["list_keyword_wildcard"][1],
    "list_total": f"WITH {POSTINGS} SELECT count(*) AS total FROM postings WHERE canonical_id IS NULL AND country IN ('SE', 'US') AND user_status <> 'hidden'",
    "detail_sources": f"WITH {POSTINGS} SELECT coalesce(canonical_id, id) AS canonical, string_agg(concat_ws('|', id, source_id, url), ',' ORDER BY id) AS sources FROM postings GROUP BY 1",
    "status_set": f"WITH {POSTINGS} SELECT CASE WHEN id = 21 THEN 'starred' ELSE user_status END AS user_status, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM postings GROUP BY 1",
    "orders_ranked_topk": "SELECT o_orderkey, n_name AS nation, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END DESC, o_totalprice DESC, o_orderkey LIMIT 100",
    "tier_ranks": f"WITH {POSTINGS} SELECT sponsor_tier, max({sql_rank('sponsor_tier')}) AS rank, count(*) AS n FROM postings GROUP BY 1",
}
