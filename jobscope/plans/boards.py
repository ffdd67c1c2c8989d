"""Queries of the board readers over whole tables: pages and documents written as each board's payloads, and read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.plans.feeds import _shown
from jobscope.plans.postings import PLACES, ROLES, pick, sql_location, sql_pick
from jobscope.plans.texts import sql_normalized
from jobscope.sources import boards

COUNTRIES = ["se", "USA", "", "DE"]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n``, ``body`` and ``day`` (midnight UTC) of every document."""
    n = F.col("doc_id")
    day = F.lit("2026-01-01 00:00:00").cast("timestamp") + F.make_dt_interval((n % 90).cast("int"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(n.alias("n"), F.coalesce("text", F.lit("")).alias("text"), day.alias("day"), F.concat(pick(ROLES, n), F.lit(" "), n.cast("string")).alias("role"), pick(PLACES, n).alias("place"), n.cast("string").alias("key"))


def _iso(zone: str) -> Column:
    """The day as an ISO string; some have none."""
    return F.when(F.col("n") % 7 != 0, F.concat(F.date_format("day", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(zone)))


def _bodies(df: DataFrame, item: Column, field: str | None) -> DataFrame:
    """A response for each row; some are broken."""
    items = F.array(item)
    body = F.to_json(F.struct(items.alias(field)) if field else items)
    return df.select(F.lit("Board").alias("company_name"), F.when(F.col("n") % 13 == 5, F.substring(body, F.lit(1), F.length(body) - 3)).otherwise(body).alias("body"))


def greenhouse_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(n.alias("n"), "url", "html", pick(PLACES, n).alias("place"))
    item = F.struct(F.col("n").alias("id"), F.col("url").alias("title"), F.col("url").alias("absolute_url"), F.struct(F.col("place").alias("name")).alias("location"), F.when(F.col("n") % 7 != 0, "2026-05-19T20:17:51-04:00").alias("first_published"), F.col("html").alias("content"))
    return _shown(boards.greenhouse(_bodies(p, item, "jobs")))


def lever_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(F.col("key").alias("id"), F.col("role").alias("text"), F.lit("https://l/").alias("hostedUrl"), F.when(F.col("n") % 7 != 0, F.unix_millis("day")).alias("createdAt"), pick(COUNTRIES, F.col("n")).alias("country"), F.struct(F.col("place").alias("location")).alias("categories"), F.col("text").alias("description"))
    return _shown(boards.lever(_bodies(_docs(spark, sf_dir), item, None)))


def ashby_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(F.col("key").alias("id"), F.col("role").alias("title"), F.lit("https://s/").alias("jobUrl"), F.col("place").alias("location"), _iso(".000+00:00").alias("publishedAt"), F.col("text").alias("descriptionHtml"))
    return _shown(boards.ashby(_bodies(_docs(spark, sf_dir), item, "jobs")))


def jobtech_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    where = F.struct(F.when(n % 3 == 0, F.col("place")).alias("municipality"), F.when(n % 2 == 0, "Sverige").otherwise("Norge").alias("country"), F.when(n % 2 == 0, "199").otherwise("155").alias("country_code"))
    item = F.struct(F.col("key").alias("id"), F.col("role").alias("headline"), F.struct(F.when(n % 4 != 0, F.lit("Volvo")).otherwise("").alias("name")).alias("employer"), where.alias("workplace_address"), F.struct(F.col("text").alias("text")).alias("description"), F.lit("").alias("webpage_url"), _iso("").alias("publication_date"))
    return _shown(boards.jobtech(_bodies(_docs(spark, sf_dir), item, "hits")))


def remoteok_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each response begins with a notice that has no id."""
    item = F.struct(F.col("key").alias("id"), F.col("role").alias("position"), F.concat(F.lit("Firm "), F.col("key")).alias("company"), F.lit("https://r/").alias("url"), F.col("place").alias("location"), _iso("+00:00").alias("date"), F.col("text").alias("description"))
    d = _docs(spark, sf_dir)
    notice = F.concat(F.lit('[{"legal": "notice"}, '), F.to_json(item), F.lit("]"))
    return _shown(boards.remoteok(d.select(F.lit("Board").alias("company_name"), notice.alias("body"))))


def rss_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    stamp = F.when(n % 7 != 0, F.concat(F.lit("Tue, "), F.date_format("day", "dd MMM yyyy HH:mm:ss"), F.when(n % 2 == 0, " +0000").otherwise(" GMT")))
    title = F.when(n % 5 == 0, F.col("role")).otherwise(F.concat(F.lit("Firm "), F.col("key"), F.lit(": "), F.col("role")))
    return _shown(boards.wwr(_docs(spark, sf_dir).select(title.alias("title"), F.col("place").alias("region"), F.concat(F.lit("https://w/"), "key").alias("link"), F.when(n % 3 == 0, F.col("key")).otherwise("").alias("guid"), F.col("text").alias("description"), stamp.alias("pubDate"))))


def hn_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    header = F.concat(F.lit("Firm "), F.col("key"), F.lit(" | "), F.col("role"), F.lit(" | Berlin, Germany<p>"))
    return _shown(boards.hiring_comments(_docs(spark, sf_dir).select(n.alias("id"), F.when(n % 6 == 1, F.lit("")).otherwise(F.concat(header, "text")).alias("text"), F.unix_seconds("day").alias("time"), (n % 10 == 0).alias("deleted"), (n % 11 == 0).alias("dead"))))


# ---- the same in SQL ----
_DAY = "TIMESTAMP '2026-01-01 00:00:00' + to_days(CAST(n % 90 AS INT))"
_D = f"d AS (SELECT doc_id AS n, CAST(doc_id AS VARCHAR) AS key, {sql_normalized("coalesce(text, '')")} AS description, {sql_pick(ROLES, 'doc_id')} || ' ' || doc_id AS role, {sql_pick(PLACES, 'doc_id')} AS place FROM documents), t AS (SELECT *, {_DAY} AS day, CASE WHEN n % 7 <> 0 THEN {_DAY} END AS known FROM d)"
_PLACED = sql_location("place", "x", "t")


def _rows(source: str, where: str = "n % 13 <> 5", **columns: str) -> str:
    found = {"source_id": f"'{source}'", "external_id": "key", "title": "role", "description": "description", "location_raw": "place", "country": "country", "city": "city", "posted_at": "known", "company_name": "'Board'"} | columns
    return f"WITH {_D}, {_PLACED} SELECT {', '.join(f'{e} AS {c}' for c, e in found.items())} FROM x WHERE {where}"


QUERIES = {f.__name__: f for f in (greenhouse_pages, lever_docs, ashby_docs, jobtech_docs, remoteok_docs, rss_docs, hn_docs)}

ORACLES = {
    "greenhouse_pages": f"WITH t AS (SELECT page_id AS n, url, {sql_normalized('html')} AS description, {sql_pick(PLACES, 'page_id')} AS place FROM pages), {_PLACED} SELECT 'greenhouse' AS source_id, CAST(n AS VARCHAR) AS external_id, url AS title, description, place AS location_raw, country, city, CASE WHEN n % 7 <> 0 THEN TIMESTAMP '2026-05-20 00:17:51' END AS posted_at, 'Board' AS company_name FROM x WHERE n % 13 <> 5",
    "lever_docs": _rows("lever", country="coalesce(CASE WHEN n % 4 = 0 THEN 'SE' WHEN n % 4 = 3 THEN 'DE' END, country)"),
    "ashby_docs": _rows("ashby"),
    "jobtech_docs": _rows("jobtech", location_raw="CASE WHEN n % 3 = 0 THEN place || ', ' ELSE '' END || CASE WHEN n % 2 = 0 THEN 'Sverige' ELSE 'Norge' END", country="CASE WHEN n % 2 = 0 THEN 'SE' END", city="CASE WHEN n % 3 = 0 THEN place END", posted_at="timezone('UTC', timezone('Europe/Stockholm', known))", company_name="CASE WHEN n % 4 <> 0 THEN 'Volvo' END"),
    "remoteok_docs": _rows("remoteok", "TRUE", company_name="'Firm ' || key"),
    "rss_docs": _rows("wwr", "TRUE", external_id="CASE WHEN n % 3 = 0 THEN key ELSE 'https://w/' || key END", company_name="CASE WHEN n % 5 <> 0 THEN 'Firm ' || key END"),
    "hn_docs": _rows("hn", "n % 6 <> 1 AND n % 10 <> 0 AND n % 11 <> 0", location_raw="'Berlin, Germany'", country="'DE'", city="'Berlin'", posted_at="day", company_name="'Firm ' || key", description="trim('Firm ' || key || ' | ' || role || ' | Berlin, Germany ' || description)"),
}
