"""Queries of the board readers over inline payloads, and of the streams over the events table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.operators.health import fold_health
from jobscope.plans.state import TOY, _events
from jobscope.sources import boards
from jobscope.store import new_path
from jobscope.streaming.health import stream_health

GREENHOUSE = {"jobs": [{"id": 1, "title": "iOS Engineer", "absolute_url": "https://a/1", "location": {"name": "Dublin, Ireland"}, "first_published": "2026-05-19T20:17:51-04:00", "content": "&lt;p&gt;Swift &amp;amp; Kotlin&lt;/p&gt;"}, {"id": 2, "title": "SRE", "absolute_url": "https://a/2", "location": {"name": "United States - East (Remote)"}, "first_published": None, "content": None}]}
LEVER = [{"id": "x1", "text": "Backend", "hostedUrl": "https://l/1", "createdAt": 1767225600000, "country": "se", "categories": {"location": "AMER"}, "description": "<b>Go</b>"}, {"id": "x2", "text": "Data", "hostedUrl": "https://l/2", "createdAt": None, "country": None, "categories": {"location": "Berlin, Germany"}, "description": ""}]
ASHBY = {"jobs": [{"id": "u1", "title": "Designer", "jobUrl": "https://s/1", "location": "Remote", "publishedAt": "2026-01-02T03:04:05.000+00:00", "descriptionHtml": "a&nbsp;b"}]}
JOBTECH = {"hits": [{"id": "9", "headline": "Utvecklare", "employer": {"name": "Volvo"}, "workplace_address": {"municipality": "Göteborg", "country": "Sverige", "country_code": "199"}, "description": {"text": "plain", "text_formatted": "<p>html</p>"}, "webpage_url": None, "publication_date": "2026-07-01T09:00:00"}, {"id": "10", "headline": "Ingeniør", "employer": {"name": None}, "workplace_address": {"municipality": None, "country": "Norge", "country_code": "155"}, "description": {"text": "x"}, "webpage_url": "https://j/10", "publication_date": "2026-01-01T09:00:00+02:00"}, {"id": "11", "headline": "Kock", "employer": None, "workplace_address": None, "description": None, "webpage_url": "", "publication_date": None}]}
REMOTEOK = [{"legal": "notice"}, {"id": "5", "position": "Rust Dev", "company": "Ferris", "url": "https://r/5", "location": "Worldwide", "date": "2026-02-03T04:05:06+00:00", "description": "d"}, {"id": "", "position": "No id", "company": "x"}, {"id": "6", "position": "Vue Dev", "company": "V", "url": "https://r/6", "location": "Europe", "date": "", "description": "e"}]
FEED = [("Acme: Senior React Developer", "Anywhere", "https://w/1", "g1", "&lt;p&gt;hi&lt;/p&gt;", "Tue, 01 Jul 2026 12:00:00 +0000"), ("Just a title", None, "https://w/2", None, None, None), ("Beta: Role: with colon", "USA", "https://w/3", "", "x", "Wed, 15 Jul 2026 08:30:00 GMT")]
COMMENTS = [
    (1, "Acme (YC W22) | Senior Backend Engineer | Berlin, Germany | Full-time<p>We build.", 1767225600, None, None),
    (2, "No header here, just chat", 1767225600, None, None),
    (3, "Beta | REMOTE (US) | Data Scientist | https://b", 1767312000, None, None),
    (4, "Dead | Engineer", 1767312000, None, True),
    (5, None, None, True, None),
    (6, "<p>\n<p>Gamma &amp; Sons | Hybrid | Chef", None, None, None),
]


def _shown(df: DataFrame) -> DataFrame:
    return df.select("source_id", "external_id", "title", "description", "location_raw", "country", "city", "posted_at", "company_name")


def _bodies(spark: SparkSession, *bodies: object) -> DataFrame:
    return spark.createDataFrame([("Board", json.dumps(b)) for b in bodies] + [("Broken", "{not json")], "company_name string, body string")


def greenhouse_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(boards.greenhouse(_bodies(spark, GREENHOUSE)))


def lever_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(boards.lever(_bodies(spark, LEVER)))


def ashby_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(boards.ashby(_bodies(spark, ASHBY)))


def jobtech_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(boards.jobtech(_bodies(spark, JOBTECH)))


def remoteok_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(boards.remoteok(_bodies(spark, REMOTEOK)))


def rss_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(boards.wwr(spark.createDataFrame(FEED, "title string, region string, link string, guid string, description string, pubDate string")))


def hn_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(boards.hiring_comments(spark.createDataFrame(COMMENTS, "id long, text string, time long, deleted boolean, dead boolean")))


def hn_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hiring thread's comments that weren't fetched yet, from documents as items."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 10 == 7, "Ask HN: Who is Hiring?").otherwise("Other").alias("title"), F.array(F.col("doc_id") + 1, F.col("doc_id") + 2, F.col("doc_id") + 3).alias("kids"))
    submissions = d.select((F.col("doc_id") - 5).alias("pos"), F.col("doc_id").alias("id")).where("pos >= 0")
    thread = boards.latest_thread(submissions, items)
    seen = d.select(F.col("doc_id").alias("thread_id"), (F.col("doc_id") + 2).alias("id"))
    return boards.unseen_kids(thread, seen)


def stream_events_equal_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health by the stream over event files, which ends as the batch fold does; reads what is there and stops."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    landing = new_path(spark, "events-landing")
    spark.read.parquet(f"{sf_dir}/events.parquet").repartitionByRange(4, "ts").write.parquet(landing)
    events = _as_health(spark.readStream.schema(schema).parquet(landing))
    out = new_path(spark, "health-updates")

    def keep(rows: DataFrame, number: int) -> None:
        rows.selectExpr("*", f"{number} as batch").write.mode("append").parquet(out)

    # this state needs the RocksDB store; the session keeps its own setting
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream_health(events, TOY).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", new_path(spark, "health-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    updates = spark.read.parquet(out)
    last = updates.groupBy("source").agg(F.max_by(F.struct("failures", "health", "reason", "last_success"), "batch").alias("s"))
    return last.select("source", "s.*")


def _as_health(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", F.element_at(F.array(*map(F.lit, TOY)), (F.col("event_id") % 3).cast("int") + 1)).when((F.col("event_type") == "view") & (F.col("event_id") % 9 == 0), "probe_success").when(F.col("event_id") % 4 == 0, "success").otherwise("probe_failure")
    return events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"))


def batch_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_health(_events(spark, sf_dir), TOY)


_EXPECTED = {
    "greenhouse_parse": [("greenhouse", "1", "iOS Engineer", "Swift & Kotlin", "Dublin, Ireland", "IE", "Dublin", "2026-05-20 00:17:51", "Board"), ("greenhouse", "2", "SRE", "", "United States - East (Remote)", "US", None, None, "Board")],
    "lever_parse": [("lever", "x1", "Backend", "Go", "AMER", "SE", "AMER", "2026-01-01 00:00:00", "Board"), ("lever", "x2", "Data", "", "Berlin, Germany", "DE", "Berlin", None, "Board")],
    "ashby_parse": [("ashby", "u1", "Designer", "a b", "Remote", None, None, "2026-01-02 03:04:05", "Board")],
    "remoteok_parse": [("remoteok", "5", "Rust Dev", "d", "Worldwide", None, None, "2026-02-03 04:05:06", "Ferris"), ("remoteok", "6", "Vue Dev", "e", "Europe", None, None, None, "V")],
    "rss_items": [("wwr", "g1", "Senior React Developer", "hi", "Anywhere", None, "Anywhere", "2026-07-01 12:00:00", "Acme"), ("wwr", "https://w/2", "Just a title", "", "", None, None, None, None), ("wwr", "https://w/3", "Role: with colon", "x", "USA", "US", None, "2026-07-15 08:30:00", "Beta")],
    "jobtech_parse": [("jobtech", "9", "Utvecklare", "html", "Göteborg, Sverige", "SE", "Göteborg", "2026-07-01 07:00:00", "Volvo"), ("jobtech", "10", "Ingeniør", "x", "Norge", None, None, "2026-01-01 07:00:00", None), ("jobtech", "11", "Kock", "", "SE", "SE", None, None, None)],
    "hn_parse": [("hn", "1", "Senior Backend Engineer", "Acme (YC W22) | Senior Backend Engineer | Berlin, Germany | Full-time We build.", "Berlin, Germany", "DE", "Berlin", "2026-01-01 00:00:00", "Acme"), ("hn", "3", "Data Scientist", "Beta | REMOTE (US) | Data Scientist | https://b", "REMOTE (US)", None, None, "2026-01-02 00:00:00", "Beta"), ("hn", "6", "Gamma & Sons", "Gamma & Sons | Hybrid | Chef", "Hybrid", None, "Hybrid", None, "Gamma & Sons")],
}

QUERIES = {
    f.__name__: f
    for f in (greenhouse_parse, lever_parse, ashby_parse, jobtech_parse, remoteok_parse, rss_items, hn_parse, hn_thread, stream_events_equal_batch)
}


def _table(rows: list[tuple]) -> str:
    cell = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    values = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)
    return f"SELECT source_id, external_id, title, description, location_raw, country::VARCHAR AS country, city::VARCHAR AS city, CAST(posted_at AS TIMESTAMP) AS posted_at, company_name FROM (VALUES {values}) v(source_id, external_id, title, description, location_raw, country, city, posted_at, company_name)"


def _oracles() -> dict[str, str]:
    from jobscope.plans.state import ORACLES as STATE

    return {name: _table(rows) for name, rows in _EXPECTED.items()} | {
        "hn_thread": "WITH t AS (SELECT doc_id AS id FROM documents WHERE doc_id - 5 >= 0 AND doc_id - 5 < 30 AND doc_id % 10 = 7 ORDER BY doc_id LIMIT 1) SELECT id AS thread_id, unnest([id + 1, id + 3]) AS id FROM t",
        "stream_events_equal_batch": STATE["health_fold"],
    }


ORACLES = _oracles()
