"""Boards as payload tables: each reader turns raw bodies into normalized postings.

Readers take a DataFrame with ``body`` (the raw JSON of one response; for feeds, rows of items) and
``company_name`` where a board belongs to one employer. They give the columns of ``NORMALIZED``; what
can't be read in a body is null or left out, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope import vocab
from jobscope.functions import text as tx
from jobscope.functions.location import parse_location
from jobscope.functions.threads import parse_header

#: Columns of a normalized posting.
NORMALIZED = ["source_id", "external_id", "title", "url", "description", "location_raw", "country", "city", "posted_at", "content_hash", "company_name"]


def _normalized(rows: DataFrame, source: str, **columns: Column) -> DataFrame:
    """Name the columns, work out place and hash, and leave out rows without an id or a title."""
    base = rows.select(*(c.alias(name) for name, c in columns.items()))
    if "country" not in columns:
        base = base.withColumn("_at", parse_location(F.coalesce("location_raw", F.lit("")))).withColumns({"country": F.col("_at.country"), "city": F.col("_at.city")})
    out = base.withColumns({"source_id": F.lit(source), "location_raw": F.coalesce("location_raw", F.lit("")), "content_hash": tx.content_hash(F.col("description"))})
    return out.where("external_id is not null and external_id != '' and title is not null").select(*NORMALIZED)


def greenhouse(bodies: DataFrame) -> DataFrame:
    kind = "struct<jobs:array<struct<id:bigint,title:string,absolute_url:string,location:struct<name:string>,first_published:string,content:string>>>"
    j = bodies.select("company_name", F.explode(F.from_json("body", kind)["jobs"]).alias("j"))
    return _normalized(j, "greenhouse", external_id=F.col("j.id").cast("string"), title=F.col("j.title"), url=F.col("j.absolute_url"), description=tx.normalize_description(F.coalesce("j.content", F.lit(""))), location_raw=F.col("j.location.name"), posted_at=tx.iso_time(F.col("j.first_published")), company_name=F.col("company_name"))


def lever(bodies: DataFrame) -> DataFrame:
    kind = "array<struct<id:string,text:string,hostedUrl:string,createdAt:bigint,country:string,categories:struct<location:string>,description:string>>"
    j = bodies.select("company_name", F.explode(F.from_json("body", kind)).alias("j"))
    place = parse_location(F.coalesce("j.categories.location", F.lit("")))
    return _normalized(j, "lever", external_id=F.col("j.id"), title=F.col("j.text"), url=F.col("j.hostedUrl"), description=tx.normalize_description(F.coalesce("j.description", F.lit(""))), location_raw=F.col("j.categories.location"), country=F.coalesce(tx.trusted_iso2(F.col("j.country")), place["country"]), city=place["city"], posted_at=tx.epoch_millis(F.col("j.createdAt")), company_name=F.col("company_name"))


def ashby(bodies: DataFrame) -> DataFrame:
    kind = "struct<jobs:array<struct<id:string,title:string,jobUrl:string,location:string,publishedAt:string,descriptionHtml:string>>>"
    j = bodies.select("company_name", F.explode(F.from_json("body", kind)["jobs"]).alias("j"))
    return _normalized(j, "ashby", external_id=F.col("j.id"), title=F.col("j.title"), url=F.col("j.jobUrl"), description=tx.normalize_description(F.coalesce("j.descriptionHtml", F.lit(""))), location_raw=F.col("j.location"), posted_at=tx.iso_time(F.col("j.publishedAt")), company_name=F.col("company_name"))


def jobtech(bodies: DataFrame) -> DataFrame:
    kind = "struct<hits:array<struct<id:string,headline:string,employer:struct<name:string>,workplace_address:struct<municipality:string,country:string,country_code:string>,description:struct<text:string,text_formatted:string>,webpage_url:string,publication_date:string>>>"
    j = bodies.select(F.explode(F.from_json("body", kind)["hits"]).alias("j"))
    code, empty = F.col("j.workplace_address.country_code"), lambda c: F.nullif(F.col(c), F.lit(""))
    country = F.when(code.isNull() | (code == "") | (code == "199"), "SE")
    place = F.array_join(F.array_compact(F.array(empty("j.workplace_address.municipality"), empty("j.workplace_address.country"))), ", ")
    url = tx.first_non_empty(F.col("j.webpage_url"), F.concat(F.lit("https://arbetsformedlingen.se/platsbanken/annonser/"), F.col("j.id")))
    body = tx.normalize_description(F.coalesce(tx.first_non_empty(F.col("j.description.text_formatted"), F.col("j.description.text")), F.lit("")))
    return _normalized(j, "jobtech", external_id=F.col("j.id"), title=F.col("j.headline"), url=url, description=body, location_raw=F.coalesce(F.nullif(place, F.lit("")), country, F.lit("")), country=country, city=empty("j.workplace_address.municipality"), posted_at=tx.iso_time(F.col("j.publication_date"), vocab.JOBTECH_ZONE), company_name=empty("j.employer.name"))


def remoteok(bodies: DataFrame) -> DataFrame:
    kind = "array<struct<id:string,position:string,company:string,url:string,location:string,date:string,description:string>>"
    j = bodies.select(F.explode(F.from_json("body", kind)).alias("j"))
    return _normalized(j, "remoteok", external_id=F.col("j.id"), title=F.col("j.position"), url=F.col("j.url"), description=tx.normalize_description(F.coalesce("j.description", F.lit(""))), location_raw=F.col("j.location"), posted_at=tx.iso_time(F.col("j.date")), company_name=F.col("j.company"))


def read_rss_items(spark, path: str) -> DataFrame:  # noqa: ANN001
    """Items of RSS files with Spark's XML reader."""
    return spark.read.format("xml").option("rowTag", "item").schema("title string, region string, link string, guid string, description string, pubDate string").load(path)


def wwr(items: DataFrame) -> DataFrame:
    parts = tx.split_company_role(F.col("title"))
    return _normalized(items, "wwr", external_id=tx.first_non_empty(F.col("guid"), F.col("link")), title=parts["role"], url=F.col("link"), description=tx.normalize_description(F.coalesce("description", F.lit(""))), location_raw=F.col("region"), posted_at=tx.rfc822_time(F.col("pubDate")), company_name=parts["company"])


def latest_thread(submissions: DataFrame, items: DataFrame) -> DataFrame:
    """The first hiring thread among a user's newest submissions: ``submissions`` (pos, id), ``items`` (id, title, kids)."""
    recent = submissions.where(F.col("pos") < vocab.SUBMISSIONS_SCANNED)
    threads = recent.join(items.where(F.lower(F.coalesce("title", F.lit(""))).contains(vocab.THREAD_TITLE)), "id")
    return threads.orderBy("pos").limit(1).select("id", "kids")


def unseen_kids(thread: DataFrame, seen: DataFrame) -> DataFrame:
    """Comments of the thread that weren't fetched yet; another thread starts anew."""
    kids = thread.select(F.col("id").alias("thread_id"), F.explode("kids").alias("id"))
    return kids.join(seen.select("thread_id", "id"), ["thread_id", "id"], "left_anti")


def hiring_comments(items: DataFrame) -> DataFrame:
    """Postings from thread comments (id, text, time, deleted, dead); deleted, dead, empty and unstructured ones are left out."""
    alive = items.where(~F.coalesce("deleted", F.lit(False)) & ~F.coalesce("dead", F.lit(False)) & (F.coalesce("text", F.lit("")) != ""))
    # a row of a generator is worked out once; as a column it would be again for the filter and each of its fields
    read = alive.withColumn("h", F.explode(F.filter(F.array(parse_header(F.col("text"))), lambda h: h.isNotNull())))
    item = F.col("id").cast("string")
    return _normalized(read, "hn", external_id=item, title=F.coalesce("h.role", "h.company"), url=F.concat(F.lit("https://news.ycombinator.com/item?id="), item), description=tx.normalize_description(F.col("text")), location_raw=F.col("h.location"), posted_at=tx.epoch_seconds(F.col("time")), company_name=F.col("h.company"))


#: Board readers by source; those of one employer's board, and those of many employers.
COMPANY_BOARDS = {"greenhouse": greenhouse, "lever": lever, "ashby": ashby}
OPEN_BOARDS = {"jobtech": jobtech, "remoteok": remoteok, "wwr": wwr, "hn": hiring_comments}
