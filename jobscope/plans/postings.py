"""Postings, employers and registers made from the test tables, in Spark and in SQL.

Documents have no titles, so a posting's title is a role and the text's first 40 characters, and
every choice goes by a number from their md5, so that copies of one document are one posting on several
sources; status, tier and dates go by ``doc_id``. That is how these rows are made up, and all that is
taken from a part of the text: descriptions and hashes are whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope import vocab
from jobscope.functions import classify
from jobscope.functions.location import parse_location
from jobscope.functions.text import lower
from jobscope.store import spread, written

ROLES = ["Senior Backend Engineer", "iOS Developer", "Data Scientist", "Staff Machine Learning Engineer", "Junior Android Developer", "Full-Stack Engineer", "Principal SRE", "Frontend Engineer (React)", "Flutter Developer", "Engineering Manager", "Graduate Software Engineer", "Lead DevOps Engineer"]
NOTES = ["We offer visa sponsorship and a relocation package.", "Unfortunately we cannot sponsor visas at this time.", "You need 6+ years of experience with Kubernetes and Rust.", "Must have the right to work in the EU.", "We work with Swift, SwiftUI and Kotlin.", "3 years of experience with React or Vue, CSS and PostgreSQL.", "Happy to sponsor for the right person!", "A friendly team."]
PLACES = ["Stockholm, Sweden", "Remote", "Berlin, Germany", "New York, NY", "Singapore", "London, UK", "Toronto, CA", "Europe", "Dublin", "Amsterdam, The Netherlands", "Remote (US)", "Paris or Lyon"]
STATUSES, TIERS = ["new", "new", "seen", "hidden", "starred"], ["unknown", "explicit_yes", "registry_inferred", "explicit_no"]
EPOCH = "2026-01-01 00:00:00"


def pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values)).cast("int") + 1)


_COUNTED: dict[str, int] = {}


def _firms(spark: SparkSession, sf_dir: str) -> int:
    """The number of suppliers, counted once for each folder of tables, which never change."""
    if sf_dir not in _COUNTED:
        _COUNTED[sf_dir] = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    return _COUNTED[sf_dir]


def stored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``postings`` as a job table is there: classified once, then stored."""
    return written(wide_postings(spark, sf_dir), "postings")


def wide_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``postings`` worked out by all cores, where the documents are fewer files than there are cores."""
    return postings(spark, sf_dir, wide=True)


def postings(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """``documents`` as postings of all suppliers; those whose id is divisible by 11 are linked to the one before."""
    firms = _firms(spark, sf_dir)
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    d = spread(d, "doc_id") if wide else d
    k = F.conv(F.substring(F.md5(lower(F.substring("text", 1, 40))), 1, 8), 16, 10).cast("long")
    n = F.col("doc_id")
    base = d.select(
        n.alias("id"),
        (k % firms).alias("company_id"),
        F.col("source").alias("source_id"),
        n.cast("string").alias("external_id"),
        F.concat(pick(ROLES, k), F.lit(" "), F.substring("text", 1, 40)).alias("title"),
        F.concat(F.col("text"), F.lit("\n"), pick(NOTES, k)).alias("description"),
        F.concat(F.lit("https://jobs.example/"), n.cast("string")).alias("url"),
        pick(PLACES, k).alias("location_raw"),
        pick(STATUSES, n).alias("user_status"),
        pick(TIERS, n).alias("sponsor_tier"),
        F.when(n % 7 != 0, F.lit(EPOCH).cast("timestamp") + F.make_dt_interval((n % 90).cast("int"))).alias("posted_at"),
        F.sha2("text", 256).alias("content_hash"),
        F.when((n % 11 == 0) & (n > 0), n - 1).alias("canonical_id"),
    )
    place = parse_location(F.col("location_raw"))
    return base.withColumns({"country": place["country"], "city": place["city"], "categories": classify.categories(F.col("title")), "level": classify.resolve_level(F.col("title"), F.concat_ws("\n", "title", "description"))})


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers as employers, with a board and a health by their number."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    firms = _firms(spark, sf_dir)
    n = F.col("s_suppkey")
    return s.select(
        (n % firms).cast("long").alias("id"),
        F.col("s_name").alias("name"),
        pick(["greenhouse", "lever", "ashby", "workday", "none"], n).alias("ats_type"),
        (n % 3 + 1).cast("int").alias("priority"),
        pick(["ok", "degraded", "quarantined", "ok"], n).alias("health"),
        (n % 2 * 4).cast("int").alias("registry_flags"),
        F.when(n % 3 != 0, F.lit(EPOCH).cast("timestamp")).alias("last_success_at"),
    )


# ---- the same in SQL ----
def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_pick(values: list[str], n: str) -> str:
    return f"{_list(values)}[CAST({n} % {len(values)} AS INT) + 1]"


def _sql_code(segment: str) -> str:
    names = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in vocab.COUNTRY_CODES.items()) + "}"
    return f"coalesce({names}[lower({segment})], {names}[trim(string_split(lower({segment}), ' - ')[1])])"


def sql_location(raw: str, prefix: str, source: str) -> str:
    """CTEs that add ``country`` and ``city`` to ``source`` as ``{prefix}``."""
    return f"""{prefix}_p AS (SELECT *, list_filter(list_transform(string_split(trim(regexp_replace({raw}, '\\s*\\([^)]*\\)', '', 'g')), ','), lambda s: trim(s)), lambda s: s <> '') AS _s FROM {source}),
{prefix}_c AS (SELECT *, {_sql_code('_s[1]')} AS _f, {_sql_code('_s[-1]')} AS _l FROM {prefix}_p),
{prefix} AS (SELECT * EXCLUDE (_s, _f, _l),
  CASE WHEN len(_s) = 1 THEN _f WHEN len(_s) > 1 AND _l IS NOT NULL THEN _l WHEN len(_s) > 1 AND upper(_s[-1]) IN ({_list(vocab.US_STATES)[1:-1]}) THEN 'US' END AS country,
  CASE WHEN len(_s) = 1 AND _f IS NULL AND NOT (lower(_s[1]) IN ({_list(vocab.REGIONS)[1:-1]}) OR contains(lower(_s[1]), ' or ')) THEN _s[1]
       WHEN len(_s) > 1 AND _l IS NOT NULL AND _f IS DISTINCT FROM _l THEN _s[1]
       WHEN len(_s) > 1 AND _l IS NULL AND upper(_s[-1]) IN ({_list(vocab.US_STATES)[1:-1]}) THEN _s[1] END AS city
  FROM {prefix}_c)"""


def sql_categories(text: str) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(lower({text}), '{vocab.alternation(w)}') THEN '{c}' END" for c, w in sorted(vocab.CATEGORIES.items()))
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def sql_title_level(text: str) -> str:
    order = sorted(vocab.LEVELS, key=lambda c: -vocab.SENIORITY[c])
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({text}), '{vocab.alternation(vocab.LEVELS[c])}') THEN '{c}'" for c in order) + " END"


def sql_years(text: str) -> str:
    return f"list_max(list_transform(regexp_extract_all({text}, '(?i){vocab.YEARS_PATTERN}', 1), lambda y: TRY_CAST(y AS INT)))"


def sql_level(title: str, text: str) -> str:
    return f"coalesce({sql_title_level(title)}, CASE WHEN {sql_years(text)} >= {vocab.SENIOR_YEARS} THEN 'senior' END, '{vocab.UNSPECIFIED}')"


def sql_rank(tier: str) -> str:
    return f"CASE {tier} " + " ".join(f"WHEN '{t}' THEN {r}" for t, r in vocab.TIER_RANK.items()) + " ELSE 0 END"


POSTINGS = f"""pk AS (SELECT *, CAST('0x' || substr(md5(lower(substr(text, 1, 40))), 1, 8) AS BIGINT) AS k FROM documents),
pb AS (SELECT doc_id AS id, k % (SELECT count(*) FROM supplier) AS company_id, source AS source_id, CAST(doc_id AS VARCHAR) AS external_id,
  {sql_pick(ROLES, 'k')} || ' ' || substr(text, 1, 40) AS title, text || chr(10) || {sql_pick(NOTES, 'k')} AS description,
  'https://jobs.example/' || doc_id AS url, {sql_pick(PLACES, 'k')} AS location_raw, {sql_pick(STATUSES, 'doc_id')} AS user_status, {sql_pick(TIERS, 'doc_id')} AS sponsor_tier,
  CASE WHEN doc_id % 7 <> 0 THEN TIMESTAMP '{EPOCH}' + to_days(CAST(doc_id % 90 AS INT)) END AS posted_at, sha256(text) AS content_hash,
  CASE WHEN doc_id % 11 = 0 AND doc_id > 0 THEN doc_id - 1 END AS canonical_id FROM pk),
{sql_location('location_raw', 'pl', 'pb')},
postings AS (SELECT *, {sql_categories('title')} AS categories, {sql_level('title', "title || chr(10) || description")} AS level FROM pl)"""

COMPANIES = f"""companies AS (SELECT CAST(s_suppkey % (SELECT count(*) FROM supplier) AS BIGINT) AS id, s_name AS name, {sql_pick(['greenhouse', 'lever', 'ashby', 'workday', 'none'], 's_suppkey')} AS ats_type,
  CAST(s_suppkey % 3 + 1 AS INT) AS priority, {sql_pick(['ok', 'degraded', 'quarantined', 'ok'], 's_suppkey')} AS health, CAST(s_suppkey % 2 * 4 AS INT) AS registry_flags,
  CASE WHEN s_suppkey % 3 <> 0 THEN TIMESTAMP '{EPOCH}' END AS last_success_at FROM supplier)"""
