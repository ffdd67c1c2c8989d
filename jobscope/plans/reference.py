"""Queries of the constant tables, settings and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.functions.text import first_non_empty
from jobscope.plans.postings import POSTINGS, postings
from jobscope.schemas import COUNTRY_REFERENCE, VERIFIED_AT, country_reference, listed_countries


def country_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed_countries(spark)


def country_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with what the reference says of their country, if it knows it."""
    known = country_reference(spark).select(F.col("code"), F.col("name").alias("country_name"), "priority_tier")
    p = postings(spark, sf_dir).select("id", "country")
    return p.join(F.broadcast(known), F.col("country") == F.col("code"), "left").select("id", "country", "country_name", "priority_tier")  # 11 rows


def settings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored settings before those of the environment, field by field, empty ones as if not there."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    k = F.col("n_nationkey")
    stored = F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.concat(F.lit("stored"), k.cast("string")))
    return n.select(k.cast("long").alias("id"), first_non_empty(stored, F.when(k % 2 == 0, F.concat(F.lit("env"), k.cast("string")))).alias("value"))


QUERIES = {f.__name__: f for f in (country_list, country_join, settings_merge)}

_cell = lambda v: "'" + v.replace("'", "''") + "'"
_ROWS = "c(code, name, visa_summary, pr_summary, citizenship_summary, registry_name, priority_tier, source_url) AS (VALUES " + ", ".join("(" + ", ".join(map(_cell, r)) + ")" for r in COUNTRY_REFERENCE) + ")"
ORACLES = {
    "country_list": f"WITH {_ROWS} SELECT *, DATE '{VERIFIED_AT}' AS verified_at FROM c ORDER BY CASE priority_tier WHEN 'primary' THEN 0 ELSE 1 END, name",
    "country_join": f"WITH {POSTINGS}, {_ROWS} SELECT id, country, c.name AS country_name, priority_tier FROM postings LEFT JOIN c ON country = code",
    "settings_merge": "SELECT CAST(n_nationkey AS BIGINT) AS id, coalesce(CASE WHEN n_nationkey % 3 = 1 THEN 'stored' || n_nationkey END, CASE WHEN n_nationkey % 2 = 0 THEN 'env' || n_nationkey END) AS value FROM nation",
}
