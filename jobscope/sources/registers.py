"""Sponsor registers and seed lists from CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.functions.names import split_trading_as
from jobscope.operators.registry import first_rows


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all strings; ``pos`` orders rows as the file does."""
    return spark.read.option("header", True).option("multiLine", False).option("escape", '"').csv(path).withColumn("pos", F.monotonically_increasing_id())


def _entries(rows: DataFrame, registry: str, evidence: Column, aliases: Column, name: Column) -> DataFrame:
    return rows.select(F.lit(registry).alias("registry"), F.col("pos").cast("long").alias("pos"), name.alias("name"), aliases.alias("aliases"), evidence.alias("evidence"))


def uk_entries(rows: DataFrame) -> DataFrame:
    """The first row of each organisation, its trading names as aliases and its route as evidence."""
    named = rows.withColumn("_name", F.trim("Organisation Name")).where("_name is not null and _name != ''")
    parts = split_trading_as(F.col("_name"))
    return _entries(first_rows(named, [F.lower("_name")]), "UK", F.trim("Route"), parts["aliases"], parts["legal"])


def nl_entries(rows: DataFrame) -> DataFrame:
    """Every entity, with its register number."""
    named = rows.withColumn("_name", F.trim("Organisation")).where("_name is not null and _name != ''")
    return _entries(named, "NL", F.concat(F.lit("KvK "), F.trim("KvK number")), F.array().cast("array<string>"), F.col("_name"))


def us_entries(rows: DataFrame) -> DataFrame:
    """One entry for each employer with certified filings: their count, and all names it trades under."""
    certified = rows.where(F.col("CASE_STATUS").isin("Certified", "Certified - Withdrawn")).withColumn("_raw", F.trim("EMPLOYER_NAME")).where("_raw is not null and _raw != ''")
    dba = F.nullif(F.trim("TRADE_NAME_DBA"), F.lit(""))
    grouped = certified.groupBy("_raw").agg(F.count(F.lit(1)).alias("n"), F.collect_set(dba).alias("dba"), F.min("pos").alias("pos"))
    parts = split_trading_as(F.col("_raw"))
    evidence = F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " certified LCA filing").otherwise(" certified LCA filings"))
    return _entries(grouped, "US", evidence, F.array_sort(F.array_union(parts["aliases"], "dba")), parts["legal"])


def seed_companies(rows: DataFrame) -> DataFrame:
    return rows.select("name", "ats_type", "ats_slug", "country_hq", F.col("priority").cast("int").alias("priority"))


#: Register readers by name.
REGISTERS = {"UK": uk_entries, "NL": nl_entries, "US": us_entries}
