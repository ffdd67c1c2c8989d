"""Queries of registers and of the small tables' lists: metadata, the refresh as a whole, orders, deletes, the boards of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.functions import names
from jobscope.operators import ingest, registry, state
from jobscope.plans.entities import _ENTRIES, _entries
from jobscope.plans.postings import COMPANIES, EPOCH, POSTINGS, companies, pick, postings, sql_pick
from jobscope.plans.state import NOW
from jobscope.schemas import COUNTRY_REFERENCE, country_reference
from jobscope.store import with_ids


def _refreshed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Two registers read anew, a third that is empty now, and one that isn't read; some firms have the manual bit."""
    n = F.col("id")
    firms = companies(spark, sf_dir).withColumns({"registry_flags": F.when(n % 4 == 0, 8).when(n % 4 == 1, 9).otherwise(2), "match_confidence": F.lit(0.5), "match_evidence": F.lit("old")})
    meta = spark.read.parquet(f"{sf_dir}/region.parquet").select(pick(["UK", "NL", "AU", "US", "CA"], F.col("r_regionkey")).alias("registry"), F.lit(EPOCH).cast("timestamp").alias("fetched_at"), F.col("r_regionkey").cast("long").alias("row_count")).where("registry != 'US'")
    return registry.refresh_all(firms, postings(spark, sf_dir), _entries(spark, sf_dir), meta, ["UK", "US", "NL"], NOW)


def registers_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refreshed(spark, sf_dir)[0].select("id", "registry_flags", "match_confidence", "match_evidence")


def registers_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refreshed(spark, sf_dir)[1].groupBy("company_id", "sponsor_tier").agg(F.count(F.lit(1)).alias("n"))


def registers_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of all registers beside the totals of the refresh."""
    _, _, meta, totals = _refreshed(spark, sf_dir)
    return meta.join(totals)  # one row of totals


def search_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as searches and orders as what was notified: deleting some searches takes their matches along."""
    searches = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"))
    seen = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("search_id"), F.col("o_orderkey").alias("job_canonical_id"))
    kept, left, gone = state.delete_search(searches, seen, F.col("id") % 9 == 4)
    return left.groupBy("search_id").agg(F.count(F.lit(1)).alias("n")).join(kept, F.col("search_id") == F.col("id"), "full_outer").select("id", "search_id", "n").join(gone)  # one row


def job_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as postings and their lines as scores: scores go with their posting, a resume's go with nothing."""
    jobs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), "o_orderpriority")
    scores = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("job_canonical_id"), "l_linenumber")
    kept, left, gone = state.delete_jobs(jobs, scores, F.col("o_orderpriority") == "5-LOW")
    return kept.agg(F.count(F.lit(1)).alias("jobs")).join(left.agg(F.count(F.lit(1)).alias("scores"), F.sum("job_canonical_id").alias("keys"))).join(gone)  # one row each


def run_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boards of a whole run in its order, and that of a run for one slug."""
    n = F.col("id")
    firms = companies(spark, sf_dir).withColumns({"active": n % 6 != 4, "ats_slug": F.concat(F.lit("slug"), (n % 7).cast("string"))})
    every = with_ids(ingest.of_boards(firms), 1, ["priority", "name"], "place").select(F.lit("all").alias("run"), "place", "id")
    one = with_ids(ingest.of_boards(firms, "slug3"), 1, ["priority", "name"], "place").select(F.lit("slug3").alias("run"), "place", "id")
    return every.unionByName(one)


def list_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of lists: active companies by priority and name, the probe list of the quarantined, searches by id, registers by name."""
    firms = companies(spark, sf_dir).withColumn("active", F.col("id") % 6 != 4)
    placed = lambda df, kind, order, name: with_ids(df, 1, order, "place").select(F.lit(kind).alias("list"), "place", F.col(name).cast("string").alias("item"))
    active = firms.where("active")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    parts = [placed(active, "active", ["priority", "name"], "name"), placed(active.where("health = 'quarantined'"), "probes", ["priority", "name"], "name"), placed(spark.read.parquet(f"{sf_dir}/customer.parquet"), "searches", ["c_custkey"], "c_name"), placed(nations, "registers", ["n_name"], "n_name")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def registry_names_firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registers that each firm's bits name."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return s.select(F.col("s_suppkey").alias("id"), F.array_join(names.registry_names((F.col("s_suppkey") % 16).cast("int")), ",").alias("names"))


_CODES = [r[0] for r in COUNTRY_REFERENCE]


def country_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's order of the countries that customers stand for, with how many they are."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(pick(_CODES, F.col("c_nationkey")).alias("code")).agg(F.count(F.lit(1)).alias("customers"))
    met = country_reference(spark).join(c, "code").withColumn("_later", (F.col("priority_tier") != "primary").cast("int"))
    return with_ids(met, 1, ["_later", "name"], "place").select("place", "code", "name", "priority_tier", "customers")


QUERIES = {f.__name__: f for f in (registers_matched, registers_tiers, registers_recorded, search_delete, job_delete, run_boards, list_orders, registry_names_firms, country_order)}

_FIRMS = f"""{COMPANIES}, firms AS (SELECT *, CASE WHEN id % 4 = 0 THEN 8 WHEN id % 4 = 1 THEN 9 ELSE 2 END AS flags FROM companies), {_ENTRIES},
roll AS (SELECT seed, CAST(bit_or(bit) AS INT) AS flags, max(confidence) AS confidence, string_agg(registry || ' ' || coalesce(evidence, printf('%.2f', confidence)), '; ' ORDER BY bit) AS evidence FROM best GROUP BY seed),
done AS (SELECT f.id, coalesce(r.flags, 0) AS machine, f.flags & 8 AS kept, f.flags AS old, r.confidence, r.evidence FROM firms f LEFT JOIN roll r ON r.seed = f.name),
new AS (SELECT id, machine, CASE WHEN machine = 0 AND kept <> 0 THEN old ELSE machine | kept END AS registry_flags, CASE WHEN machine = 0 AND kept <> 0 THEN 0.5::DOUBLE WHEN kept <> 0 THEN 1.0::DOUBLE ELSE confidence END AS match_confidence, CASE WHEN machine = 0 AND kept <> 0 THEN 'old' ELSE evidence END AS match_evidence FROM done)"""
_NAMES = " || ".join(f"CASE WHEN s_suppkey % 16 & {bit} <> 0 THEN ['{name}'] ELSE [] END" for name, bit in registry.vocab.REGISTRY_BITS.items())
_CELL = lambda v: "'" + v.replace("'", "''") + "'"
_REFERENCE = "VALUES " + ", ".join(f"({_CELL(r[0])}, {_CELL(r[1])}, {_CELL(r[6])})" for r in COUNTRY_REFERENCE)

ORACLES = {
    "registers_matched": f"WITH {_FIRMS} SELECT id, registry_flags, match_confidence, match_evidence FROM new",
    "registers_tiers": f"WITH {POSTINGS}, {_FIRMS} SELECT company_id, CASE WHEN new.id IS NULL OR sponsor_tier IN ('explicit_yes', 'explicit_no') THEN sponsor_tier WHEN registry_flags <> 0 THEN 'registry_inferred' ELSE 'unknown' END AS sponsor_tier, count(*) AS n FROM postings p LEFT JOIN new ON new.id = p.company_id GROUP BY 1, 2",
    "registers_recorded": f"WITH {_FIRMS}, o AS (SELECT {sql_pick(['UK', 'NL', 'AU', 'US', 'CA'], 'r_regionkey')} AS registry, TIMESTAMP '{EPOCH}' AS fetched_at, CAST(r_regionkey AS BIGINT) AS row_count FROM region), md AS (SELECT * FROM o WHERE registry IN ('AU', 'CA') UNION ALL SELECT r, TIMESTAMP '{NOW}', (SELECT count(*) FROM entries WHERE registry = r) FROM (VALUES ('UK'), ('US'), ('NL')) v(r)) SELECT registry, fetched_at, row_count, (SELECT count(*) FROM new) AS companies, (SELECT count(*) FROM new WHERE machine <> 0) AS matched FROM md",
    "search_delete": "WITH c AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 9 <> 4), o AS (SELECT o_custkey AS search_id, count(*) AS n FROM orders WHERE o_custkey % 9 <> 4 GROUP BY 1) SELECT id, search_id, n, (SELECT count(*) FROM customer WHERE c_custkey % 9 = 4) AS deleted FROM c FULL JOIN o ON id = search_id",
    "job_delete": "WITH j AS (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW') SELECT (SELECT count(*) FROM j) AS jobs, count(*) AS scores, CAST(sum(l_orderkey) AS BIGINT) AS keys, (SELECT count(*) FROM orders WHERE o_orderpriority = '5-LOW') AS deleted FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM j)",
    "run_boards": f"WITH {COMPANIES}, b AS (SELECT * FROM companies WHERE id % 6 <> 4 AND ats_type <> 'none') SELECT 'all' AS run, row_number() OVER (ORDER BY priority, name) AS place, id FROM b UNION ALL SELECT 'slug3', row_number() OVER (ORDER BY priority, name), id FROM b WHERE id % 7 = 3",
    "list_orders": f"WITH {COMPANIES}, a AS (SELECT * FROM companies WHERE id % 6 <> 4) SELECT 'active' AS list, row_number() OVER (ORDER BY priority, name) AS place, name AS item FROM a UNION ALL SELECT 'probes', row_number() OVER (ORDER BY priority, name), name FROM a WHERE health = 'quarantined' UNION ALL SELECT 'searches', row_number() OVER (ORDER BY c_custkey), c_name FROM customer UNION ALL SELECT 'registers', row_number() OVER (ORDER BY n_name), n_name FROM nation",
    "registry_names_firms": f"SELECT s_suppkey AS id, array_to_string({_NAMES}, ',') AS names FROM supplier",
    "country_order": f"WITH c AS (SELECT {sql_pick(_CODES, 'c_nationkey')} AS code, count(*) AS customers FROM customer GROUP BY 1), r(code, name, priority_tier) AS ({_REFERENCE}) SELECT row_number() OVER (ORDER BY CASE priority_tier WHEN 'primary' THEN 0 ELSE 1 END, name) AS place, code, name, priority_tier, customers FROM r JOIN c USING (code)",
}
