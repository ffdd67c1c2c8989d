"""Queries of state: merges, sweeps, ledgers, health, budgets."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobscope import buckets, vocab
from jobscope.operators import health, ingest, state
from jobscope.operators.fit import blocks
from jobscope.operators.registry import stale_registers
from jobscope.plans.postings import COMPANIES, EPOCH, POSTINGS, companies, postings, wide_postings
from jobscope.store import new_path

NOW = "2026-03-01 00:00:00"
#: Failures come close together in the test events, so the fold runs with small thresholds.
TOY = {"gone": 2, "schema_drift": 3, "unreachable": 4}


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = wide_postings(spark, sf_dir).where("id % 3 <> 0")
    return p.withColumns({"categories": F.array_join("categories", ","), "sponsor_evidence": F.concat(F.lit("old "), F.col("external_id")), "first_seen_at": F.lit(EPOCH).cast("timestamp"), "last_seen_at": F.lit(EPOCH).cast("timestamp"), "closed_at": F.when(F.col("id") % 10 == 1, F.lit(EPOCH).cast("timestamp")), "consecutive_misses": (F.col("id") % 3).cast("int")})


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later poll: even ids, some with a changed text, some classified anew, some without a signal."""
    p = wide_postings(spark, sf_dir).where("id % 2 = 0")
    n = F.col("id")
    changed = n % 5 == 0
    fresh = n % 4 == 0
    return p.select(
        "company_id", "source_id", "external_id", "url", "location_raw", "country", "city", "posted_at",
        F.concat("title", F.lit("!")).alias("title"), "description",
        F.when(changed, F.concat(F.lit("new"), "content_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(fresh, F.array_join("categories", ",")).alias("categories"), F.when(fresh, F.col("level")).alias("level"),
        F.when(fresh, "explicit_yes").alias("sponsor_tier"), F.when(fresh & (n % 8 == 0), "offers").alias("sponsor_evidence"),
        F.lit(NOW).cast("timestamp").alias("seen_at"),
    )


_KEPT = ["id", "source_id", "external_id", "title", "content_hash", "categories", "level", "sponsor_tier", "sponsor_evidence", "user_status", "first_seen_at", "last_seen_at", "consecutive_misses"]


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.upsert_jobs(_stored(spark, sf_dir), _incoming(spark, sf_dir)).select(*_KEPT)


def upsert_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same poll merged again changes nothing."""
    once = state.upsert_jobs(_stored(spark, sf_dir), _incoming(spark, sf_dir))
    return state.upsert_jobs(once, _incoming(spark, sf_dir)).select(*_KEPT)


def changed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.changed_only(_incoming(spark, sf_dir), _stored(spark, sf_dir)).select("source_id", "external_id")


def upsert_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``upsert_merge`` into a table kept in buckets."""
    root = new_path(spark, "jobs-buckets")
    buckets.create(_stored(spark, sf_dir), root, ["source_id", "external_id"], 16)
    return buckets.read_buckets(spark, state.upsert_into(spark, root, _incoming(spark, sf_dir))).select(*_KEPT)


POLLS = ["2026-02-01 00:00:00", "2026-02-02 00:00:00", "2026-02-03 00:00:00"]


def polls_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three polls of some companies at once: postings are in one of them, several or none."""
    jobs, n = _stored(spark, sf_dir), F.col("id")
    days = [F.when(cond, F.lit(p).cast("timestamp")) for cond, p in zip((n % 2 == 0, n % 5 == 0, n % 4 == 1), POLLS, strict=True)]
    seen = jobs.select("source_id", "external_id", F.filter(F.array(*days), lambda d: d.isNotNull()).alias("presence")).where(F.size("presence") > 0)
    return state.sweep_polls(jobs, seen, F.col("company_id") < 15, POLLS).select("id", "consecutive_misses", "closed_at")


def get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers beyond the tenth as employers that postings name, each in several countries, of which the first counts."""
    have = companies(spark, sf_dir).where("id < 10").withColumn("country_hq", F.lit("DE"))
    s, n = spark.read.parquet(f"{sf_dir}/supplier.parquet"), F.col("s_suppkey")
    new = s.select(F.col("s_name").alias("name"), F.when(n % 3 != 0, F.lit("SE")).alias("country"), F.lit(1).alias("pos")).unionByName(s.select(F.col("s_name").alias("name"), F.lit("XX").alias("country"), F.lit(2).alias("pos")))
    return state.get_or_create_companies(have, new).select("id", "name", "ats_type", "priority", "health", "registry_flags", "country_hq")


def _open_poll(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Even postings come from one source of many employers, of which ten are known; every tenth names none, or an empty one; five more rows couldn't be read."""
    n, board = F.col("id"), F.lit("open")
    firms = companies(spark, sf_dir)
    have = firms.where("id < 10").withColumn("country_hq", F.lit("DE"))
    jobs = _stored(spark, sf_dir).drop("source_id").withColumn("source_id", board).withColumn("categories", F.split("categories", ","))
    came = postings(spark, sf_dir).where(n % 2 == 0).join(firms.select(F.col("id").alias("company_id"), F.col("name").alias("_firm")), "company_id")
    came = came.withColumns({"company_name": F.when(n % 20 == 4, F.lit("")).when(n % 20 != 14, F.col("_firm")), "source_id": board, "pos": n}).drop("id", "company_id", "user_status", "sponsor_tier", "canonical_id", "categories", "level", "_firm")
    return ingest.poll(jobs, have, came, NOW, "open", fetched=came.count() + 5)


def companyless_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the poll, beside the employers that it leaves."""
    _, firms, counters = _open_poll(spark, sf_dir)
    shadows = firms.where(F.col("ats_type") == vocab.SHADOW_ATS).where(F.col("priority") == vocab.SHADOW_PRIORITY)
    return counters.join(shadows.agg(F.count(F.lit(1)).alias("shadows"), F.count_if(F.col("country_hq") != "").alias("placed")))  # one row each


def companyless_poll_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, firms, _ = _open_poll(spark, sf_dir)
    named = firms.select(F.col("id").alias("company_id"), F.col("name").alias("company"), "country_hq")
    return jobs.where(F.col("last_seen_at") == F.lit(NOW).cast("timestamp")).join(named, "company_id", "left").select("external_id", "consecutive_misses", "closed_at", F.when(F.col("consecutive_misses") == 0, F.col("user_status")).alias("user_status"), F.when(F.col("first_seen_at") == F.lit(NOW).cast("timestamp"), F.col("company")).alias("new_company"))


def closed_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _stored(spark, sf_dir)
    seen = jobs.where("id % 2 = 0").select("source_id", "external_id")
    return state.sweep(jobs, seen, F.col("company_id") < 15, NOW).select("id", "consecutive_misses", "closed_at")


def misses_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as postings and days as polls: a user without an event on a day was absent."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("key"), F.to_date("ts").alias("poll")).distinct()
    users, days = e.select("key").distinct(), e.select("poll").distinct()
    # days go to the users in parts of bounded size
    polls = reduce(DataFrame.unionByName, (users.join(F.broadcast(part)) for part in blocks(days, "poll", 10_000))).join(e.withColumn("here", F.lit(True)), ["key", "poll"], "left").select("key", "poll", F.coalesce("here", F.lit(False)).alias("present"))
    return state.miss_streaks(polls)


def ledger_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ledger = o.where("o_orderkey % 2 = 0").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    rows = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    return state.insert_ignore(ledger, rows, ["o_custkey"])


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    parents, children = state.delete_cascade(t("customer"), t("orders"), "c_custkey", "o_custkey", F.col("c_nationkey") == 3)
    return parents.agg(F.count(F.lit(1)).alias("customers")).join(children.agg(F.count(F.lit(1)).alias("orders"), F.sum("o_orderkey").alias("keys")))


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrity as a query: lines whose order isn't there."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    return t("lineitem").join(t("orders").where("o_orderstatus <> 'P'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as failures of a kind by event id, views as probes, all else as good polls."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "error", F.element_at(F.array(*map(F.lit, TOY)), (F.col("event_id") % 3).cast("int") + 1)).when((F.col("event_type") == "view") & (F.col("event_id") % 9 == 0), "probe_success").when(F.col("event_id") % 4 == 0, "success").otherwise("probe_failure")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"))


def health_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.fold_health(_events(spark, sf_dir), TOY)


def health_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = health.health_summary(companies(spark, sf_dir))
    return s.withColumn("by_ats", F.array_join(F.transform(F.array_sort(F.map_entries("by_ats")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


def quarantine_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.health_alerts(companies(spark, sf_dir).withColumns({"active": F.lit(True), "quarantine_reason": F.lit("gone")}))


def poll_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supported boards that are polled: active and not quarantined."""
    c = companies(spark, sf_dir)
    return c.where(F.col("ats_type").isin(vocab.SUPPORTED_ATS) & (F.col("health") != "quarantined")).select("id", "name")


def poll_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n = F.col("o_orderkey")
    outcome = health.poll_outcome(n % 5, n % 3, F.when(n % 11 == 0, "gone"))
    return o.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def budget_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", F.col("event_id").alias("call_id"))
    return state.admit_calls(e, 500).groupBy("month").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("refused"))


def active_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("id"))
    return state.activate_resume(s, 7)


def prune_backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("backup-"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("name"))
    return state.prune_backups(p)


def stale_registries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    meta = n.select(F.col("n_name").alias("registry"), (F.lit(EPOCH).cast("timestamp") + F.make_dt_interval((F.col("n_nationkey") * 4).cast("int"))).alias("fetched_at"), F.col("n_nationkey").cast("long").alias("row_count"))
    return stale_registers(meta, datetime(2026, 3, 1))


def latest_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of each customer, by date and key."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return o.withColumn("r", rank).where("r = 1").select("o_custkey", "o_orderkey")


_STORED = f"{POSTINGS}, stored AS (SELECT *, 'old ' || external_id AS sponsor_evidence, TIMESTAMP '{EPOCH}' AS first_seen_at, TIMESTAMP '{EPOCH}' AS last_seen_at, CASE WHEN id % 10 = 1 THEN TIMESTAMP '{EPOCH}' END AS closed_at, CAST(id % 3 AS INT) AS consecutive_misses, array_to_string(categories, ',') AS cats FROM postings WHERE id % 3 <> 0)"
_IN = "inc AS (SELECT *, title || '!' AS t2, CASE WHEN id % 5 = 0 THEN 'new' || content_hash ELSE content_hash END AS h2, id % 4 = 0 AS fresh, array_to_string(categories, ',') AS cats FROM postings WHERE id % 2 = 0)"
_UPSERT = f"""WITH {_STORED}, {_IN}, fresh AS (SELECT i.id, row_number() OVER (ORDER BY i.source_id, i.external_id) AS k FROM inc i LEFT JOIN stored s ON s.source_id = i.source_id AND s.external_id = i.external_id WHERE s.id IS NULL)
  SELECT coalesce(s.id, (SELECT max(id) FROM stored) + k) AS id, coalesce(s.source_id, i.source_id) AS source_id, coalesce(s.external_id, i.external_id) AS external_id, coalesce(i.t2, s.title) AS title, coalesce(i.h2, s.content_hash) AS content_hash,
  coalesce(CASE WHEN i.fresh THEN i.cats END, s.cats) AS categories, coalesce(CASE WHEN i.fresh THEN i.level END, s.level) AS level, coalesce(CASE WHEN i.fresh THEN 'explicit_yes' END, s.sponsor_tier, 'unknown') AS sponsor_tier,
  CASE WHEN i.fresh THEN CASE WHEN i.id % 8 = 0 THEN 'offers' END ELSE s.sponsor_evidence END AS sponsor_evidence,
  CASE WHEN s.id IS NULL THEN 'new' WHEN i.id IS NOT NULL AND i.h2 <> s.content_hash THEN 'new' ELSE s.user_status END AS user_status,
  coalesce(s.first_seen_at, TIMESTAMP '{NOW}') AS first_seen_at, CASE WHEN i.id IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE s.last_seen_at END AS last_seen_at, coalesce(s.consecutive_misses, 0) AS consecutive_misses
  FROM stored s FULL JOIN inc i ON s.source_id = i.source_id AND s.external_id = i.external_id LEFT JOIN fresh ON fresh.id = i.id"""
_OPEN = f"""WITH {_STORED}, {COMPANIES}, came AS (SELECT p.*, c.name AS firm FROM postings p JOIN companies c ON c.id = p.company_id WHERE p.id % 2 = 0),
said AS (SELECT * FROM came WHERE id % 20 NOT IN (4, 14)), shadows AS (SELECT firm, arg_min(coalesce(country, ''), id) AS c, nullif(arg_min(coalesce(country, ''), id), '') AS country FROM said WHERE company_id >= 10 GROUP BY firm)"""
_TOY_CASE = "CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in TOY.items()) + " END"
_FOLD = f"""WITH RECURSIVE k AS (SELECT 'u' || user_id AS source, ts, event_id AS seq, CASE WHEN event_type = 'error' THEN {list(TOY)}[CAST(event_id % 3 AS INT) + 1] WHEN event_type = 'view' AND event_id % 9 = 0 THEN 'probe_success' WHEN event_id % 4 = 0 THEN 'success' ELSE 'probe_failure' END AS kind FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts, seq) AS r FROM k),
f AS (SELECT source, 0::BIGINT AS r, 0 AS failures, 'ok' AS health, NULL::VARCHAR AS reason, NULL::TIMESTAMP AS last_success FROM (SELECT DISTINCT source FROM n)
  UNION ALL SELECT f.source, n.r,
    CASE WHEN kind = 'probe_success' OR (kind = 'success' AND health <> 'quarantined') THEN 0 WHEN health = 'quarantined' OR {_TOY_CASE} IS NULL THEN failures ELSE failures + 1 END,
    CASE WHEN kind = 'probe_success' OR (kind = 'success' AND health <> 'quarantined') THEN 'ok' WHEN health = 'quarantined' OR {_TOY_CASE} IS NULL THEN health WHEN failures + 1 >= {_TOY_CASE} THEN 'quarantined' ELSE 'degraded' END,
    CASE WHEN kind = 'probe_success' OR (kind = 'success' AND health <> 'quarantined') THEN NULL WHEN health = 'quarantined' OR {_TOY_CASE} IS NULL THEN reason ELSE kind END,
    CASE WHEN kind = 'probe_success' OR (kind = 'success' AND health <> 'quarantined') THEN n.ts ELSE last_success END
  FROM f JOIN n ON f.source = n.source AND n.r = f.r + 1)
SELECT source, failures, health, reason, last_success FROM f QUALIFY row_number() OVER (PARTITION BY source ORDER BY r DESC) = 1"""

QUERIES = {
    f.__name__: f
    for f in (upsert_merge, upsert_twice, upsert_buckets, polls_folded, changed_only, get_or_create, companyless_poll, companyless_poll_jobs, closed_sweep, misses_streak, ledger_insert_ignore, cascade_delete, orphans, health_fold, health_counts, quarantine_alerts, poll_gate, poll_outcomes, budget_admission, active_resume, prune_backups, stale_registries, latest_active)
}

ORACLES = {
    "upsert_merge": _UPSERT,
    "upsert_twice": _UPSERT,
    "changed_only": f"WITH {_STORED}, {_IN} SELECT i.source_id, i.external_id FROM inc i LEFT JOIN stored s ON s.source_id = i.source_id AND s.external_id = i.external_id WHERE s.id IS NULL OR s.content_hash <> i.h2",
    "upsert_buckets": _UPSERT,
    "polls_folded": f"WITH {_STORED}, l AS (SELECT *, CASE WHEN id % 4 = 1 THEN 3 WHEN id % 5 = 0 THEN 2 WHEN id % 2 = 0 THEN 1 ELSE 0 END AS last, {POLLS}::TIMESTAMP[] AS t FROM stored), m AS (SELECT *, CASE WHEN last > 0 THEN 3 - last ELSE consecutive_misses + 3 END AS misses, CASE WHEN last > 0 THEN last + {vocab.CLOSE_AFTER_MISSES} ELSE greatest(1, {vocab.CLOSE_AFTER_MISSES} - consecutive_misses) END AS step FROM l) SELECT id, CAST(CASE WHEN company_id < 15 THEN misses ELSE consecutive_misses END AS INT) AS consecutive_misses, CASE WHEN company_id >= 15 OR (last = 0 AND closed_at IS NOT NULL) THEN closed_at ELSE t[step] END AS closed_at FROM m",
    "get_or_create": f"WITH {COMPANIES}, h AS (SELECT * FROM companies WHERE id < 10), n AS (SELECT s_name AS name, min(CASE WHEN s_suppkey % 3 <> 0 THEN 'SE' ELSE '' END) AS country FROM supplier WHERE s_name NOT IN (SELECT name FROM h) GROUP BY s_name) SELECT id, name, ats_type, priority, health, registry_flags, 'DE' AS country_hq FROM h UNION ALL SELECT (SELECT max(id) FROM h) + row_number() OVER (ORDER BY name), name, 'none', 5, 'ok', 0, country FROM n",
    "companyless_poll": f"{_OPEN} SELECT CAST((SELECT count(*) FROM came) + 5 AS BIGINT) AS fetched, (SELECT count(*) FROM said) AS upserted, CAST((SELECT count(*) FROM came) + 5 - (SELECT count(*) FROM said) AS BIGINT) AS errors, (SELECT count(*) FROM stored WHERE closed_at IS NULL AND id % 2 = 1 AND consecutive_misses + 1 >= {vocab.CLOSE_AFTER_MISSES}) AS closed, NULL::VARCHAR AS failure, (SELECT count(*) FROM shadows) AS shadows, (SELECT count(*) FROM shadows WHERE country IS NOT NULL) AS placed",
    "companyless_poll_jobs": f"{_OPEN} SELECT s.external_id, 0 AS consecutive_misses, NULL::TIMESTAMP AS closed_at, CASE WHEN k.id IS NULL OR k.content_hash <> s.content_hash THEN 'new' ELSE k.user_status END AS user_status, CASE WHEN k.id IS NULL THEN s.firm END AS new_company FROM said s LEFT JOIN stored k USING (id)",
    "closed_sweep": f"WITH {_STORED} SELECT id, CASE WHEN company_id >= 15 THEN consecutive_misses WHEN id % 2 = 0 THEN 0 ELSE consecutive_misses + 1 END AS consecutive_misses, CASE WHEN company_id >= 15 THEN closed_at WHEN id % 2 = 0 THEN NULL WHEN closed_at IS NULL AND consecutive_misses + 1 >= {vocab.CLOSE_AFTER_MISSES} THEN TIMESTAMP '{NOW}' ELSE closed_at END AS closed_at FROM stored",
    "misses_streak": f"WITH e AS (SELECT DISTINCT user_id AS key, CAST(ts AS DATE) AS poll FROM events), p AS (SELECT u.key, d.poll, e.key IS NOT NULL AS present FROM (SELECT DISTINCT key FROM e) u CROSS JOIN (SELECT DISTINCT poll FROM e) d LEFT JOIN e ON e.key = u.key AND e.poll = d.poll), i AS (SELECT *, sum(CAST(present AS INT)) OVER (PARTITION BY key ORDER BY poll) AS island FROM p) SELECT key, poll, CAST(sum(CASE WHEN present THEN 0 ELSE 1 END) OVER (PARTITION BY key, island ORDER BY poll) AS BIGINT) AS misses, sum(CASE WHEN present THEN 0 ELSE 1 END) OVER (PARTITION BY key, island ORDER BY poll) >= {vocab.CLOSE_AFTER_MISSES} AS closed FROM i",
    "ledger_insert_ignore": "WITH l AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) SELECT * FROM l UNION ALL SELECT o_custkey, max(o_orderkey) FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM l) GROUP BY 1",
    "cascade_delete": "SELECT (SELECT count(*) FROM customer WHERE c_nationkey <> 3) AS customers, count(*) AS orders, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)",
    "orphans": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1",
    "health_fold": _FOLD,
    "health_counts": f"WITH {COMPANIES}, v AS (SELECT *, CASE WHEN ats_type IN ('greenhouse', 'lever', 'ashby') THEN health ELSE 'pending' END AS status FROM companies WHERE ats_type <> 'none') SELECT count(*) AS total, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'degraded') AS degraded, count(*) FILTER (status = 'quarantined') AS quarantined, count(*) FILTER (status = 'pending') AS pending, (SELECT string_agg(ats_type || '=' || n, ',' ORDER BY ats_type) FROM (SELECT ats_type, count(*) AS n FROM v GROUP BY 1)) AS by_ats FROM v",
    "quarantine_alerts": f"WITH {COMPANIES} SELECT name AS company, 'gone' AS reason, coalesce(strftime(last_success_at, '%Y-%m-%d'), 'never') AS since FROM companies WHERE health = 'quarantined'",
    "poll_gate": f"WITH {COMPANIES} SELECT id, name FROM companies WHERE ats_type IN ('greenhouse', 'lever', 'ashby') AND health <> 'quarantined'",
    "poll_outcomes": "SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'gone' WHEN o_orderkey % 5 > 0 AND o_orderkey % 3 = 0 THEN 'schema_drift' ELSE 'success' END AS outcome, count(*) AS n FROM orders GROUP BY 1",
    "budget_admission": "WITH m AS (SELECT strftime(timezone('Asia/Jakarta', timezone('UTC', ts)), '%Y-%m') AS month, ts, event_id FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY ts, event_id) AS r FROM m) SELECT month, count(*) FILTER (r <= 500) AS admitted, count(*) FILTER (r > 500) AS refused FROM r GROUP BY 1",
    "active_resume": "SELECT CAST(s_suppkey AS BIGINT) AS id, s_suppkey = 7 AS active FROM supplier",
    "prune_backups": "SELECT 'backup-' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS name FROM part ORDER BY name DESC LIMIT 14",
    "stale_registries": f"SELECT n_name AS registry, TIMESTAMP '{EPOCH}' + to_days(CAST(n_nationkey * 4 AS INT)) AS fetched_at, CAST(n_nationkey AS BIGINT) AS row_count FROM nation WHERE TIMESTAMP '{EPOCH}' + to_days(CAST(n_nationkey * 4 AS INT)) < TIMESTAMP '2026-03-01' - INTERVAL 45 DAY ORDER BY 1",
    "latest_active": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
}
