"""Queries of a poll's whole course and of the small tables beside it: seeds, residue, settings, usage, searches, resumes, registers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope import vocab
from jobscope.functions import classify
from jobscope.functions.labels import channel, label, search_summary
from jobscope.functions.resume import profile_json, read_profile, resume_text
from jobscope.functions.text import posted_ago
from jobscope.operators import fit, ingest, registry, search, state
from jobscope.operators.notify import parse_filters
from jobscope.plans.matching import _searches, _words
from jobscope.plans.postings import COMPANIES, EPOCH, POSTINGS, companies, pick, postings, sql_categories, sql_level, sql_pick, sql_years
from jobscope.plans.state import NOW, _stored
from jobscope.sources.registers import nl_entries, read_csv, seed_companies
from jobscope.store import new_path

ATS = ["greenhouse", "lever", "ashby", "workday", "none"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- seeds ----
def seed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as seeds; those with an odd key are there already, some on another board."""
    s = _table(spark, sf_dir, "supplier")
    n = F.col("s_suppkey")
    have = s.where(n % 2 == 1).select((n * 10).cast("long").alias("id"), F.col("s_name").alias("name"), pick(ATS, n).alias("ats_type"), F.lit("slug").alias("ats_slug"), F.lit("SE").alias("country_hq"), F.lit(5).alias("priority"), F.lit(1).alias("registry_flags"), F.lit(True).alias("active"), (n % 4).cast("int").alias("consecutive_failures"), pick(["ok", "degraded", "quarantined"], n).alias("health"), F.lit("gone").alias("quarantine_reason"))
    seeds = s.select(F.col("s_name").alias("name"), pick(ATS, n + F.when(n % 7 == 0, 1).otherwise(0)).alias("ats_type"), F.lit("slug").alias("ats_slug"), F.lit("DE").alias("country_hq"), (n % 3 + 1).cast("int").alias("priority"))
    return state.upsert_companies(have, seeds)


_SEEDS = f"""WITH s AS (SELECT s_suppkey AS n, s_name, {sql_pick(ATS, 's_suppkey')} AS old, {sql_pick(ATS, '(s_suppkey + CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE 0 END)')} AS new FROM supplier),
r AS (SELECT n, row_number() OVER (ORDER BY s_name) AS k FROM s WHERE n % 2 = 0), top AS (SELECT max(n * 10) AS t FROM s WHERE n % 2 = 1)
SELECT CAST(CASE WHEN n % 2 = 1 THEN n * 10 ELSE t + k END AS BIGINT) AS id, s_name AS name, new AS ats_type, 'slug' AS ats_slug, 'DE' AS country_hq, CAST(n % 3 + 1 AS INT) AS priority, CASE WHEN n % 2 = 1 THEN 1 ELSE 0 END AS registry_flags, TRUE AS active,
  CAST(CASE WHEN n % 2 = 1 AND old = new THEN n % 4 ELSE 0 END AS INT) AS consecutive_failures, CASE WHEN n % 2 = 1 AND old = new THEN {sql_pick(['ok', 'degraded', 'quarantined'], 'n')} ELSE 'ok' END AS health, CASE WHEN n % 2 = 1 AND old = new THEN 'gone' END AS quarantine_reason
FROM s LEFT JOIN r USING (n) CROSS JOIN top"""


# ---- a round of polls ----
def _firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id")
    return companies(spark, sf_dir).withColumns({"active": n % 6 != 4, "quarantine_reason": F.when(F.col("health") != "ok", "unreachable"), "consecutive_failures": F.when(F.col("health") == "degraded", 2).when(F.col("health") == "quarantined", 10).otherwise(0)})


def _round(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every firm is fetched: some fail, some drift (rows come, none can be read), some are empty, the others bring their even postings."""
    n = F.col("id")
    firms = _firms(spark, sf_dir)
    board = F.lit("board").alias("source_id")
    jobs = _stored(spark, sf_dir).drop("source_id").withColumn("source_id", board)
    jobs = jobs.withColumn("categories", F.split("categories", ","))
    mute = (F.col("company_id") % 7 == 3) | (F.col("company_id") % 7 == 5)
    came = postings(spark, sf_dir).where((n % 2 == 0) & ~mute).drop("source_id", "id", "user_status", "sponsor_tier", "canonical_id", "categories", "level").withColumn("source_id", board)
    sizes = came.groupBy(F.col("company_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    fetched = F.when(n % 7 == 3, 5).when(n % 7 == 5, 0).otherwise(F.coalesce("n", F.lit(0)) + n % 3)
    fetches = firms.join(sizes, "id", "left").select(n.alias("company_id"), board, fetched.cast("long").alias("fetched"), F.when(n % 11 == 4, "gone").alias("failure"))
    return ingest.poll_all(jobs, firms, came, fetches, NOW)


def poll_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each poll, and the health that it leaves its firm in."""
    _, firms, results = _round(spark, sf_dir)
    after = firms.select(F.col("id").alias("company_id"), "health", "consecutive_failures", "quarantine_reason", "last_success_at")
    return after.join(results, "company_id", "left")


def poll_cycle_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, _, _ = _round(spark, sf_dir)
    return jobs.select("id", "external_id", "company_id", "consecutive_misses", "closed_at", "last_seen_at")


_ROUND = f"""WITH {POSTINGS}, {COMPANIES},
firms AS (SELECT *, id % 6 <> 4 AS active, CASE WHEN health = 'degraded' THEN 2 WHEN health = 'quarantined' THEN 10 ELSE 0 END AS failures, CASE WHEN health <> 'ok' THEN 'unreachable' END AS reason FROM companies),
came AS (SELECT external_id, company_id FROM postings WHERE id % 2 = 0 AND company_id % 7 NOT IN (3, 5)),
sizes AS (SELECT company_id, count(*) AS n FROM came GROUP BY 1),
polls AS (SELECT id, coalesce(n, 0) AS n, CASE WHEN id % 7 = 3 THEN 5 WHEN id % 7 = 5 THEN 0 ELSE coalesce(n, 0) + id % 3 END AS fetched, id % 11 = 4 AS gone FROM firms LEFT JOIN sizes ON company_id = id WHERE active AND ats_type IN ('greenhouse', 'lever', 'ashby') AND health <> 'quarantined'),
told AS (SELECT *, CASE WHEN gone THEN 'gone' WHEN fetched > 0 AND n = 0 THEN 'schema_drift' END AS failure FROM polls),
good AS (SELECT id AS company_id FROM told WHERE failure IS NULL),
kept AS (SELECT *, CAST(id % 3 AS INT) AS misses, CASE WHEN id % 10 = 1 THEN TIMESTAMP '{EPOCH}' END AS closed FROM postings WHERE id % 3 <> 0),
here AS (SELECT external_id FROM came WHERE company_id IN (SELECT company_id FROM good)),
fresh AS (SELECT external_id, company_id, row_number() OVER (ORDER BY external_id) AS k FROM came WHERE external_id IN (SELECT external_id FROM here) AND external_id NOT IN (SELECT external_id FROM kept)),
swept AS (SELECT id, external_id, company_id, external_id IN (SELECT external_id FROM here) AS seen, company_id IN (SELECT company_id FROM good) AS polled, misses, closed FROM kept),
jobs AS (SELECT id, external_id, company_id, CASE WHEN polled AND seen THEN 0 WHEN polled THEN misses + 1 ELSE misses END AS consecutive_misses, polled AND NOT seen AND closed IS NULL AND misses + 1 >= {vocab.CLOSE_AFTER_MISSES} AS closes, polled AND seen AS open, closed, CASE WHEN seen THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '{EPOCH}' END AS last_seen_at FROM swept)"""
_POLLED = f"""{_ROUND}, shut AS (SELECT company_id, count(*) AS closed FROM jobs WHERE closes GROUP BY 1)
SELECT f.id AS company_id, CASE WHEN t.id IS NULL THEN f.health WHEN failure IS NULL THEN 'ok' WHEN f.failures + 1 >= 3 THEN 'quarantined' ELSE 'degraded' END AS health, CASE WHEN t.id IS NULL THEN f.failures WHEN failure IS NULL THEN 0 ELSE f.failures + 1 END AS consecutive_failures,
  CASE WHEN t.id IS NULL THEN f.reason WHEN failure IS NOT NULL THEN failure END AS quarantine_reason, CASE WHEN t.id IS NOT NULL AND failure IS NULL THEN TIMESTAMP '{NOW}' ELSE f.last_success_at END AS last_success_at,
  CAST(CASE WHEN failure = 'gone' THEN 0 ELSE fetched END AS BIGINT) AS fetched, CAST(CASE WHEN failure = 'gone' THEN 0 ELSE n END AS BIGINT) AS upserted, CAST(CASE WHEN failure = 'gone' THEN 1 ELSE fetched - n END AS BIGINT) AS errors, CASE WHEN t.id IS NOT NULL THEN coalesce(s.closed, 0) END AS closed, failure
FROM firms f LEFT JOIN told t ON t.id = f.id LEFT JOIN shut s ON s.company_id = f.id"""
_POLLED_JOBS = f"""{_ROUND} SELECT id, external_id, company_id, CAST(consecutive_misses AS INT) AS consecutive_misses, CASE WHEN closes THEN TIMESTAMP '{NOW}' WHEN NOT open THEN closed END AS closed_at, last_seen_at FROM jobs
UNION ALL SELECT (SELECT max(id) FROM kept) + k, external_id, company_id, 0, NULL, TIMESTAMP '{NOW}' FROM fresh"""


# ---- residue and replies ----
def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's reply for each document: JSON in prose, unknown words, junk, or no JSON at all."""
    n = F.col("doc_id")
    found = pick(["ios", "nope", "backend\", \"ai_ml", "flutter"], n)
    good = F.concat(F.lit("Sure:\n```json\n{\"categories\": [\""), found, F.lit("\"], \"level\": \""), pick(["senior", "wizard", "lead"], n), F.lit("\"}\n```"))
    return _table(spark, sf_dir, "documents").select(n.alias("id"), F.when(n % 5 == 0, "I can't tell.").when(n % 5 == 1, "{broken").otherwise(good).alias("reply"))


def reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _replies(spark, sf_dir).withColumn("r", classify.parse_reply(F.col("reply")))
    return r.select("id", F.array_join("r.categories", ",").alias("categories"), F.col("r.level").alias("level"))


def tiered_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings classified by rule, or by the reply where the rules find no category."""
    p = postings(spark, sf_dir).select("id", F.struct("categories", "level").alias("h"))
    met = p.join(_replies(spark, sf_dir).select("id", classify.parse_reply(F.col("reply")).alias("r")), "id").withColumn("t", classify.tiered(F.col("h"), F.col("r")))
    return met.select("id", F.array_join("t.categories", ",").alias("categories"), F.col("t.level").alias("level"))


def residue_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings(spark, sf_dir).select("id", "categories", "level")
    replies = _replies(spark, sf_dir).select("id", classify.parse_reply(F.col("reply")).alias("r")).select("id", "r.categories", "r.level")
    return ingest.upgrade_residue(p, replies).select("id", F.array_join("categories", ",").alias("categories"), "level")


def backfill_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of which a third was never classified."""
    p = postings(spark, sf_dir)
    never = F.col("id") % 3 == 0
    jobs = p.select("id", "title", "description", F.when(~never, F.col("categories")).alias("categories"), F.when(~never, F.lit("kept")).alias("level"))
    return ingest.backfill(jobs).select("id", F.array_join("categories", ",").alias("categories"), "level")


_REPLY = """rp AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 >= 2 THEN [['ios'], [], ['ai_ml', 'backend'], ['flutter']][CAST(doc_id % 4 AS INT) + 1] END AS rc, CASE WHEN doc_id % 5 >= 2 THEN ['senior', 'unspecified', 'lead'][CAST(doc_id % 3 AS INT) + 1] END AS rl FROM documents)"""


# ---- small tables ----
def settings_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    nations = _table(spark, sf_dir, "nation")
    stored = nations.where(n % 2 == 0).select(F.col("n_name").alias("key"), F.lit("old").alias("value"))
    changes = nations.where(n % 3 == 0).select(F.col("n_name").alias("key"), F.when(n % 4 != 0, F.concat(F.lit("new"), n.cast("string"))).alias("value"))
    return state.put_settings(stored, changes)


def usage_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of all events within the budget, added to what two months have used."""
    calls = _table(spark, sf_dir, "events").select("ts", F.col("event_id").alias("call_id"))
    months = state.admit_calls(calls, 500).where("admitted").select("month")
    used = spark.createDataFrame([("2020-01", 3), ("2024-01", 7)], "month string, call_count long")
    return state.add_usage(used, months)


def searches_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved searches with one for each nation more; the old ones ran."""
    old = _searches(spark).withColumn("last_run_at", F.lit(None).cast("timestamp"))
    new = _table(spark, sf_dir, "nation").select(F.concat(F.lit("in "), "n_name").alias("name"), F.lit("{}").alias("filters_json"))
    return state.touch_searches(state.add_searches(old, new), old.select("id"), NOW).select("id", "name", "last_run_at")


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of a search for each customer, and the channel of its messages."""
    n = F.col("c_custkey")
    lists = lambda values, k: F.when(n % k == 0, F.array(*map(F.lit, values))).otherwise(F.array().cast("array<string>"))
    f = F.to_json(F.struct(F.when(n % 5 == 0, F.col("c_mktsegment")).alias("q"), lists(["SE", "US"], 2).alias("countries"), lists(["ios", "ai_ml"], 3).alias("categories"), lists(["senior"], 4).alias("levels"), lists(["unknown", "explicit_yes"], 7).alias("tiers")))
    c = _table(spark, sf_dir, "customer").select(n.alias("id"), f.alias("j"), channel(F.when(n % 2 == 0, "token"), F.when(n % 3 == 0, "").otherwise("chat")).alias("channel"))
    return c.select("id", search_summary(parse_filters(F.col("j"))).alias("summary"), "channel")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings(spark, sf_dir)
    return p.select("id", label(F.col("sponsor_tier"), vocab.TIER_LABELS).alias("tier"), label(F.col("country"), vocab.COUNTRY_LABELS).alias("country"), label(F.col("level"), vocab.LEVEL_LABELS).alias("level"), F.array_join(F.transform("categories", lambda c: label(c, vocab.CATEGORY_LABELS)), "/").alias("categories"))


def posted_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings(spark, sf_dir)
    return p.select("id", posted_ago(F.col("posted_at"), F.lit("2026-03-01 12:00:00").cast("timestamp")).alias("posted"))


# ---- details, registers ----
def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of one posting, asked for by the id of its copy."""
    firms = companies(spark, sf_dir).withColumns({"match_confidence": F.lit(0.9), "match_evidence": F.concat(F.lit("UK "), "name")})
    d = search.job_detail(postings(spark, sf_dir), firms, 22)
    return d.select("id", "title", "company", "registry_flags", "match_confidence", "match_evidence", "description", F.array_join(F.transform("sources", lambda s: F.concat_ws("|", s["id"].cast("string"), s["source_id"], s["url"])), ",").alias("sources"))


def _registered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Firms with and without the manual bit after the registers were read again, and the tiers of their postings."""
    n = F.col("id")
    firms = companies(spark, sf_dir).withColumns({"registry_flags": F.when(n % 4 == 0, 8).when(n % 4 == 1, 9).otherwise(1), "match_confidence": F.lit(0.5), "match_evidence": F.lit("old")})
    found = firms.where(n % 3 == 0).select(F.col("name").alias("seed"), F.lit(3).alias("flags"), F.lit(0.9).alias("confidence"), F.concat(F.lit("UK "), "name").alias("evidence"))
    return registry.refresh(firms, postings(spark, sf_dir), found)


def registry_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registered(spark, sf_dir)[0].select("id", "registry_flags", "match_confidence", "match_evidence")


def registry_refresh_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registered(spark, sf_dir)[1].select("id", "sponsor_tier")


def manual_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    firms = companies(spark, sf_dir).withColumns({"match_confidence": F.lit(0.5), "match_evidence": F.lit("old")})
    name = firms.orderBy("id").first()["name"]
    return registry.flag_manual(firms, name, "told so", "2026-01-01").select("id", "registry_flags", "match_confidence", "match_evidence")


_REFRESHED = f"""WITH {POSTINGS}, {COMPANIES}, f AS (SELECT id, name, CASE WHEN id % 4 = 0 THEN 8 WHEN id % 4 = 1 THEN 9 ELSE 1 END AS flags, id % 3 = 0 AS found FROM companies),
r AS (SELECT id, CASE WHEN NOT found AND flags & 8 <> 0 THEN flags ELSE (CASE WHEN found THEN 3 ELSE 0 END) | (flags & 8) END AS registry_flags, CASE WHEN NOT found AND flags & 8 <> 0 THEN 0.5::DOUBLE WHEN flags & 8 <> 0 THEN 1.0::DOUBLE WHEN found THEN 0.9::DOUBLE END AS match_confidence,
  CASE WHEN NOT found AND flags & 8 <> 0 THEN 'old' WHEN found THEN 'UK ' || name END AS match_evidence FROM f)"""


def nl_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a register that keeps every entity; some have blank names."""
    n = F.col("c_custkey")
    rows = _table(spark, sf_dir, "customer").select(n.alias("pos"), F.when(n % 10 == 3, "  ").otherwise(F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("Organisation"), F.lpad(n.cast("string"), 8, "0").alias("KvK number"))
    return nl_entries(rows).select("registry", "pos", "name", "evidence", F.size("aliases").alias("n_aliases"))


def seed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written as a seed list with a header, and read."""
    n = F.col("s_suppkey")
    path = new_path(spark, "seeds")
    rows = _table(spark, sf_dir, "supplier").select(F.concat("s_name", F.lit(', "quoted"')).alias("name"), pick(ATS, n).alias("ats_type"), F.lit("slug").alias("ats_slug"), F.lit("SE").alias("country_hq"), (n % 4).alias("priority"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return seed_companies(read_csv(spark, path))


# ---- resumes ----
def resume_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploaded resumes of three kinds: text, hash and profile, written as JSON and read back."""
    n = F.col("doc_id")
    d = _table(spark, sf_dir, "documents").select(n.alias("id"), resume_text(F.encode("text", "UTF-8"), pick(["txt", "pdf", "text/plain"], n)).alias("source_text"), F.when(n % 2 == 0, F.array(F.lit("US"), F.lit("SE"))).otherwise(F.array().cast("array<string>")).alias("target_countries"))
    own = fit.build_profiles(d.where("source_text is not null")).withColumn("j", profile_json(F.col("profile")))
    return own.select("id", F.sha2("source_text", 256).alias("resume_hash"), F.col("j").alias("profile_json"), read_profile(F.col("j"))["years"].alias("years"))


def _resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    s = _table(spark, sf_dir, "supplier")
    return s.select(n.cast("long").alias("id"), F.col("s_name").alias("label"), F.concat(F.lit("resume of "), "s_name").alias("source_text"), F.array().cast("array<string>").alias("target_countries"), F.sha2(F.concat(F.lit("resume of "), "s_name"), 256).alias("resume_hash"), (n == 2).alias("active"), F.lit(EPOCH).cast("timestamp").alias("created_at"))


def resume_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' resumes after a new text, and then one that is stored already, which is made active as it was stored."""
    have = _resumes(spark, sf_dir)
    again = have.orderBy("id").first()["source_text"]
    added = fit.add_resume(fit.add_resume(have, "a new text", "new", ["SE"], datetime.fromisoformat(NOW)), again, "another label", ["US"], datetime.fromisoformat(NOW))
    return added.select("id", "label", "resume_hash", "active", F.array_join("target_countries", ",").alias("targets"))


def resume_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resumes without the active one, beside how many went."""
    kept, gone = state.delete_resume(_resumes(spark, sf_dir), 2)
    return kept.select("id", "label", "active").join(gone)  # one row


# ---- evidence ----
def evidence_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one long sentence with an offer in its middle."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), r"\b(?:sponsor|visa|relocation|permit)", "x"))
    half = (F.length("t") / 2).cast("int")
    d = _table(spark, sf_dir, "documents").select("doc_id", plain.alias("t")).select("doc_id", F.trim(F.concat(F.substring(F.col("t"), F.lit(1), half), F.lit(" visa support "), F.substring(F.col("t"), half + 1, F.length("t")))).alias("t"))
    return classify.with_sponsorship(d, "t").select("doc_id", "text_tier", "evidence")


_R = vocab.EVIDENCE_RADIUS
_CLIP = f"""WITH p AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), '\\b(?:sponsor|visa|relocation|permit)', 'x', 'g')) AS t FROM documents),
s AS (SELECT doc_id, trim(substr(t, 1, length(t) // 2) || ' visa support ' || substr(t, length(t) // 2 + 1)) AS t FROM p),
m AS (SELECT *, strpos(t, 'visa support') - 1 AS a FROM s), w AS (SELECT *, greatest(0, a - {_R}) AS low, least(length(t), a + 12 + {_R}) AS high FROM m),
x AS (SELECT *, trim(substr(t, low + 1, high - low)) AS c FROM w),
h AS (SELECT *, CASE WHEN low > 0 THEN '… ' || substr(c, strpos(c, ' ') + 1) ELSE c END AS hd FROM x)
SELECT doc_id, 'explicit_yes' AS text_tier, CASE WHEN length(t) <= {2 * _R} THEN t WHEN high < length(t) THEN regexp_replace(hd, ' [^ ]*$', '') || ' …' ELSE hd END AS evidence FROM h"""

_LABEL = lambda code, table: f"CASE {code} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {code} END"
_RESUME = f"""WITH d AS (SELECT doc_id AS id, text AS t, CASE WHEN doc_id % 2 = 0 THEN ['SE', 'US'] ELSE [] END AS targets FROM documents WHERE doc_id % 3 <> 1 AND text IS NOT NULL),
p AS (SELECT id, t, targets, {_words('t')} AS skills, {sql_categories('t')} AS categories, {sql_level('t', 't')} AS level, {sql_years('t')} AS years FROM d),
l AS (SELECT *, '[' || array_to_string(list_transform(skills, lambda x: '"' || x || '"'), ', ') || ']' AS s, '[' || array_to_string(list_transform(list_sort(categories), lambda x: '"' || x || '"'), ', ') || ']' AS c, '[' || array_to_string(list_transform(targets, lambda x: '"' || x || '"'), ', ') || ']' AS g FROM p)
SELECT id, sha256(t) AS resume_hash, '{{"skills": ' || s || ', "categories": ' || c || ', "level": "' || level || '", "years": ' || coalesce(CAST(years AS VARCHAR), 'null') || ', "target_countries": ' || g || '}}' AS profile_json, years FROM l"""

QUERIES = {
    f.__name__: f
    for f in (seed_upsert, poll_cycle, poll_cycle_jobs, reply_parse, tiered_classes, residue_upgrade, backfill_classes, settings_put, usage_add, searches_run, summaries, labels, posted_since, details, registry_refresh, registry_refresh_tiers, manual_flag, nl_register, seed_csv, resume_ingest, resume_add, resume_delete, evidence_clip)
}

ORACLES = {
    "seed_upsert": _SEEDS,
    "poll_cycle": _POLLED,
    "poll_cycle_jobs": _POLLED_JOBS,
    "reply_parse": f"WITH {_REPLY} SELECT id, array_to_string(rc, ',') AS categories, rl AS level FROM rp",
    "tiered_classes": f"WITH {POSTINGS}, {_REPLY} SELECT id, array_to_string(CASE WHEN len(categories) = 0 AND rc IS NOT NULL THEN rc ELSE categories END, ',') AS categories, CASE WHEN len(categories) = 0 AND rc IS NOT NULL AND rl <> 'unspecified' THEN rl ELSE level END AS level FROM postings JOIN rp USING (id)",
    "residue_upgrade": f"WITH {POSTINGS}, {_REPLY} SELECT id, array_to_string(CASE WHEN len(categories) = 0 AND len(rc) > 0 THEN rc ELSE categories END, ',') AS categories, CASE WHEN len(categories) = 0 AND len(rc) > 0 THEN rl ELSE level END AS level FROM postings JOIN rp USING (id)",
    "backfill_classes": f"WITH {POSTINGS} SELECT id, array_to_string(categories, ',') AS categories, CASE WHEN id % 3 = 0 THEN level ELSE 'kept' END AS level FROM postings",
    "settings_put": "SELECT n_name AS key, CASE WHEN n_nationkey % 3 <> 0 THEN 'old' ELSE 'new' || n_nationkey END AS value FROM nation WHERE (n_nationkey % 3 = 0 AND n_nationkey % 4 <> 0) OR (n_nationkey % 3 <> 0 AND n_nationkey % 2 = 0)",
    "usage_add": "WITH m AS (SELECT strftime(timezone('Asia/Jakarta', timezone('UTC', ts)), '%Y-%m') AS month FROM events), c AS (SELECT month, least(count(*), 500) AS n FROM m GROUP BY 1), u(month, n) AS (VALUES ('2020-01', 3), ('2024-01', 7)) SELECT month, CAST(sum(n) AS BIGINT) AS call_count FROM (SELECT * FROM c UNION ALL SELECT * FROM u) GROUP BY 1",
    "searches_run": f"SELECT CAST(n AS BIGINT) AS id, name, TIMESTAMP '{NOW}' AS last_run_at FROM (VALUES (1, 'nordic mobile'), (2, 'sponsors'), (3, 'rust'), (4, 'everything'), (5, 'nothing'), (6, 'wildcards')) v(n, name) UNION ALL SELECT 6 + row_number() OVER (ORDER BY n_name), 'in ' || n_name, NULL FROM nation",
    "summaries": """WITH c AS (SELECT c_custkey AS n, c_mktsegment AS q FROM customer), p AS (SELECT n, list_filter([CASE WHEN n % 3 = 0 THEN 'iOS/ai_ml' END, CASE WHEN n % 2 = 0 THEN 'SE+US' END, CASE WHEN n % 4 = 0 THEN 'senior' END, CASE WHEN n % 7 = 0 THEN 'tier: unknown,explicit_yes' END, CASE WHEN n % 5 = 0 THEN '"' || q || '"' END], lambda x: x IS NOT NULL) AS parts FROM c)
SELECT n AS id, CASE WHEN len(parts) > 0 THEN array_to_string(parts, ' · ') ELSE 'all jobs' END AS summary, CASE WHEN n % 2 = 0 AND n % 3 <> 0 THEN 'telegram' ELSE 'stdout' END AS channel FROM p""",
    "labels": f"WITH {POSTINGS} SELECT id, {_LABEL('sponsor_tier', vocab.TIER_LABELS)} AS tier, {_LABEL('country', vocab.COUNTRY_LABELS)} AS country, {_LABEL('level', vocab.LEVEL_LABELS)} AS level, array_to_string(list_transform(categories, lambda c: {_LABEL('c', vocab.CATEGORY_LABELS)}), '/') AS categories FROM postings",
    "posted_since": f"WITH {POSTINGS}, d AS (SELECT id, CAST(floor((epoch(TIMESTAMP '2026-03-01 12:00:00') - epoch(posted_at)) / 86400) AS BIGINT) AS n FROM postings) SELECT id, CASE WHEN n IS NULL THEN '—' WHEN n <= 0 THEN 'today' ELSE n || 'd ago' END AS posted FROM d",
    "details": f"WITH {POSTINGS}, {COMPANIES}, k AS (SELECT coalesce(canonical_id, id) AS c FROM postings WHERE id = 22), g AS (SELECT string_agg(concat_ws('|', id, source_id, url), ',' ORDER BY id) AS sources FROM postings, k WHERE coalesce(canonical_id, id) = c) SELECT p.id, title, c.name AS company, registry_flags, 0.9::DOUBLE AS match_confidence, 'UK ' || c.name AS match_evidence, description, sources FROM postings p JOIN companies c ON p.company_id = c.id, g WHERE p.id = (SELECT c FROM k) AND canonical_id IS NULL",
    "registry_refresh": f"{_REFRESHED} SELECT * FROM r",
    "registry_refresh_tiers": f"{_REFRESHED} SELECT p.id, CASE WHEN r.id IS NULL OR sponsor_tier IN ('explicit_yes', 'explicit_no') THEN sponsor_tier WHEN registry_flags <> 0 THEN 'registry_inferred' ELSE 'unknown' END AS sponsor_tier FROM postings p LEFT JOIN r ON p.company_id = r.id",
    "manual_flag": f"WITH {COMPANIES} SELECT id, registry_flags | CASE WHEN id = (SELECT min(id) FROM companies) THEN 8 ELSE 0 END AS registry_flags, CASE WHEN id = (SELECT min(id) FROM companies) THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS match_confidence, CASE WHEN id = (SELECT min(id) FROM companies) THEN 'MANUAL: told so (flagged 2026-01-01)' ELSE 'old' END AS match_evidence FROM companies",
    "nl_register": "SELECT 'NL' AS registry, CAST(c_custkey AS BIGINT) AS pos, c_name AS name, 'KvK ' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS evidence, 0 AS n_aliases FROM customer WHERE c_custkey % 10 <> 3",
    "seed_csv": f"SELECT s_name || ', \"quoted\"' AS name, {sql_pick(ATS, 's_suppkey')} AS ats_type, 'slug' AS ats_slug, 'SE' AS country_hq, CAST(s_suppkey % 4 AS INT) AS priority FROM supplier",
    "resume_ingest": _RESUME,
    "resume_add": "WITH r AS (SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS label, sha256('resume of ' || s_name) AS resume_hash, '' AS targets FROM supplier UNION ALL SELECT max(s_suppkey) + 1, 'new', sha256('a new text'), 'SE' FROM supplier) SELECT id, label, resume_hash, id = (SELECT min(s_suppkey) FROM supplier) AS active, targets FROM r",
    "resume_delete": "SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS label, FALSE AS active, CAST(1 AS BIGINT) AS deleted FROM supplier WHERE s_suppkey <> 2",
    "evidence_clip": _CLIP,
}
