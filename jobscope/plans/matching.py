"""Queries of matching: resume fit, rationales, saved searches, digests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope import vocab
from jobscope.operators import fit, notify
from jobscope.operators.search import JobFilters
from jobscope.plans.postings import COMPANIES, EPOCH, POSTINGS, companies, pick, postings, sql_pick, sql_rank, stored_postings, wide_postings

RESUMES = {
    "r1": ("Senior iOS engineer, 7 years of Swift, SwiftUI and Kotlin.", ["SE", "SG"]),
    "r2": ("Backend developer: Kubernetes, Rust, PostgreSQL, 2 years.", []),
    "r3": ("Plain prose without a trade.", ["US"]),
}
#: Postings whose id is divisible by this have a cached score.
CACHED = {"r1": 2, "r2": 5}
SEARCHES = [
    (1, "nordic mobile", {"countries": ["SE"], "categories": ["ios", "android", "flutter"]}),
    (2, "sponsors", {"tiers": ["explicit_yes", "registry_inferred"], "levels": ["senior"]}),
    (3, "rust", {"q": "RUST"}),
    (4, "everything", {}),
    (5, "nothing", {"countries": ["XX"]}),
    (6, "wildcards", {"q": "K_bern%RUST"}),
]
#: What two engines agree on about a search's hits, as SQL over ``postings`` p.
_WHERE = {
    1: "country IN ('SE') AND list_has_any(categories, ['ios', 'android', 'flutter'])",
    2: "sponsor_tier IN ('explicit_yes', 'registry_inferred') AND level IN ('senior')",
    3: "(contains(lower(title), 'rust') OR contains(lower(description), 'rust'))",
    4: "TRUE",
    5: "country IN ('XX')",
    6: "(title ILIKE '%K_bern%RUST%' OR description ILIKE '%K_bern%RUST%')",
}
_REASON = {
    1: "array_to_string(list_filter(['ios', 'android', 'flutter'], lambda c: list_contains(categories, c)) || ['SE'], ' · ')",
    2: "level || ' · ' || sponsor_tier",
    3: "'all'",
    4: "'all'",
    5: "'XX'",
    6: "'all'",
}


def _profiles(spark: SparkSession) -> DataFrame:
    rows = [(k, t, c) for k, (t, c) in RESUMES.items()]
    return fit.build_profiles(spark.createDataFrame(rows, "resume_hash string, source_text string, target_countries array<string>"))


def _searches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, name, json.dumps(f)) for n, name, f in SEARCHES], "id long, name string, filters_json string")


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached scores of some postings for each resume, some of a text that has changed since."""
    stale = F.when(F.col("id") % 6 == 0, F.lit("old")).otherwise(F.col("content_hash"))
    cached = F.filter(F.array(*(F.when(F.col("id") % n == 0, F.lit(k)) for k, n in CACHED.items())), lambda r: r.isNotNull())
    return postings(spark, sf_dir).select(F.explode(cached).alias("resume_hash"), F.col("id").alias("job_canonical_id"), (F.col("id") % 101).cast("int").alias("overall"), stale.alias("content_hash"))


def resume_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _profiles(spark)
    return p.select("resume_hash", F.array_join("profile.skills", ",").alias("skills"), F.array_join("profile.categories", ",").alias("categories"), F.col("profile.level").alias("level"), F.col("profile.years").alias("years"))


def fit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fit.score_jobs(wide_postings(spark, sf_dir), _profiles(spark))
    return s.select("resume_hash", "id", "score.overall", "score.skills_score", "score.level_score", "score.sponsor_score", F.array_join("score.matched_skills", ",").alias("matched"), F.array_join("score.missing_skills", ",").alias("missing"))


def fit_rank_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = JobFilters(sort="match", resume_hash="r1", limit=30)
    return fit.ranked_page(wide_postings(spark, sf_dir), _profiles(spark).where("resume_hash = 'r1'"), _cache(spark, sf_dir), f).select("id", "cached", "fresh")


def fit_cache_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = fit.refresh_scores(_cache(spark, sf_dir), stored_postings(spark, sf_dir), _profiles(spark))
    return fresh.select("resume_hash", "job_canonical_id", "overall", "content_hash")


def rationale_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fit.deep_match(wide_postings(spark, sf_dir), _profiles(spark))
    return d.select("resume_hash", "id", "rationale.summary", F.array_join("rationale.strengths", "\n").alias("strengths"), F.array_join("rationale.gaps", "\n").alias("gaps"), "rationale.verdict", "rationale.sponsor_note")


def saved_search_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notify.matches(_searches(spark), stored_postings(spark, sf_dir), limit=40).select("search_id", "job_canonical_id", "reason", F.col("rank").cast("long").alias("rank"))


def _customer_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for each customer: by word, wildcards, country, field, level or tier, several of these, or none."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    n = F.col("c_custkey")
    lists = lambda values, k, r: F.when(n % k == r, F.array(*map(F.lit, values))).otherwise(F.array().cast("array<string>"))
    word = F.when(n % 4 == 0, pick(["Kubernetes", "RUST", "sponsor", "K_bern%rust", "sp%visas", "te", "nowhere at all"], n)).otherwise("")
    f = F.struct(word.alias("q"), F.when(n % 3 == 0, F.array(pick(["SE", "DE", "US", "SG", "XX"], n), F.lit("NL"))).otherwise(F.array().cast("array<string>")).alias("countries"), lists(["ios", "android", "backend"], 5, 1).alias("categories"), lists(["senior", "lead"], 7, 2).alias("levels"), lists(["explicit_yes"], 6, 3).alias("tiers"))
    return c.select(n.cast("long").alias("id"), F.col("c_name").alias("name"), F.to_json(f).alias("filters_json"))


def customer_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every customer's search: how many, and a sum of ids."""
    return notify.search_totals(_customer_searches(spark, sf_dir), stored_postings(spark, sf_dir))


def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run of all searches reports: how many ran, and their new matches in all."""
    ledger = postings(spark, sf_dir).where("id % 3 = 0").select(F.lit(4).cast("long").alias("search_id"), F.col("id").alias("job_canonical_id"))
    return notify.run_searches(_searches(spark), stored_postings(spark, sf_dir), ledger, EPOCH)[1]


def notify_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = notify.matches(_searches(spark), stored_postings(spark, sf_dir))
    ledger = postings(spark, sf_dir).where("id % 3 = 0").select(F.lit(4).cast("long").alias("search_id"), F.col("id").alias("job_canonical_id"))
    return notify.unseen(found, ledger).groupBy("search_id").agg(F.count(F.lit(1)).alias("n"), F.sum("job_canonical_id").alias("ids"))


def search_new_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notify.new_counts(_searches(spark), stored_postings(spark, sf_dir))


def digest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = notify.matches(_searches(spark), stored_postings(spark, sf_dir), limit=10)
    return notify.digest_units(found, companies(spark, sf_dir)).select("search_id", F.col("rank").cast("long").alias("rank"), "unit")


def digest_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = notify.matches(_searches(spark), stored_postings(spark, sf_dir), limit=60)
    packed = notify.digest_messages(notify.digest_units(found, companies(spark, sf_dir)), 4096)
    return packed.select("search_id", F.posexplode("messages").alias("n", "message")).select("search_id", F.col("n").cast("long").alias("n"), F.length("message").cast("long").alias("chars"), "message")


# ---- SQL ----
def _words(text: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(lower({text}), '{vocab.alternation(vocab.ALL_SKILLS)}')))"


def _case(value: str, table: dict, other: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {other} END"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _profile_rows() -> str:
    from jobscope.plans.postings import sql_categories, sql_level, sql_years

    rows = ", ".join(f"({_quoted(k)}, {_quoted(t)}, {c}::VARCHAR[])" for k, (t, c) in RESUMES.items())
    return f"rs(resume_hash, t, targets) AS (VALUES {rows}), prof AS (SELECT resume_hash, targets, {_words('t')} AS skills, {sql_categories('t')} AS categories, {sql_level('t', 't')} AS level, {sql_years('t')} AS years FROM rs)"


_SENIOR = {k: v for k, v in vocab.SENIORITY.items()}
_GAP = f"({_case('j.level', _SENIOR, 'NULL')} - {_case('p.level', _SENIOR, 'NULL')})"
_OFF = "(len(p.targets) > 0 AND NOT coalesce(list_contains(p.targets, j.country), FALSE))"
_SCORES = f"""{POSTINGS}, {_profile_rows()}, jf AS (SELECT *, {_words('description')} AS skills FROM postings),
sc AS (SELECT p.resume_hash, j.id, j.content_hash, j.country, j.sponsor_tier, j.level AS jl, p.level AS pl, p.targets, j.categories AS jc, p.categories AS pc, j.skills AS js,
  list_sort(list_filter(j.skills, lambda s: list_contains(p.skills, s))) AS matched, list_sort(list_filter(j.skills, lambda s: NOT list_contains(p.skills, s))) AS missing, {_GAP} AS gap,
  CASE WHEN len(j.skills) > 0 THEN len(list_filter(j.skills, lambda s: list_contains(p.skills, s))) / len(j.skills) ELSE 0.0::DOUBLE END AS skill,
  CASE WHEN len(j.categories) = 0 THEN 0.5::DOUBLE WHEN list_has_any(p.categories, j.categories) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS category,
  coalesce(greatest(0.0::DOUBLE, 1.0::DOUBLE - CASE WHEN {_GAP} > 0 THEN 0.12::DOUBLE ELSE 0.30::DOUBLE END * abs({_GAP})), 0.70::DOUBLE) AS lf,
  ({_case('j.sponsor_tier', {k: f'{v}::DOUBLE' for k, v in vocab.TIER_FIT.items()}, '0.0::DOUBLE')}) * CASE WHEN {_OFF} THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS sf
  FROM jf j CROSS JOIN prof p),
scored AS (SELECT *, CAST(round_even(100 * (0.40::DOUBLE * skill + 0.25::DOUBLE * category + 0.20::DOUBLE * lf + 0.15::DOUBLE * sf), 0) AS INT) AS overall FROM sc)"""
_CACHE = "cache AS (" + " UNION ALL ".join(f"SELECT '{k}' AS resume_hash, id AS job_canonical_id, CAST(id % 101 AS INT) AS overall, CASE WHEN id % 6 = 0 THEN 'old' ELSE content_hash END AS content_hash FROM postings WHERE id % {n} = 0" for k, n in CACHED.items()) + ")"
_HITS = "hits AS (" + " UNION ALL ".join(f"SELECT {n} AS search_id, *, {_REASON[n]} AS reason FROM postings WHERE canonical_id IS NULL AND {_WHERE[n]}" for n, _, _ in SEARCHES) + ")"
_RANKED = f"ranked AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY {sql_rank('sponsor_tier')} DESC, posted_at DESC NULLS LAST, id) AS rank FROM hits WHERE user_status <> 'hidden')"
_SHARED = "list_sort(list_filter(jc, lambda c: list_contains(pc, c)))"
_ON = "coalesce(list_contains(targets, country), FALSE)"
_NOTE = _case("sponsor_tier", {k: _quoted(v) for k, v in vocab.SPONSOR_NOTES.items()}, "NULL")
_VERDICT = "CASE " + " ".join(f"WHEN overall >= {n} THEN {_quoted(w)}" for n, w in vocab.VERDICTS) + " END"


def _lines(*cases: str) -> str:
    return f"array_to_string(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL), chr(10))"


_RATIONALE = f"""WITH {_SCORES} SELECT resume_hash, id,
  CASE WHEN len(js) > 0 THEN 'Your resume covers ' || len(matched) || ' of the ' || len(js) || ' skills this posting names' ELSE 'This posting names no skills from the shared vocabulary' END ||
  CASE WHEN len(jc) = 0 THEN '.' WHEN list_has_any(pc, jc) THEN ', and the role sits squarely in your field.' ELSE ', but the role sits outside your usual field.' END AS summary,
  {_lines("CASE WHEN len(matched) > 0 THEN 'Matched skills: ' || array_to_string(matched[:8], ', ') || '.' END", f"CASE WHEN len({_SHARED}) > 0 THEN 'The role''s field (' || array_to_string({_SHARED}, ', ') || ') matches your background.' END", "CASE WHEN gap = 0 THEN 'Seniority is an exact match (' || jl || ').' WHEN gap = 1 THEN 'One step up from ' || pl || ' — a reachable stretch.' END", "CASE sponsor_tier WHEN 'explicit_yes' THEN 'The posting explicitly offers visa sponsorship.' WHEN 'registry_inferred' THEN 'The company appears on a sponsor registry.' END", f"CASE WHEN len(targets) > 0 AND {_ON} THEN country || ' is in your relocation strategy.' END")} AS strengths,
  {_lines("CASE WHEN len(missing) > 0 THEN 'The posting asks for skills your resume doesn''t show: ' || array_to_string(missing[:8], ', ') || '.' END", "CASE WHEN len(jc) > 0 AND NOT list_has_any(pc, jc) THEN 'The role''s field (' || array_to_string(list_sort(jc), ', ') || ') is outside your profile.' END", "CASE WHEN gap < 0 THEN 'The role reads ' || -gap || ' level(s) below your profile (' || jl || ' vs your ' || pl || ').' WHEN gap >= 2 THEN 'The role is ' || gap || ' seniority steps above your profile.' END", "CASE sponsor_tier WHEN 'explicit_no' THEN 'The posting rules out visa sponsorship.' WHEN 'unknown' THEN 'No sponsorship signal in the posting.' END", f"CASE WHEN len(targets) > 0 AND NOT {_ON} THEN coalesce(country, 'This location') || ' is outside your target countries.' END")} AS gaps,
  {_VERDICT} AS verdict, {_NOTE} || CASE WHEN len(targets) = 0 THEN '' WHEN {_ON} THEN ' ' || country || ' is in your relocation strategy.' ELSE ' Note: ' || coalesce(country, 'this location') || ' is outside your target countries.' END AS sponsor_note FROM scored"""

QUERIES = {
    f.__name__: f
    for f in (resume_profiles, fit_scores, fit_rank_page, fit_cache_refresh, rationale_lines, saved_search_matches, customer_searches, run_totals, notify_once, search_new_counts, digest_lines, digest_pack)
}

_NAMES = "CASE search_id " + " ".join(f"WHEN {n} THEN {_quoted(name)}" for n, name, _ in SEARCHES) + " END"
_UNITS = f"WITH RECURSIVE {POSTINGS}, {COMPANIES}, {_HITS}, {_RANKED}, t AS (SELECT r.*, c.name AS company FROM ranked r JOIN companies c ON r.company_id = c.id WHERE rank <= @most), l AS (SELECT *, '• ' || title || ' — ' || company || ' · ' || coalesce(country, '—') || ' · ' || sponsor_tier || chr(10) || '  why: ' || reason || chr(10) || '  ' || url AS line, row_number() OVER (PARTITION BY search_id ORDER BY rank) AS k, count(*) OVER (PARTITION BY search_id) AS n FROM t)"
_UNIT = f"CASE WHEN k = 1 THEN '🔔 ' || {_NAMES} || ' (' || n || ' new)' || chr(10) || line ELSE line END"
ORACLES = {
    "resume_profiles": f"WITH {_profile_rows()} SELECT resume_hash, array_to_string(skills, ',') AS skills, array_to_string(categories, ',') AS categories, level, years FROM prof",
    "fit_scores": f"WITH {_SCORES} SELECT resume_hash, id, overall, CAST(round_even(100 * skill, 0) AS INT) AS skills_score, CAST(round_even(100 * lf, 0) AS INT) AS level_score, CAST(round_even(100 * sf, 0) AS INT) AS sponsor_score, array_to_string(matched, ',') AS matched, array_to_string(missing, ',') AS missing FROM scored",
    "fit_rank_page": f"WITH {_SCORES}, {_CACHE}, page AS (SELECT p.id, c.overall AS cached FROM postings p LEFT JOIN cache c ON p.id = c.job_canonical_id AND c.resume_hash = 'r1' WHERE canonical_id IS NULL AND user_status <> 'hidden' ORDER BY c.overall DESC NULLS LAST, {sql_rank('sponsor_tier')} DESC, posted_at DESC NULLS LAST, p.id LIMIT 30) SELECT page.id, cached, overall AS fresh FROM page JOIN scored s ON s.id = page.id AND s.resume_hash = 'r1'",
    "fit_cache_refresh": f"WITH {_SCORES}, {_CACHE} SELECT s.resume_hash, s.id AS job_canonical_id, CASE WHEN c.content_hash = s.content_hash THEN c.overall ELSE s.overall END AS overall, s.content_hash FROM scored s LEFT JOIN cache c ON c.job_canonical_id = s.id AND c.resume_hash = s.resume_hash",
    "rationale_lines": _RATIONALE,
    "saved_search_matches": f"WITH {POSTINGS}, {_HITS}, {_RANKED} SELECT CAST(search_id AS BIGINT) AS search_id, id AS job_canonical_id, reason, rank FROM ranked WHERE rank <= 40",
    "customer_searches": f"""WITH {POSTINGS}, s AS (SELECT c_custkey AS n, CASE WHEN c_custkey % 4 = 0 THEN {sql_pick(["Kubernetes", "RUST", "sponsor", "K_bern%rust", "sp%visas", "te", "nowhere at all"], "c_custkey")} END AS q, {sql_pick(["SE", "DE", "US", "SG", "XX"], "c_custkey")} AS code FROM customer),
l AS (SELECT id, country, categories, level, sponsor_tier, lower(title) AS t, lower(description) AS d FROM postings WHERE canonical_id IS NULL)
SELECT CAST(n AS BIGINT) AS search_id, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM s JOIN l ON (n % 3 <> 0 OR country IN (code, 'NL')) AND (n % 5 <> 1 OR list_has_any(categories, ['ios', 'android', 'backend'])) AND (n % 7 <> 2 OR level IN ('senior', 'lead')) AND (n % 6 <> 3 OR sponsor_tier = 'explicit_yes')
  AND (q IS NULL OR t LIKE '%' || lower(q) || '%' OR d LIKE '%' || lower(q) || '%') GROUP BY n""",
    "run_totals": f"WITH {POSTINGS}, {_HITS}, {_RANKED} SELECT CAST({len(SEARCHES)} AS BIGINT) AS searches_run, count(*) AS new_matches FROM ranked WHERE rank <= {vocab.MATCH_LIMIT} AND NOT (search_id = 4 AND id % 3 = 0)",
    "notify_once": f"WITH {POSTINGS}, {_HITS}, {_RANKED} SELECT CAST(search_id AS BIGINT) AS search_id, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM ranked WHERE rank <= {vocab.MATCH_LIMIT} AND NOT (search_id = 4 AND id % 3 = 0) GROUP BY 1",
    "search_new_counts": f"WITH {POSTINGS}, {_HITS}, n AS (SELECT search_id, count(*) AS n FROM hits WHERE user_status = 'new' GROUP BY 1), s(search_id) AS (VALUES " + ", ".join(f"({n})" for n, _, _ in SEARCHES) + f") SELECT CAST(s.search_id AS BIGINT) AS id, {_NAMES.replace('search_id', 's.search_id')} AS name, coalesce(n, 0) AS new_matches FROM s LEFT JOIN n ON s.search_id = n.search_id",
    "digest_lines": f"{_UNITS.replace('@most', '10')} SELECT CAST(search_id AS BIGINT) AS search_id, rank, {_UNIT} AS unit FROM l",
    "digest_pack": f"""{_UNITS.replace('@most', '60')}, u AS (SELECT search_id, row_number() OVER (PARTITION BY search_id ORDER BY rank) AS k, {_UNIT} AS unit FROM l),
m AS (SELECT search_id, k, unit AS open, 0 AS n FROM u WHERE k = 1
  UNION ALL SELECT u.search_id, u.k, CASE WHEN length(open) + 2 + length(unit) > 4096 THEN unit ELSE open || chr(10) || chr(10) || unit END, CASE WHEN length(open) + 2 + length(unit) > 4096 THEN n + 1 ELSE n END FROM m JOIN u ON u.search_id = m.search_id AND u.k = m.k + 1)
SELECT CAST(search_id AS BIGINT) AS search_id, CAST(n AS BIGINT) AS n, CAST(length(open) AS BIGINT) AS chars, open AS message FROM m QUALIFY row_number() OVER (PARTITION BY search_id, n ORDER BY k DESC) = 1""",
}
