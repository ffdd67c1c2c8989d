"""Schemas of the engine's tables, as DDL, and the constant country reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOBS = (
    "id long, company_id long, source_id string, external_id string, title string, description string, url string, location_raw string, "
    "country string, city string, categories array<string>, level string, sponsor_tier string, sponsor_evidence string, content_hash string, "
    "posted_at timestamp, first_seen_at timestamp, last_seen_at timestamp, closed_at timestamp, user_status string, consecutive_misses int, canonical_id long"
)
COMPANIES = (
    "id long, name string, ats_type string, ats_slug string, country_hq string, registry_flags int, match_confidence double, match_evidence string, "
    "priority int, active boolean, consecutive_failures int, last_success_at timestamp, health string, quarantine_reason string"
)
REGISTRIES_META = "registry string, fetched_at timestamp, row_count long"
SAVED_SEARCHES = "id long, name string, filters_json string, notify_channel string, last_run_at timestamp"
SEEN_MATCHES = "search_id long, job_canonical_id long, notified_at timestamp, match_reason string"
APP_SETTINGS = "key string, value string"
LLM_USAGE = "month string, call_count int"
COUNTRIES = "code string, name string, visa_summary string, pr_summary string, citizenship_summary string, registry_name string, priority_tier string, verified_at date, source_url string"
RESUMES = "id long, label string, source_text string, target_countries array<string>, resume_hash string, active boolean, created_at timestamp"
MATCH_SCORES = "resume_hash string, job_canonical_id long, overall int, skills_score int, level_score int, sponsor_score int, matched_skills array<string>, missing_skills array<string>, content_hash string, computed_at timestamp"

# ---- fixed values: the country reference ----
VERIFIED_AT = "2026-01-15"
COUNTRY_REFERENCE = [
    ("SG", "Singapore", "Employment Pass, ~S$5.6k/mo + COMPASS points", "Discretionary; 5–10yr common, non-guaranteed", "~2yr after PR; renounce required", "None public — company-level heuristics only", "primary", "https://www.mom.gov.sg"),
    ("JP", "Japan", "HSP points visa", "70pts→3yr, 80pts→1yr — fastest PR anywhere", "5yr; renounce; language", "None public", "primary", "https://www.isa.go.jp"),
    ("AU", "Australia", "Skills in Demand (~AU$76k floor; AU$141k specialist tier)", "2–3yr via employer 186 or points 189", "4yr residence", "None public (sponsor status inferable from posting text)", "primary", "https://immi.homeaffairs.gov.au"),
    ("NL", "Netherlands", "HSM kennismigrant, ~€5.3k/mo (30+)", "5yr (+ EU long-term residence)", "5yr; renounce (generally) + integration exams", "IND recognised sponsors list (public)", "primary", "https://ind.nl"),
    ("US", "United States (SF Bay)", "H-1B lottery (~25–35%) / L-1 transfer / O-1", "GC ~1.5–3yr via PERM; no Indonesia-born backlog", "5yr after green card", "H-1B LCA disclosure data (public, per-company)", "primary", "https://www.uscis.gov"),
    ("CA", "Canada", "Global Talent Stream (2-wk) or Express Entry PR direct", "PR can be the entry itself", "3yr — fastest passport", "None needed (open work-permit ecosystem)", "primary", "https://www.canada.ca/en/services/immigration-citizenship.html"),
    ("IE", "Ireland", "Critical Skills Employment Permit (~€38–44k floor)", "Stamp 4 after 2yr", "5yr; dual allowed → EU passport", "None public; big-tech presence is proxy", "primary", "https://www.irishimmigration.ie"),
    ("SE", "Sweden", "Work permit, ~80% median salary (raise proposed)", "4yr", "5yr → reform to 8yr + tests was in progress — likely law by 2026", "None — employer certification scheme discontinued Dec 2023", "nice_to_have", "https://www.migrationsverket.se"),
    ("NO", "Norway", "Skilled worker permit", "3yr", "6–8yr", "None public", "nice_to_have", "https://www.udi.no"),
    ("DK", "Denmark", "Pay Limit Scheme ~DKK 514k/yr", "8yr (4 strict)", "9yr", "Positive List employers (partial proxy)", "nice_to_have", "https://www.nyidanmark.dk"),
    ("CH", "Switzerland", "Non-EU quota; employer must justify", "10yr non-EU", "10yr + cantonal", "None useful", "nice_to_have", "https://www.sem.admin.ch"),
]


def country_reference(spark: SparkSession) -> DataFrame:
    """The 11-row reference, small enough to broadcast."""
    rows = spark.createDataFrame(COUNTRY_REFERENCE, "code string, name string, visa_summary string, pr_summary string, citizenship_summary string, registry_name string, priority_tier string, source_url string")
    return rows.withColumn("verified_at", F.lit(VERIFIED_AT).cast("date")).select(*(x.split()[0] for x in COUNTRIES.split(", ")))


def listed_countries(spark: SparkSession) -> DataFrame:
    """Primary countries first, then by name."""
    return country_reference(spark).orderBy(F.when(F.col("priority_tier") == "primary", 0).otherwise(1), "name")
