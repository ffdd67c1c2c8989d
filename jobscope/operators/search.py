"""The job list: filters, orders, pages and totals."""

from __future__ import annotations

import operator
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.functions.classify import tier_rank


@dataclass(frozen=True)
class JobFilters:
    """What a reader asks for; an empty field doesn't restrict."""

    q: str | None = None
    countries: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    levels: tuple[str, ...] = ()
    posted_since: datetime | None = None
    tiers: tuple[str, ...] = ()
    status: str | None = None
    sort: str = "tier"
    limit: int = 50
    offset: int = 0
    resume_hash: str | None = field(default=None)

    def __post_init__(self) -> None:
        if not 1 <= self.limit <= 200 or self.offset < 0 or self.sort not in ("tier", "date", "match"):
            raise ValueError(f"no such page or order: {self}")


def like_ascii(text: Column, q: str) -> Column:
    """``%q%`` where ``%`` and ``_`` in q are wildcards, the backslash is none, and only A-Z are folded."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    folded = q.translate(str.maketrans(letters, letters.lower())).replace("\\", "\\\\")
    return F.translate(text, letters, letters.lower()).like(f"%{folded}%")


def predicate(f: JobFilters) -> Column:
    """The conjunction of what is asked for; duplicates of a posting are never listed."""
    parts = [F.col("canonical_id").isNull()]
    if f.q:
        parts.append(like_ascii(F.col("title"), f.q) | like_ascii(F.col("description"), f.q))
    if f.countries:
        parts.append(F.col("country").isin([c.upper() for c in f.countries]))
    if f.categories:
        parts.append(F.arrays_overlap("categories", F.array(*map(F.lit, f.categories))))
    if f.levels:
        parts.append(F.col("level").isin(list(f.levels)))
    if f.posted_since is not None:
        parts.append(F.col("posted_at") >= F.lit(f.posted_since))
    if f.tiers:
        parts.append(F.col("sponsor_tier").isin(list(f.tiers)))
    if f.status is None:
        parts.append(F.col("user_status") != "hidden")
    elif f.status != "all":
        parts.append(F.col("user_status") == f.status)
    return reduce(operator.and_, parts)


def order(f: JobFilters, scored: bool) -> list[Column]:
    """Sort keys; a match order without scores is the tier order, and the id breaks ties."""
    date = [F.col("posted_at").desc_nulls_last(), F.col("id").asc()]
    tier = [tier_rank(F.col("sponsor_tier")).desc(), *date]
    if f.sort == "date":
        return date
    return [F.col("overall").desc_nulls_last(), *tier] if f.sort == "match" and scored else tier


LISTED = ["id", "title", "company", "country", "city", "categories", "level", "sponsor_tier", "user_status", "posted_at", "url"]


def search_jobs(jobs: DataFrame, companies: DataFrame, f: JobFilters, scores: DataFrame | None = None) -> DataFrame:
    """One page of the list; descriptions are filtered on, not carried, and the page is a top-k."""
    found = jobs.where(predicate(f)).select("id", "company_id", "title", "country", "city", "categories", "level", "sponsor_tier", "user_status", "posted_at", "url")
    named = found.join(companies.select(F.col("id").alias("_c"), F.col("name").alias("company")), F.col("company_id") == F.col("_c"))
    scored = scores is not None and f.resume_hash is not None
    if scored:
        own = scores.where(F.col("resume_hash") == f.resume_hash).select(F.col("job_canonical_id").alias("_j"), "overall")
        named = named.join(own, F.col("id") == F.col("_j"), "left")
    return named.orderBy(*order(f, scored)).offset(f.offset).limit(f.limit).select(*LISTED, *(["overall"] if scored else []))


def count_jobs(jobs: DataFrame, f: JobFilters) -> DataFrame:
    """``total`` under the same filters, before the page; no join is needed for it."""
    return jobs.where(predicate(f)).agg(F.count(F.lit(1)).alias("total"))


def job_sources(jobs: DataFrame) -> DataFrame:
    """For each canonical posting, all its sources in order of id: an equality on the canonical id, not an OR of two."""
    of = F.coalesce("canonical_id", "id").alias("canonical")
    return jobs.select(of, F.struct("id", "source_id", "url").alias("source")).groupBy("canonical").agg(F.sort_array(F.collect_list("source")).alias("sources"))


def job_detail(jobs: DataFrame, companies: DataFrame, job_id: int) -> DataFrame:
    """The canonical posting of an id, with its company and sources."""
    canonical = jobs.where(F.col("id") == job_id).select(F.coalesce("canonical_id", "id").alias("canonical"))
    group = jobs.join(canonical, F.coalesce("canonical_id", "id") == F.col("canonical"), "left_semi")
    return group.where("canonical_id is null").join(companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"), "registry_flags", "match_confidence", "match_evidence"), "company_id").join(job_sources(group), F.col("id") == F.col("canonical")).drop("canonical")


def set_status(jobs: DataFrame, job_id: int, status: str) -> DataFrame:
    """A new snapshot where the canonical posting of an id has a status."""
    if status not in ("new", "seen", "hidden", "starred"):
        raise ValueError(status)
    canonical = jobs.where(F.col("id") == job_id).select(F.coalesce("canonical_id", "id").alias("_c"))
    return jobs.join(F.broadcast(canonical.limit(1)), F.col("id") == F.col("_c"), "left").withColumn("user_status", F.when(F.col("_c").isNotNull(), status).otherwise(F.col("user_status"))).drop("_c")
