"""From polls to postings: read, classify what changed, merge, sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobscope import buckets, vocab
from jobscope.functions.classify import classify, resolve_tier, with_sponsorship
from jobscope.operators.health import after_poll, poll_outcome
from jobscope.operators.state import changed_only, get_or_create_companies, poll_into, sweep, upsert_jobs
from jobscope.store import written


def classify_postings(postings: DataFrame) -> DataFrame:
    """``categories``, ``level``, ``sponsor_tier`` and ``sponsor_evidence`` of postings that carry ``registry_flags``."""
    read = with_sponsorship(postings, "description", "_tier", "sponsor_evidence").withColumn("_class", classify(F.col("title"), F.col("description")))
    return read.withColumns({"categories": F.col("_class.categories"), "level": F.col("_class.level"), "sponsor_tier": resolve_tier(F.col("_tier"), F.col("registry_flags"))}).drop("_class", "_tier")


def _with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows whose ``description`` names a text, with that text."""
    met = rows.join(texts, F.col("description") == F.col("_named"), "left")
    return met.select(*(F.col("_text" if c == "description" else c).alias(c) for c in rows.columns))


def _texts(df: DataFrame, name: Column) -> DataFrame:
    return df.select(name.alias("_named"), F.col("description").alias("_text"))


def _classified(jobs: DataFrame, met: DataFrame, seen_at, texts: DataFrame | None = None) -> DataFrame:  # noqa: ANN001
    """Postings (with ``company_id`` and ``registry_flags``) as an upsert takes them; only new or changed ones are classified.

    With ``texts``, descriptions are names of these, and the changed postings alone have theirs fetched.
    """
    changed = changed_only(met, jobs)
    changed = changed if texts is None else _with_texts(changed.select("source_id", "external_id", "title", "description", "registry_flags"), texts)
    fresh = classify_postings(changed).select("source_id", "external_id", "categories", "level", "sponsor_tier", "sponsor_evidence")
    return met.join(fresh, ["source_id", "external_id"], "left").withColumn("seen_at", F.lit(seen_at).cast("timestamp"))


def _merged(jobs: DataFrame, met: DataFrame, seen_at) -> DataFrame:  # noqa: ANN001
    """Jobs after the upsert of postings that carry ``company_id`` and ``registry_flags``."""
    return upsert_jobs(jobs, _classified(jobs, met, seen_at))


def of_boards(companies: DataFrame, only_slug: str | None = None) -> DataFrame:
    """The companies whose boards a run polls, in the run's order: active ones that aren't shadows, or the one board that is asked for."""
    own = companies.where(F.col("active") & (F.col("ats_type") != vocab.SHADOW_ATS))
    return (own if only_slug is None else own.where(F.col("ats_slug") == only_slug)).orderBy("priority", "name")


COUNTERS = "fetched long, upserted long, errors long, closed long, failure string"


def _named(companies: DataFrame, postings: DataFrame, company_id: int | None) -> DataFrame:
    """Postings with ``company_id`` and ``registry_flags`` of the one company, or of the employer that each names."""
    named = companies.select(F.col("id").alias("company_id"), F.col("name").alias("_n"), "registry_flags")
    if company_id is not None:
        return postings.crossJoin(named.where(F.col("company_id") == company_id).drop("_n").limit(1))  # one row
    return postings.join(named, postings["company_name"] == F.col("_n")).drop("_n")


def _read_once(postings: DataFrame, company_id: int | None) -> tuple[DataFrame, int, int]:
    """Postings written as they are read with a number for each (``_row``), how many there are, and how many of them can be upserted."""
    counted = Observation()
    can = F.lit(True) if company_id is not None else F.coalesce(F.col("company_name") != "", F.lit(False))
    kept = written(postings.withColumn("_row", F.monotonically_increasing_id()).observe(counted, F.count(F.lit(1)).alias("seen"), F.count_if(can).alias("upserted")), "postings")
    return kept, counted.get["seen"], counted.get["upserted"]


def poll(jobs: DataFrame, companies: DataFrame, postings: DataFrame, seen_at, source: str, company_id: int | None = None, fetched: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: ANN001
    """One poll of a source: new snapshots of jobs and companies, and one row of counters.

    Only new or changed postings are classified. ``fetched`` is the number of rows that came (all of
    ``postings`` if it isn't given). Of a company's board, if rows came and none could be read, the
    source has drifted: jobs stay as they are, nothing is swept; an empty poll sweeps. Without a
    company, employers are found or made by name and the sweep is scoped by source alone. A posting that
    names no employer is seen, so it isn't closed, but an error, not upserted; such sources know no
    drift, and sweep whatever came. Counters: ``fetched``, ``upserted``, ``errors`` (rows that couldn't
    be read or have no employer), ``closed`` (postings that this poll closes) and ``failure`` (null or
    ``schema_drift``). They come with the two passes that write the postings and the jobs.
    """
    postings, seen, upserted = _read_once(postings, company_id)
    fetched = seen if fetched is None else fetched
    drift = company_id is not None and fetched > 0 and not upserted
    counters = lambda closed: jobs.sparkSession.createDataFrame([(fetched, upserted, fetched - upserted, closed, "schema_drift" if drift else None)], COUNTERS)
    if drift:
        return jobs, companies, counters(0)
    if company_id is None:
        pos = "pos" if "pos" in postings.columns else "external_id"
        companies = get_or_create_companies(companies, postings.select(F.col("company_name").alias("name"), "country", F.col(pos).alias("pos")))
    scope = F.col("source_id") == source
    if company_id is not None:
        scope = scope & (F.col("company_id") == company_id)
    observed = Observation()
    old, new = F.concat(F.lit("s"), F.col("id").cast("string")), F.concat(F.lit("p"), F.col("_row").cast("string"))
    stored = written(jobs.withColumn("description", old), "stored")
    came = _texts(postings, new)
    incoming = written(_classified(stored, _named(companies, postings.withColumn("description", new).drop("_row"), company_id), seen_at, came), "incoming")
    merged = upsert_jobs(stored, incoming)
    swept = _with_texts(sweep(merged, postings.select("source_id", "external_id"), scope, seen_at, closes="_closes"), came.unionByName(_texts(jobs, old)))
    polled = written(swept.observe(observed, F.count_if("_closes").alias("closed")).drop("_closes"), "polled")  # a chain of polls has plans of one poll each
    return polled, companies, counters(observed.get["closed"])


def poll_table(spark: SparkSession, root: str, companies: DataFrame, postings: DataFrame, seen_at, source: str, company_id: int | None = None, fetched: int | None = None) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """``poll`` of a table of buckets at ``root``, of which those are rewritten that hold a posting that came or that is swept: companies and counters."""
    postings, seen, upserted = _read_once(postings, company_id)
    fetched = seen if fetched is None else fetched
    drift = company_id is not None and fetched > 0 and not upserted
    closed = 0
    if not drift:
        if company_id is None:
            pos = "pos" if "pos" in postings.columns else "external_id"
            companies = get_or_create_companies(companies, postings.select(F.col("company_name").alias("name"), "country", F.col(pos).alias("pos")))
        scope = F.col("source_id") == source
        if company_id is not None:
            scope = scope & (F.col("company_id") == company_id)
        version = buckets.read_version(spark, root)
        met = _named(companies, postings, company_id)
        stored = buckets.read_buckets(spark, version, buckets.touched_by(met, version))
        observed = Observation()
        poll_into(spark, root, _classified(stored, met, seen_at), scope, [seen_at], version.number, observed, postings.select("source_id", "external_id"))
        closed = observed.get["closed"]
    return companies, spark.createDataFrame([(fetched, upserted, fetched - upserted, closed, "schema_drift" if drift else None)], COUNTERS)


def poll_all(jobs: DataFrame, companies: DataFrame, postings: DataFrame, fetches: DataFrame, seen_at) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: ANN001
    """One round of polls of all boards: new snapshots of jobs and companies, and a row of results for each poll.

    ``fetches``: company_id, source_id, fetched (rows that came) and failure (null, ``gone`` or
    ``unreachable``), one row for each company. ``postings``: those that could be read, with company_id.
    Companies without a supported board and quarantined ones aren't polled: their jobs are neither
    merged nor swept, and their health stays. A failed poll and one of which no row could be read
    (drift) merge and sweep nothing; all polls leave their mark on the company's health. Results:
    ``company_id``, ``fetched``, ``upserted``, ``errors``, ``closed``, ``failure``.
    """
    gate = companies.where(F.col("active") & F.col("ats_type").isin(vocab.SUPPORTED_ATS) & (F.col("health") != "quarantined")).select(F.col("id").alias("company_id"), "registry_flags")
    counts = postings.groupBy("company_id").agg(F.count(F.lit(1)).alias("upserted"))
    polls = fetches.join(gate, "company_id").join(counts, "company_id", "left")
    polls = polls.withColumn("upserted", F.when(F.col("failure").isNotNull(), 0).otherwise(F.coalesce("upserted", F.lit(0)))).withColumn("outcome", poll_outcome(F.col("fetched"), F.col("upserted"), F.col("failure")))
    polls = written(polls.select("company_id", "source_id", "registry_flags", "fetched", "upserted", "outcome"), "polls")
    good = polls.where("outcome = 'success'")
    met = postings.join(good.select("company_id", "source_id", "registry_flags"), ["company_id", "source_id"])
    merged = written(_merged(jobs, met, seen_at), "merged")
    scoped = merged.join(good.select("company_id", "source_id", F.lit(True).alias("_polled")), ["company_id", "source_id"], "left")
    swept = sweep(scoped, met.select("source_id", "external_id"), F.coalesce("_polled", F.lit(False)), seen_at, closes="_closes")
    closed = swept.where("_closes").groupBy("company_id").agg(F.count(F.lit(1)).alias("closed"))
    failure = F.when(F.col("outcome") != "success", F.col("outcome"))
    came = F.when(failure.isin("gone", "unreachable"), 0).otherwise(F.col("fetched"))
    errors = F.when(failure.isin("gone", "unreachable"), 1).otherwise(F.col("fetched") - F.col("upserted"))
    results = polls.join(closed, "company_id", "left").select("company_id", came.cast("long").alias("fetched"), F.col("upserted").cast("long").alias("upserted"), errors.cast("long").alias("errors"), F.coalesce("closed", F.lit(0)).cast("long").alias("closed"), failure.alias("failure"))
    return swept.select(*jobs.columns), after_poll(companies, polls, F.lit(seen_at)), results


def upgrade_residue(jobs: DataFrame, replies: DataFrame) -> DataFrame:
    """A new snapshot where postings that were classified without a category have that of a reply (id, categories, level), if it found one."""
    new = replies.where(F.size("categories") > 0).select(F.col("id").alias("_i"), F.col("categories").alias("_categories"), F.col("level").alias("_level"))
    met = jobs.join(new, F.col("id") == F.col("_i"), "left")
    use = (F.size("categories") == 0) & F.col("_i").isNotNull()
    return met.withColumns({"level": F.when(use, F.col("_level")).otherwise(F.col("level")), "categories": F.when(use, F.col("_categories")).otherwise(F.col("categories"))}).drop("_i", "_categories", "_level")


def backfill(jobs: DataFrame) -> DataFrame:
    """A new snapshot where postings that were never classified are; those found to be of no category stay empty, not null."""
    found = classify(F.col("title"), F.col("description"))
    todo = F.col("categories").isNull()
    return jobs.withColumns({"_c": found}).withColumns({"categories": F.when(todo, F.col("_c.categories")).otherwise(F.col("categories")), "level": F.when(todo, F.col("_c.level")).otherwise(F.col("level"))}).drop("_c")
