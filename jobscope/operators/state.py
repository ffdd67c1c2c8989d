"""State of postings and employers between polls: merges, sweeps, ledgers, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobscope import buckets, vocab
from jobscope.functions.text import local_month
from jobscope.store import merge, with_ids, with_new_ids, written


def changed_only(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming postings that are new or whose description changed: only these are classified again."""
    known = stored.select(F.col("source_id").alias("_s"), F.col("external_id").alias("_e"), F.col("content_hash").alias("_h"))
    met = incoming.join(known, (F.col("source_id") == F.col("_s")) & (F.col("external_id") == F.col("_e")), "left")
    return met.where(F.col("_h").isNull() | (F.col("_h") != F.col("content_hash"))).drop("_s", "_e", "_h")


#: What a poll says of a posting anew each time.
OVERWRITTEN = ["title", "description", "url", "location_raw", "country", "city", "content_hash", "posted_at"]


def _folded(incoming: DataFrame) -> DataFrame:
    """One row for each posting from the polls (``seen_at``) that have it, as merging one poll after the other would leave it.

    What was last seen counts for all that is overwritten; categories, level and tier are the last that
    aren't null, and evidence is that of the last tier; the company is the first. ``first_seen`` is the
    first poll, ``hashes`` are the content hashes in the order of the polls, and ``presence`` the polls.
    A posting has as many rows as there are polls, so they are gathered.
    """
    keys = ["source_id", "external_id"]
    said = F.sort_array(F.collect_list(F.struct("seen_at", "content_hash", "company_id", "sponsor_evidence", "sponsor_tier", "level", "categories")))
    each = incoming.groupBy(*keys, "seen_at").agg(F.max_by(F.struct(*incoming.columns), "seen_at").alias("r")).select("r.*")
    met = each.groupBy(*keys).agg(F.max_by(F.struct(*incoming.columns), "seen_at").alias("r"), said.alias("_p"))
    last = lambda c: F.try_element_at(F.filter("_p", lambda p: p[c].isNotNull()), F.lit(-1))
    own = {"company_id": F.col("_p")[0]["company_id"], "categories": last("categories")["categories"], "level": last("level")["level"], "sponsor_tier": last("sponsor_tier")["sponsor_tier"], "sponsor_evidence": F.when(last("sponsor_tier").isNotNull(), last("sponsor_tier")["sponsor_evidence"]).otherwise(F.col("_p")[0]["sponsor_evidence"])}
    return met.select(*(own.get(c, F.col(f"r.{c}")).alias(c) for c in incoming.columns), F.col("_p")[0]["seen_at"].alias("first_seen"), F.transform("_p", lambda p: p["content_hash"]).alias("hashes"), F.transform("_p", lambda p: p["seen_at"]).alias("presence"))


def _upsert_rules() -> tuple[dict, dict]:
    """What becomes of a stored posting that was seen, and of a new one, over ``s`` and ``_folded`` rows as ``i``."""
    i, s = (lambda c: F.col(f"i.{c}")), (lambda c: F.col(f"s.{c}"))
    before = F.concat(F.array(s("content_hash")), F.slice(i("hashes"), 1, F.size(i("hashes")) - 1))
    changed = F.exists(F.zip_with(before, i("hashes"), lambda x, y: F.coalesce(x != y, F.lit(False))), lambda x: x)
    merged = {c: i(c) for c in OVERWRITTEN} | {
        "categories": F.coalesce(i("categories"), s("categories")),
        "level": F.coalesce(i("level"), s("level")),
        "sponsor_tier": F.coalesce(i("sponsor_tier"), s("sponsor_tier")),
        "sponsor_evidence": F.when(i("sponsor_tier").isNotNull(), i("sponsor_evidence")).otherwise(s("sponsor_evidence")),
        "last_seen_at": i("seen_at"),
        "user_status": F.when(changed, "new").otherwise(s("user_status")),
    }
    inserted = {"id": i("new_id"), "sponsor_tier": F.coalesce(i("sponsor_tier"), F.lit("unknown")), "first_seen_at": i("first_seen"), "last_seen_at": i("seen_at"), "user_status": F.lit("new"), "consecutive_misses": F.lit(0)}
    return merged, inserted


def upsert_jobs(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """A new snapshot after a poll, or several.

    ``incoming`` has the columns of a normalized posting with ``company_id``, ``seen_at`` and, only
    where they were worked out anew, ``categories``, ``level``, ``sponsor_tier`` and
    ``sponsor_evidence`` (else null). Nulls keep what is stored; evidence is rewritten exactly when a
    tier comes with it; a changed description makes the posting new again; first sight and company
    are never changed. New postings are numbered after the largest id, in the order of the polls that
    brought them and of their keys. Of several rows of one posting in one poll any counts.
    """
    keys = ["source_id", "external_id"]
    last = with_new_ids(stored, _folded(incoming), keys, first=["first_seen"])
    return merge(stored, last, keys, *_upsert_rules())


def upsert_into(spark: SparkSession, root: str, incoming: DataFrame, number: int | None = None) -> buckets.Version:
    """``upsert_jobs`` into a table of buckets (by ``source_id`` and ``external_id``): only those of the incoming postings are rewritten."""
    return buckets.merge_into(spark, root, _folded(incoming), *_upsert_rules(), number=number, order=["first_seen"])


def poll_into(spark: SparkSession, root: str, incoming: DataFrame, scope, polls: list, number: int | None = None, observed=None, present: DataFrame | None = None) -> buckets.Version:  # noqa: ANN001
    """Polls of ``scope`` merged into a table of buckets and swept, as one rewrite of the buckets that hold a posting of either.

    ``polls``: the times of all of them, those that brought nothing included. ``observed``: an
    ``Observation`` that gets ``closed``, the postings that these polls leave closed and found open.
    ``present``: ``source_id`` and ``external_id`` of what the last poll had, where that is more than is merged.
    """
    version = buckets.read_version(spark, root, number)
    seen = written(_folded(incoming), "incoming")
    small = buckets.is_small(seen)
    swept = buckets.read_buckets(spark, version).where(scope)  # its keys and what ``scope`` asks for are all that is read
    touched = sorted({*buckets.touched_by(seen, version), *buckets.touched_by(swept, version)})

    def change(stored: DataFrame) -> DataFrame:
        merged = buckets.merge_rows(stored, buckets.with_numbers(stored, seen, version, small, ["first_seen"]), version, *_upsert_rules(), small)
        here = seen.select("source_id", "external_id", "presence")
        if present is not None:
            also = present.select("source_id", "external_id", F.array(F.lit(polls[-1]).cast("timestamp")).alias("presence"))
            here = here.unionByName(also).groupBy("source_id", "external_id").agg(F.flatten(F.collect_list("presence")).alias("presence"))
        out = sweep_polls(merged, F.broadcast(here) if small else here, scope, polls, closes="_closes")
        return (out if observed is None else out.observe(observed, F.count_if("_closes").alias("closed"))).drop("_closes")

    return buckets.update(spark, root, version, touched, change)


def get_or_create_companies(companies: DataFrame, names: DataFrame) -> DataFrame:
    """Companies with a row for each new ``name``: a shadow without a board, of the lowest priority, numbered after the largest id.

    ``names`` may have ``country`` and ``pos``: the shadow's country is that of the name's first row, empty where that has none.
    """
    country = F.col("country") if "country" in names.columns else F.lit(None).cast("string")
    pos = F.col("pos") if "pos" in names.columns else F.lit(0)
    first = names.where("name is not null and name != ''").groupBy("name").agg(F.min(F.struct(pos.alias("pos"), F.coalesce(country, F.lit("")).alias("country"))).alias("f")).select("name", "f.country")
    new = first.join(companies.select("name"), "name", "left_anti")
    top = companies.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    numbered = with_ids(new, 1, ["name"], "n").join(F.broadcast(top)).select((F.col("top") + F.col("n")).alias("id"), "name", "country")  # one row, one number
    defaults = {"id": F.col("id"), "name": F.col("name"), "ats_type": F.lit(vocab.SHADOW_ATS), "ats_slug": F.lit(""), "country_hq": F.col("country"), "registry_flags": F.lit(0), "priority": F.lit(vocab.SHADOW_PRIORITY), "active": F.lit(True), "consecutive_failures": F.lit(0), "health": F.lit("ok")}
    shaped = numbered.select(*(defaults.get(c, F.lit(None)).cast(companies.schema[c].dataType).alias(c) for c in companies.columns))
    return companies.unionByName(shaped)


def upsert_companies(companies: DataFrame, seeds: DataFrame) -> DataFrame:
    """Companies after the seed list was read again: new ones are numbered after the largest id by name, and a changed board starts with good health."""
    i, s = (lambda c: F.col(f"i.{c}")), (lambda c: F.col(f"s.{c}"))
    moved = (s("ats_type") != i("ats_type")) | (s("ats_slug") != i("ats_slug"))
    merged = {c: i(c) for c in ("ats_type", "ats_slug", "country_hq", "priority")} | {
        "consecutive_failures": F.when(moved, 0).otherwise(s("consecutive_failures")),
        "health": F.when(moved, "ok").otherwise(s("health")),
        "quarantine_reason": F.when(moved, F.lit(None).cast("string")).otherwise(s("quarantine_reason")),
    }
    return merge(companies, with_new_ids(companies, seeds.dropDuplicates(["name"]), ["name"]), ["name"], {c: e for c, e in merged.items() if c in companies.columns}, {"id": i("new_id"), "registry_flags": F.lit(0), "active": F.lit(True), "consecutive_failures": F.lit(0), "health": F.lit("ok")})


def sweep(jobs: DataFrame, seen: DataFrame, scope, now, threshold: int = vocab.CLOSE_AFTER_MISSES, closes: str | None = None) -> DataFrame:  # noqa: ANN001
    """A new snapshot after a successful poll of ``scope`` (a predicate on jobs).

    Postings in ``seen`` (source_id, external_id) have no misses and are open; an absent one has one
    more miss and is closed, if it is still open, when that reaches the threshold. ``closes`` names a
    further column that says which rows this sweep closes.
    """
    here = seen.select(F.col("source_id").alias("_s"), F.col("external_id").alias("_e")).distinct().withColumn("_seen", F.lit(True))
    met = jobs.join(here, (F.col("source_id") == F.col("_s")) & (F.col("external_id") == F.col("_e")), "left")
    present, misses = F.col("_seen").isNotNull(), F.col("consecutive_misses") + 1
    closing = F.coalesce(scope & ~present & F.col("closed_at").isNull() & (misses >= threshold), F.lit(False))
    out = met.withColumns(
        {
            "closed_at": F.when(scope & present, F.lit(None).cast("timestamp")).when(closing, F.lit(now).cast("timestamp")).otherwise(F.col("closed_at")),
            "consecutive_misses": F.when(scope & present, 0).when(scope, misses).otherwise(F.col("consecutive_misses")),
        }
        | ({closes: closing} if closes else {})
    )
    return out.drop("_s", "_e", "_seen")


def sweep_polls(jobs: DataFrame, seen: DataFrame, scope, polls: list, threshold: int = vocab.CLOSE_AFTER_MISSES, closes: str | None = None) -> DataFrame:  # noqa: ANN001
    """``sweep`` after each of several polls of ``scope``, as one fold for each posting.

    ``polls``: their times, rising. ``seen``: ``source_id``, ``external_id`` and ``presence``, the polls
    that had the posting. Misses count from the last of these, and a posting closes at the poll where
    they reach the threshold. A poll before the first of ``polls`` in ``presence`` is one that was swept
    already and has the posting after all. ``closes`` names a column that says which postings are left
    closed that were open before.
    """
    here = seen.select(F.col("source_id").alias("_s"), F.col("external_id").alias("_e"), F.col("presence").alias("_presence"))
    met = jobs.join(here, (F.col("source_id") == F.col("_s")) & (F.col("external_id") == F.col("_e")), "left")
    times, k = F.array(*(F.lit(p).cast("timestamp") for p in polls)), len(polls)
    last = F.array_max("_presence")
    # the place of the last presence among the polls, 0 if it came before them
    place = F.size(F.filter(times, lambda t: t <= last)) if polls else F.lit(0)
    present = F.col("_presence").isNotNull()
    misses = F.when(present, F.lit(k) - place).otherwise(F.col("consecutive_misses") + k).cast("int")
    # how many polls from then on it takes to close
    steps = F.when(present, place + threshold).otherwise(F.greatest(F.lit(1), F.lit(threshold) - F.col("consecutive_misses")))
    closing = F.try_element_at(times, steps) if polls else F.lit(None).cast("timestamp")
    after = F.when(present, closing).otherwise(F.coalesce(F.col("closed_at"), closing))
    out = met.withColumns(
        {"closed_at": F.when(scope, after).otherwise(F.col("closed_at")), "consecutive_misses": F.when(scope, misses).otherwise(F.col("consecutive_misses"))}
        | ({closes: F.coalesce(scope & F.col("closed_at").isNull() & after.isNotNull(), F.lit(False))} if closes else {})
    )
    return out.drop("_s", "_e", "_presence")


def miss_streaks(polls: DataFrame, threshold: int = vocab.CLOSE_AFTER_MISSES) -> DataFrame:
    """The same from a log of polls (key, poll, present): ``misses`` since the last presence and ``closed``, for each poll."""
    order = Window.partitionBy("key").orderBy("poll")
    island = polls.withColumn("island", F.sum(F.col("present").cast("int")).over(order))
    misses = F.sum((~F.col("present")).cast("int")).over(Window.partitionBy("key", "island").orderBy("poll")).cast("long")
    return island.withColumn("misses", misses).select("key", "poll", "misses", (F.col("misses") >= threshold).alias("closed"))


def insert_ignore(ledger: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The ledger with those rows whose key it hasn't got; what it has stays as it is."""
    new = rows.dropDuplicates(keys).join(ledger.select(*keys), keys, "left_anti")
    return ledger.unionByName(new.select(*ledger.columns))


def delete_cascade(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, doomed) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """Parents without the doomed rows, and children of those that stay."""
    gone = parents.where(doomed).select(F.col(parent_key).alias("_k"))
    return parents.join(gone, F.col(parent_key) == F.col("_k"), "left_anti"), children.join(gone, F.col(child_key) == F.col("_k"), "left_anti")


def _deleted(parents: DataFrame, doomed) -> DataFrame:  # noqa: ANN001
    return parents.agg(F.count_if(doomed).alias("deleted"))


def delete_search(searches: DataFrame, seen: DataFrame, doomed) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: ANN001
    """Saved searches without the doomed ones, the ledger without what they were notified of, and how many went (``deleted``)."""
    return *delete_cascade(searches, seen, "id", "search_id", doomed), _deleted(searches, doomed)


def delete_jobs(jobs: DataFrame, scores: DataFrame, doomed) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: ANN001
    """Postings without the doomed ones, scores without theirs, and how many went."""
    return *delete_cascade(jobs, scores, "id", "job_canonical_id", doomed), _deleted(jobs, doomed)


def delete_resume(resumes: DataFrame, resume_id: int) -> tuple[DataFrame, DataFrame]:
    """Resumes without one, and whether it was there; scores are kept by the text's hash, and stay for it."""
    own = F.col("id") == resume_id
    return resumes.where(~own), _deleted(resumes, own)


#: Parts that a month's calls are ranked in.
SHARDS = 64


def admit_calls(calls: DataFrame, cap: int, zone: str = vocab.BUDGET_ZONE) -> DataFrame:
    """``admitted``: whether a call (ts, call_id, which is unique) is among the first ``cap`` of its month in the zone.

    Each month is ranked in parts, of which only the first ``cap`` calls can be admitted; the last
    admitted call, one row a month, then tells all others.
    """
    dated = calls.withColumn("month", local_month(F.col("ts"), zone))
    dealt = dated.select("month", "ts", "call_id", F.pmod(F.xxhash64("call_id"), F.lit(SHARDS)).alias("shard"))
    first = dealt.withColumn("r", F.row_number().over(Window.partitionBy("month", "shard").orderBy("ts", "call_id"))).where(F.col("r") <= cap)
    last = first.withColumn("r", F.row_number().over(Window.partitionBy("month").orderBy("ts", "call_id"))).where(F.col("r") <= cap)
    last = last.groupBy(F.col("month").alias("_month")).agg(F.max(F.struct("ts", "call_id")).alias("_last"))
    met = dated.join(F.broadcast(last), F.col("month").eqNullSafe(F.col("_month")), "left")  # one row a month
    return met.withColumn("admitted", F.coalesce(F.struct("ts", "call_id") <= F.col("_last"), F.lit(False))).drop("_month", "_last")


def add_usage(usage: DataFrame, admitted: DataFrame) -> DataFrame:
    """Usage (month, call_count) with one call more for each admitted row (month); a month without a row gets one."""
    calls = admitted.groupBy("month").agg(F.count(F.lit(1)).alias("call_count"))
    return usage.select("month", F.col("call_count").cast("long")).unionByName(calls).groupBy("month").agg(F.sum("call_count").alias("call_count"))


def put_settings(settings: DataFrame, changes: DataFrame) -> DataFrame:
    """Settings (key, value) after changes (one a key): a value is stored in place of the old one, a null deletes the key."""
    kept = settings.join(changes.select("key"), "key", "left_anti")
    return kept.select("key", "value").unionByName(changes.where("value is not null").select("key", "value"))


def add_searches(searches: DataFrame, new: DataFrame) -> DataFrame:
    """Saved searches with new ones, numbered after the largest id by name and filters; they have not run yet."""
    numbered = with_ids(new, 1, ["name", "filters_json"], "_n").join(F.broadcast(searches.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))))  # one row, one number
    values = {"id": F.col("_top") + F.col("_n"), "last_run_at": F.lit(None)}
    return searches.unionByName(numbered.select(*(values.get(c, F.col(c) if c in new.columns else F.lit(None)).cast(searches.schema[c].dataType).alias(c) for c in searches.columns)))


def touch_searches(searches: DataFrame, ran: DataFrame, at) -> DataFrame:  # noqa: ANN001
    """Searches with ``last_run_at`` set for those that ran (id)."""
    here = ran.select(F.col("id").alias("_ran")).distinct()
    met = searches.join(here, F.col("id") == F.col("_ran"), "left")
    return met.withColumn("last_run_at", F.when(F.col("_ran").isNotNull(), F.lit(at).cast("timestamp")).otherwise(F.col("last_run_at"))).drop("_ran")


def activate_resume(resumes: DataFrame, resume_id: int) -> DataFrame:
    """Resumes with one alone active."""
    return resumes.withColumn("active", F.col("id") == resume_id)


def prune_backups(names: DataFrame, keep: int = vocab.BACKUPS_KEPT) -> DataFrame:
    """The ``keep`` newest backups by name."""
    return names.orderBy(F.desc("name")).limit(keep)
