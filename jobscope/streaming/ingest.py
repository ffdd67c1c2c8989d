"""Polls as a stream of landing files: each micro-batch is merged into the job table; matches are sent once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobscope import buckets
from jobscope.operators.state import insert_ignore, poll_into, sweep_polls, upsert_into, upsert_jobs
from jobscope.store import SnapshotConflict, newest_version, read_snapshot, write_snapshot, written

#: Times that a snapshot is tried again when other writers come first.
TRIES = 20


def _new_polls(jobs: DataFrame, rows: DataFrame, own: Column) -> tuple[DataFrame, list]:
    """Rows without the source's polls that the table has seen before its newest, and the times of polls after that."""
    before = jobs.where(own).agg(F.max("last_seen_at")).first()[0]
    rows = rows if before is None else rows.where(~own | (F.col("seen_at") >= before))
    polls = sorted(r[0] for r in rows.where(own).select("seen_at").distinct().collect())  # a row for each poll of the batch
    return rows, [p for p in polls if before is None or p > before]


def merge_batches(incoming: DataFrame, jobs_root: str, checkpoint: str, sweep_source: str | None = None) -> StreamingQuery:
    """Merge normalized, classified postings (with ``company_id`` and ``seen_at``) into the table at ``jobs_root``.

    A micro-batch may hold several polls (``seen_at``): they are merged and swept as if they had come
    one after the other, in one fold for each posting. Of the swept source, polls older than the newest
    that the table has seen are counted already and left out, and the rest of that newest poll counts as
    present at it, so a batch that is run again after a failure gives the same table.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        if rows.isEmpty():
            return
        version = newest_version(spark, jobs_root)
        jobs = read_snapshot(spark, jobs_root, version)
        if sweep_source is None:
            write_snapshot(upsert_jobs(jobs, rows), jobs_root, version)
            return
        own = F.col("source_id") == sweep_source
        rows, polls = _new_polls(jobs, rows, own)
        seen = rows.where(own).groupBy("source_id", "external_id").agg(F.collect_set("seen_at").alias("presence"))
        after = sweep_polls(upsert_jobs(jobs, rows), seen, own, polls)
        write_snapshot(after, jobs_root, version)

    return incoming.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_batches_into(incoming: DataFrame, jobs_root: str, checkpoint: str, sweep_source: str | None = None) -> StreamingQuery:
    """``merge_batches`` into a table of buckets: a micro-batch rewrites those that hold a posting that came or that is swept."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        if rows.isEmpty():
            return
        version = buckets.read_version(spark, jobs_root)
        if sweep_source is None:
            upsert_into(spark, jobs_root, rows, version.number)
            return
        own = F.col("source_id") == sweep_source
        rows, polls = _new_polls(buckets.read_buckets(spark, version), rows, own)
        poll_into(spark, jobs_root, rows, own, polls, version.number)

    return incoming.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_matches(found: DataFrame, within: str) -> DataFrame:
    """Of a stream of matches (with ``found_at``) each once, if its repeats come ``within`` that time of it: state without a ledger."""
    return found.withWatermark("found_at", within).dropDuplicatesWithinWatermark(["search_id", "job_canonical_id"])


CLAIMS = "search_id long, job_canonical_id long, reason string, claim string, claimed_at timestamp"


def _changed(spark: SparkSession, root: str, change: Callable[[DataFrame], DataFrame], none: str) -> None:
    """Write a table's next version from its newest, again where another writer comes first."""
    for _ in range(TRIES):
        version = newest_version(spark, root)
        now = read_snapshot(spark, root, version) if version else spark.createDataFrame([], none)
        try:
            write_snapshot(change(now), root, version)
        except SnapshotConflict:
            continue
        return
    raise SnapshotConflict(f"{root}: other writers came first {TRIES} times")


def notify_batches(found: DataFrame, ledger_root: str, send: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Send each match once: it is claimed in an outbox before it is sent, and recorded in the ledger after.

    A claim is a version of the outbox (``ledger_root`` with ``-claims``), so of two writers that want
    one match only one sends it. A send that fails gives its claims back and records nothing. What
    happens between the send and the ledger, a conflict or a crash, never sends again: the ledger is
    written on what it then holds, and claims that no ledger entry follows stay (``open_claims``), for
    somebody to look at, as whether they were sent can't be known.
    """
    keys = ["search_id", "job_canonical_id"]
    outbox = f"{ledger_root.rstrip('/')}-claims"

    def batch(rows: DataFrame, number: int) -> None:
        spark: SparkSession = rows.sparkSession
        wanted = written(rows.dropDuplicates(keys).select(*keys, "reason"), "matches")
        claim = f"{checkpoint}#{number}#{spark.sql('SELECT uuid()').first()[0]}"

        def claimed(claims: DataFrame) -> DataFrame:
            new = wanted.join(read_snapshot(spark, ledger_root).select(*keys), keys, "left_anti").join(claims.select(*keys), keys, "left_anti")
            return claims.unionByName(new.select(*keys, "reason", F.lit(claim).alias("claim"), F.current_timestamp().alias("claimed_at")))

        _changed(spark, outbox, claimed, CLAIMS)
        own = read_snapshot(spark, outbox).where(F.col("claim") == claim).select(*keys, "reason")
        if own.isEmpty():
            return
        try:
            send(own)
        except Exception:
            _changed(spark, outbox, lambda claims: claims.where(F.col("claim") != claim), CLAIMS)
            raise
        sent = own.select(*keys, F.current_timestamp().alias("notified_at"), F.col("reason").alias("match_reason"))
        _changed(spark, ledger_root, lambda ledger: insert_ignore(ledger, sent, keys), "search_id long, job_canonical_id long, notified_at timestamp, match_reason string")
        _changed(spark, outbox, lambda claims: claims.where(F.col("claim") != claim), CLAIMS)

    return found.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def open_claims(spark: SparkSession, ledger_root: str) -> DataFrame:
    """Claims of matches that the ledger hasn't got: those being sent now, and those of runs that broke off."""
    claims = read_snapshot(spark, f"{ledger_root.rstrip('/')}-claims")
    return claims.join(read_snapshot(spark, ledger_root).select("search_id", "job_canonical_id"), ["search_id", "job_canonical_id"], "left_anti")
