"""Health of sources: a fold over each source's events, and reports on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope import vocab

STATE = "struct<failures:int,health:string,reason:string,last_success:timestamp>"

#: Bits of the number of events that are folded at once.
CHUNK_BITS = 14


def threshold(kind: Column, thresholds: dict[str, int] = vocab.FAILURE_THRESHOLDS) -> Column:
    out = F.lit(None).cast("int")
    for name, n in thresholds.items():
        out = F.when(kind == name, n).otherwise(out)
    return out


def _step(state: Column, event: Column, thresholds: dict[str, int]) -> Column:
    """One event (ts, kind): a quarantined source ignores all but successful probes; a probe's failure changes nothing."""
    kind, failures = event["kind"], state["failures"] + 1
    probe_ok, success = kind == "probe_success", kind == "success"
    quarantined = state["health"] == "quarantined"
    good = F.struct(F.lit(0).alias("failures"), F.lit("ok").alias("health"), F.lit(None).cast("string").alias("reason"), event["ts"].alias("last_success"))
    bad = F.struct(failures.alias("failures"), F.when(failures >= threshold(kind, thresholds), "quarantined").otherwise("degraded").alias("health"), kind.alias("reason"), state["last_success"].alias("last_success"))
    return F.when(probe_ok | (success & ~quarantined), good.cast(STATE)).when(quarantined | ~kind.isin(*thresholds), state).otherwise(bad.cast(STATE))


def after_poll(companies: DataFrame, polls: DataFrame, at: Column, thresholds: dict[str, int] = vocab.FAILURE_THRESHOLDS) -> DataFrame:
    """Companies with the health that their polls (company_id, outcome; one each) leave them in; others stay as they are."""
    known = polls.select(F.col("company_id").alias("_c"), F.col("outcome").alias("_kind"))
    met = companies.join(known, F.col("id") == F.col("_c"), "left")
    before = F.struct(F.col("consecutive_failures").alias("failures"), F.col("health").alias("health"), F.col("quarantine_reason").alias("reason"), F.col("last_success_at").alias("last_success")).cast(STATE)
    state = F.when(F.col("_kind").isNull(), before).otherwise(_step(before, F.struct(at.cast("timestamp").alias("ts"), F.col("_kind").alias("kind")), thresholds))
    out = met.withColumn("_state", state)
    return out.withColumns({"consecutive_failures": F.col("_state.failures"), "health": F.col("_state.health"), "quarantine_reason": F.col("_state.reason"), "last_success_at": F.col("_state.last_success")}).drop("_c", "_kind", "_state")


def _after(start: Column, events: Column, thresholds: dict[str, int]) -> Column:
    """``state`` after the events from a state, and whether one of them set it anew (``reset``)."""

    def step(s: Column, e: Column) -> Column:
        anew = (e["kind"] == "probe_success") | ((e["kind"] == "success") & (s["state"]["health"] != "quarantined"))
        return F.struct(_step(s["state"], e, thresholds).alias("state"), (s["reset"] | F.coalesce(anew, F.lit(False))).alias("reset"))

    return F.aggregate(events, F.struct(start.alias("state"), F.lit(False).alias("reset")), step)


def _joined(state: Column, out: Column, most: int) -> Column:
    """The state after a chunk, from the state before it and the chunk's outcomes for each possible one."""
    quarantined = state["health"] == "quarantined"
    known = F.least(state["failures"], F.lit(most))
    of = F.get(out, F.when(quarantined, most + 1).otherwise(known))
    more = of["state"]["failures"] - F.when(quarantined, 0).otherwise(known)
    failed = F.struct((state["failures"] + more).alias("failures"), of["state"]["health"].alias("health"), of["state"]["reason"].alias("reason"), state["last_success"].alias("last_success"))
    return F.when(of["reset"], of["state"]).when(more > 0, failed.cast(STATE)).otherwise(state)


def fold_health(events: DataFrame, thresholds: dict[str, int] = vocab.FAILURE_THRESHOLDS, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """The state of each ``source`` after its events (ts, seq, kind), in order of time and sequence.

    The threshold of the current failure's kind is held against the whole streak, whatever it is made
    of. Events are dealt by ranges of source, time and sequence and cut into chunks of bounded size. A
    chunk is reduced to its outcome for each state it may start in (no failures to the largest
    threshold, beyond which all act alike, and quarantined); only outcomes are folded for each source.
    """
    most = max(thresholds.values())
    begin = lambda failures, health: F.struct(F.lit(failures).alias("failures"), F.lit(health).alias("health"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("timestamp").alias("last_success")).cast(STATE)
    key = ["source", "ts", "seq", "kind"]
    shards = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ids count up through each range, and ranges follow each other
    dealt = events.select(*key).repartitionByRange(shards, *key).sortWithinPartitions(*key).withColumn("chunk", F.shiftright(F.monotonically_increasing_id(), chunk_bits))
    chunks = dealt.groupBy("source", "chunk").agg(F.sort_array(F.collect_list(F.struct("ts", "seq", "kind"))).alias("events"))
    starts = F.array(*(begin(f, "ok") for f in range(most + 1)), begin(0, "quarantined"))
    outcomes = chunks.select("source", "chunk", F.transform(starts, lambda s: _after(s, F.col("events"), thresholds)).alias("out"))
    ordered = outcomes.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("chunk", "out")), lambda x, y: F.when(x["chunk"] < y["chunk"], -1).otherwise(1)).alias("chunks"))
    return ordered.select("source", F.aggregate("chunks", begin(0, "ok"), lambda s, c: _joined(s, c["out"], most)).alias("state")).select("source", "state.*")


def health_view(companies: DataFrame) -> DataFrame:
    """Each company with a board: its status is its health, or ``pending`` where its board isn't supported."""
    status = F.when(F.col("ats_type").isin(vocab.SUPPORTED_ATS), F.col("health")).otherwise("pending")
    return companies.where("ats_type != 'none'").withColumn("status", status).orderBy("priority", "name")


def health_summary(companies: DataFrame) -> DataFrame:
    """Counts by status and a map of companies by board type."""
    view = health_view(companies)
    counts = view.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("ok", "degraded", "quarantined", "pending")))
    by_ats = view.groupBy("ats_type").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("ats_type", "n")))).alias("by_ats"))
    return counts.join(F.broadcast(by_ats))  # one row each


def health_alerts(companies: DataFrame) -> DataFrame:
    """Quarantined active companies: ``company``, ``reason`` and ``since``, the day of the last success or ``never``."""
    since = F.coalesce(F.date_format("last_success_at", "yyyy-MM-dd"), F.lit("never"))
    return companies.where("active and health = 'quarantined'").select(F.col("name").alias("company"), F.col("quarantine_reason").alias("reason"), since.alias("since"))


def poll_outcome(fetched: Column, upserted: Column, failure: Column) -> Column:
    """The event of a poll: its failure, drift if rows came and none could be read, else success."""
    return F.when(failure.isNotNull(), failure).when((fetched > 0) & (upserted == 0), "schema_drift").otherwise("success")
