"""Tables in buckets, folds of polls, keyed streams, the outbox and the indexes."""

import time
from datetime import datetime, timedelta, timezone


import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope import buckets, schemas
from jobscope.operators import ingest, keywords, notify, registry, state
from jobscope.operators.dedup import assign_canonicals, start_index, update_index
from jobscope.plans.postings import postings
from jobscope.plans.state import _incoming, _stored
from jobscope.store import SnapshotConflict, newest_version, read_snapshot, write_snapshot
from jobscope.streaming import ingest as streams
from jobscope.streaming.admission import stream_admissions, stream_unseen_kids
from jobscope.streaming.health import stream_probes
from test_state import COMPANY, JOB, SF, board, posting

COLS = "company_id long, source_id string, external_id string, title string, description string, url string, location_raw string, country string, city string, categories array<string>, level string, sponsor_tier string, sponsor_evidence string, content_hash string, posted_at timestamp, seen_at timestamp"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- buckets ----
def test_a_poll_of_one_board_writes_its_own_buckets_alone(spark, tmp_path):
    root = f"file://{tmp_path}/jobs"
    first = buckets.create(_stored(spark, SF), root, ["source_id", "external_id"], 32)
    assert len(first.paths) == 32
    own = _incoming(spark, SF).where("company_id = 3")
    want = state.upsert_jobs(_stored(spark, SF), own)
    second = state.upsert_into(spark, root, own)
    touched = set(buckets.touched_by(own, first))
    assert 0 < len(touched) < 16 and {b for b in first.paths if first.paths[b] != second.paths[b]} == touched
    after = buckets.read_buckets(spark, buckets.read_version(spark, root))
    assert after.exceptAll(want.select(*after.columns)).isEmpty() and want.select(*after.columns).exceptAll(after).isEmpty()
    assert second.top == want.agg(F.max("id")).first()[0] and buckets.read_buckets(spark, buckets.read_version(spark, root, 1)).count() == _stored(spark, SF).count()
    with pytest.raises(SnapshotConflict):
        state.upsert_into(spark, root, own, number=1)


def test_small_polls_do_not_shuffle_the_stored_side(spark, tmp_path):
    root = f"file://{tmp_path}/jobs"
    version = buckets.create(_stored(spark, SF), root, ["source_id", "external_id"], 8)
    stored = buckets.read_buckets(spark, version)
    incoming = state._folded(_incoming(spark, SF).where("company_id = 1"))
    old = buckets.merge_rows(stored, incoming.withColumn("new_id", F.lit(None).cast("long")), version, *state._upsert_rules(), True)
    text = plan(old)
    assert "SortMergeJoin" not in text and "ShuffledHashJoin" not in text
    above = text[: text.index("FileScan parquet")]  # of the stored side, the first of the join
    assert "BroadcastHashJoin" in above and "Exchange" not in above


def test_large_polls_are_merged_by_shuffle_to_the_same_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "SMALL_BYTES", 0)
    root = f"file://{tmp_path}/jobs"
    buckets.create(_stored(spark, SF), root, ["source_id", "external_id"], 8)
    after = buckets.read_buckets(spark, state.upsert_into(spark, root, _incoming(spark, SF)))
    want = state.upsert_jobs(_stored(spark, SF), _incoming(spark, SF)).select(*after.columns)
    assert after.exceptAll(want).isEmpty() and want.exceptAll(after).isEmpty()


def test_tables_of_buckets_are_polled_as_snapshots_are(spark, tmp_path):
    root = f"file://{tmp_path}/jobs"
    firms = spark.createDataFrame([(7, "Acme", "greenhouse", "acme", "SE", 1, None, None, 1, True, 0, None, "ok", None)], COMPANY)
    jobs = spark.createDataFrame([], JOB)
    buckets.create(jobs, root, ["source_id", "external_id"], 8)
    polls = [([posting(1), posting(2)], None), ([posting(1, title="x")], None), ([], None), ([{"title": "no id"}], 1), ([posting(2), posting(3, content="No sponsorship.")], 4), ([], None)]
    for day, (came, fetched) in enumerate(polls, 1):
        at = datetime(2026, 1, day)
        jobs, _, want = ingest.poll(jobs, firms, board(spark, came), at, "greenhouse", 7, fetched)
        _, found = ingest.poll_table(spark, root, firms, board(spark, came), at, "greenhouse", 7, fetched)
        assert found.first() == want.first()
        after = buckets.read_buckets(spark, buckets.read_version(spark, root)).select(*jobs.columns)
        assert sorted(map(str, after.collect())) == sorted(map(str, jobs.collect()))


def test_employers_are_found_or_made_and_those_without_one_are_errors(spark, tmp_path):
    firms = spark.createDataFrame([(7, "Acme", "greenhouse", "acme", "DE", 1, None, None, 1, True, 0, None, "ok", None)], COMPANY)

    def came(*rows):
        return spark.createDataFrame([("hn", str(k), "iOS Engineer", "text", f"u{k}", "", country, None, f"h{k}", None, name, pos) for pos, (k, name, country) in enumerate(rows)], "source_id string, external_id string, title string, description string, url string, location_raw string, country string, city string, content_hash string, posted_at timestamp, company_name string, pos int")

    jobs, after, counters = ingest.poll(spark.createDataFrame([], JOB), firms, came((9, "New", "SE"), (2, "New", "US"), (3, "Acme", "US"), (4, None, "US"), (5, "", None), (6, "Nowhere", None)), datetime(2026, 1, 1), "hn", fetched=8)
    assert tuple(counters.first()) == (8, 4, 4, 0, None)
    assert {(r.name, r.priority, r.country_hq, r.ats_type) for r in after.collect()} == {("Acme", 1, "DE", "greenhouse"), ("New", 5, "SE", "none"), ("Nowhere", 5, "", "none")}
    closed = []
    for day in (2, 3):  # 3 names no employer any more: seen, so open; nothing can be read the second time, and it sweeps all the same
        jobs, after, counters = ingest.poll(jobs, after, came(*[(3, None, "US")] * (day == 2)), datetime(2026, 1, day), "hn", fetched=3)
        closed.append(tuple(counters.first()))
    assert closed == [(3, 0, 3, 0, None), (3, 0, 3, 3, None)]
    assert {r.external_id: r.consecutive_misses for r in jobs.collect()} == {"9": 2, "2": 2, "3": 1, "6": 2}


# ---- folds ----
def _poll_rows(seed, polls, keys=14):
    import random

    r, rows = random.Random(seed), []
    for day in range(1, polls + 1):
        for k in range(keys):
            if r.random() < 0.45:
                tier = r.choice([None, None, "explicit_yes", "explicit_no"])
                rows.append((day % 2 if k < 3 else 1, "hn", f"k{k}", f"t{day}", "d", "u", "", None, None, r.choice([None, ["ios"], ["ml"]]), r.choice([None, "senior"]), tier, r.choice([None, f"e{day}"]), r.choice(["h", "g"]), None, datetime(2026, 1, day)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_three_polls_in_one_batch_are_three_batches(spark, tmp_path, seed):
    rows = _poll_rows(seed, 6)
    day = lambda lo, hi: spark.createDataFrame([r for r in rows if lo <= r[-1].day <= hi], COLS)
    found = {}
    for name, cuts in (("one", [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6)]), ("many", [(1, 3), (4, 6)])):
        jobs, landing = f"file://{tmp_path}/{name}", f"file://{tmp_path}/landing-{name}"
        write_snapshot(spark.createDataFrame([], JOB), jobs)
        for lo, hi in cuts:
            day(lo, hi).write.mode("append").parquet(landing)
            streams.merge_batches(spark.readStream.schema(COLS).parquet(landing), jobs, f"file://{tmp_path}/cp-{name}", "hn").awaitTermination()
        found[name] = sorted(map(str, read_snapshot(spark, jobs).collect()))
    root = f"file://{tmp_path}/buckets"
    buckets.create(spark.createDataFrame([], JOB), root, ["source_id", "external_id"], 4)
    streams.merge_batches_into(spark.readStream.schema(COLS).parquet(f"file://{tmp_path}/landing-one"), root, f"file://{tmp_path}/cp-buckets", "hn").awaitTermination()
    assert found["one"] == found["many"] == sorted(map(str, buckets.read_buckets(spark, buckets.read_version(spark, root)).collect()))


def test_the_rest_of_a_poll_counts_as_present(spark):
    jobs = spark.createDataFrame([(1, "hn", "a", 1, None), (2, "hn", "b", 2, datetime(2026, 1, 1))], "id long, source_id string, external_id string, consecutive_misses int, closed_at timestamp")
    seen = spark.createDataFrame([("hn", "a", [datetime(2026, 1, 1)]), ("hn", "b", [datetime(2026, 1, 1)])], "source_id string, external_id string, presence array<timestamp>")
    swept = lambda polls: {r.external_id: (r.consecutive_misses, r.closed_at) for r in state.sweep_polls(jobs, seen, F.lit(True), polls).collect()}
    assert swept([]) == {"a": (0, None), "b": (0, None)}
    assert swept([datetime(2026, 1, 2)]) == {"a": (1, None), "b": (1, None)}


# ---- streams ----
def _drain(spark, df, tmp_path, name):
    """All rows of a stream that has come to its end."""
    out = []
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def keep(rows: DataFrame, number: int) -> None:
        out.extend(rows.collect())

    df.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp-{name}").trigger(availableNow=True).start().awaitTermination()
    return out


def _files(spark, tmp_path, name, batches, schema):
    """A file stream that gives each batch by itself."""
    landing = f"{tmp_path}/{name}"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{landing}")
        time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{landing}")


def test_streamed_admissions_are_those_of_the_batch(spark, tmp_path):
    begin = datetime(2026, 1, 31, 10, tzinfo=timezone.utc)
    calls = [((begin + timedelta(minutes=11 * k)).replace(tzinfo=None), (k * 37) % 400) for k in range(150)]  # January ends at 17:00 in the zone
    schema = "ts timestamp, call_id long"
    stream = _files(spark, tmp_path, "calls", [calls[k : k + 20][::-1] for k in range(0, 150, 20)], schema)
    found = _drain(spark, stream_admissions(stream, 25), tmp_path, "calls")
    want = {(r.month, r.call_id) for r in state.admit_calls(spark.createDataFrame(calls, schema), 25).where("admitted").collect()}
    assert {(r.month, r.call_id) for r in found} == want and len(found) == len(want) == 50


def test_streamed_kids_are_unseen_ones_of_the_newest_thread(spark, tmp_path):
    batches = [[("f", 10, [1, 2]), ("g", 5, [7])], [("f", 10, [1, 2, 3]), ("g", 5, [7])], [("f", 20, [4, 1]), ("f", 10, [9])], [("f", 20, [4, 1, 5]), ("f", 10, [9])]]
    stream = _files(spark, tmp_path, "threads", batches, "feed string, thread_id long, kids array<long>")
    found = [tuple(r) for r in _drain(spark, stream_unseen_kids(stream), tmp_path, "threads")]
    assert sorted(found) == [("f", 10, 1), ("f", 10, 2), ("f", 10, 3), ("f", 20, 1), ("f", 20, 4), ("f", 20, 5), ("g", 5, 7)]


def test_quarantined_sources_are_due_again_and_again(spark, tmp_path):
    schema = "source string, ts timestamp, seq long, kind string"
    at = datetime(2026, 1, 1)
    landing = f"file://{tmp_path}/events"
    rows = [("bad", at, 1, "gone"), ("bad", at, 2, "gone"), ("good", at, 3, "success"), ("mended", at, 4, "gone"), ("mended", at, 5, "gone"), ("mended", at, 6, "probe_success")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(landing)
    seen = []
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = stream_probes(spark.readStream.schema(schema).parquet(landing), every_ms=1000, thresholds={"gone": 2})
    query = stream.writeStream.foreachBatch(lambda df, n: seen.extend(df.collect())).outputMode("update").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(processingTime="300 milliseconds").start()
    try:
        end = time.time() + 60
        while sum(r.probe_due for r in seen) < 2 and time.time() < end:
            time.sleep(0.3)
    finally:
        query.stop()
    assert {r.source for r in seen if r.probe_due} == {"bad"} and sum(r.probe_due for r in seen) >= 2
    assert {(r.source, r.health) for r in seen if not r.probe_due} == {("bad", "quarantined"), ("good", "ok"), ("mended", "ok")}


# ---- outbox ----
LEDGER = "search_id long, job_canonical_id long, notified_at timestamp, match_reason string"


def _notify(spark, tmp_path, send, checkpoint):
    cols = "search_id long, job_canonical_id long, reason string"
    return streams.notify_batches(spark.readStream.schema(cols).parquet(f"file://{tmp_path}/found"), f"file://{tmp_path}/ledger", send, f"file://{tmp_path}/{checkpoint}")


def test_a_conflict_after_the_send_does_not_send_again(spark, tmp_path):
    root, sent = f"file://{tmp_path}/ledger", []
    write_snapshot(spark.createDataFrame([], LEDGER), root)
    spark.createDataFrame([(1, 1, "x"), (1, 2, "x")], "search_id long, job_canonical_id long, reason string").write.parquet(f"file://{tmp_path}/found")

    def send(rows):
        sent.extend((r.search_id, r.job_canonical_id) for r in rows.collect())
        other = spark.createDataFrame([(9, 9, None, "by another writer")], LEDGER)
        write_snapshot(read_snapshot(spark, root).unionByName(other), root)  # somebody else writes the ledger meanwhile

    _notify(spark, tmp_path, send, "cp").awaitTermination()
    assert sorted(sent) == [(1, 1), (1, 2)] and read_snapshot(spark, root).count() == 3
    _notify(spark, tmp_path, send, "cp2").awaitTermination()
    assert len(sent) == 2 and streams.open_claims(spark, root).isEmpty()


def test_a_crash_after_the_send_leaves_claims_and_a_failed_send_none(spark, tmp_path, monkeypatch):
    root, sent = f"file://{tmp_path}/ledger", []
    write_snapshot(spark.createDataFrame([], LEDGER), root)
    spark.createDataFrame([(1, 1, "x")], "search_id long, job_canonical_id long, reason string").write.parquet(f"file://{tmp_path}/found")

    def refuse(rows):
        raise RuntimeError("no network")

    with pytest.raises(Exception):  # noqa: B017, PT011
        _notify(spark, tmp_path, refuse, "cp").awaitTermination()
    assert streams.open_claims(spark, root).isEmpty()
    monkeypatch.setattr(streams, "insert_ignore", lambda *a: 1 / 0)
    with pytest.raises(Exception):  # noqa: B017, PT011
        _notify(spark, tmp_path, lambda rows: sent.extend(rows.collect()), "cp").awaitTermination()
    monkeypatch.undo()
    for _ in range(2):
        _notify(spark, tmp_path, lambda rows: sent.extend(rows.collect()), "cp").awaitTermination()
    assert len(sent) == 1 and [(r.search_id, r.job_canonical_id) for r in streams.open_claims(spark, root).collect()] == [(1, 1)]


def test_the_streams_twin_needs_no_ledger(spark, tmp_path):
    at = datetime(2026, 1, 1)
    stream = _files(spark, tmp_path, "twin", [[(1, 1, at), (1, 1, at)], [(1, 1, at + timedelta(minutes=5)), (1, 2, at)]], "search_id long, job_canonical_id long, found_at timestamp")
    found = _drain(spark, streams.new_matches(stream, "1 hour"), tmp_path, "twin")
    assert sorted((r.search_id, r.job_canonical_id) for r in found) == [(1, 1), (1, 2)]


# ---- incremental dedup ----
def test_polls_of_duplicates_end_as_all_postings_compared(spark):
    import random

    r = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(r.choice(words) for _ in range(40)) for _ in range(6)]

    def variant():
        w = r.choice(texts).split()
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = r.choice(words)
        return " ".join(w)

    make = lambda ids: [(k, k % 2, f"Role {k % 3}", r.choice([None, "SE"]), variant()) for k in ids]
    schema = "id long, company_id long, title string, country string, description string"
    stored: dict[int, tuple] = {}
    index = start_index(spark.createDataFrame(first := make(range(100, 220)), schema))
    stored |= {x[0]: x for x in first}
    for step in range(3):
        changed = make(r.sample(sorted(stored), 25)) + make(range(300 + 40 * step, 330 + 40 * step)) + make(range(10 * step, 10 * step + 5))
        gone = r.sample([k for k in sorted(stored) if k not in {x[0] for x in changed}], 12)
        index = update_index(index, spark.createDataFrame(changed, schema), spark.createDataFrame([(k,) for k in gone], "id long"))
        stored = {k: x for k, x in stored.items() if k not in gone} | {x[0]: x for x in changed}
        want = {tuple(x) for x in assign_canonicals(spark.createDataFrame(list(stored.values()), schema)).collect()}
        found = [tuple(x) for x in index.labels.collect()]
        assert len(found) == len(stored) and set(found) == want
        assert any(a != b for a, b in want) and len({b for _, b in want}) > 5


def test_links_of_an_index_stay_few_where_many_postings_of_a_block_are_near(spark, monkeypatch):
    """Chunks of a block leave fewer links than fingerprints, not all pairs, and the clusters are those of all pairs."""
    import random

    from jobscope.operators import dedup

    links, join = [], dedup.connected_components
    monkeypatch.setattr(dedup, "FEW", 8, raising=False)
    monkeypatch.setattr(dedup, "CHUNK", 64, raising=False)
    monkeypatch.setattr(dedup, "connected_components", lambda edges: links.append(edges.count()) or join(edges))
    r = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    texts = [[r.choice(words) for _ in range(120)] for _ in range(4)]

    def make(ids):
        rows = []
        for k in ids:
            w = list(r.choice(texts))
            for _ in range(r.randrange(12)):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((k, 1, "Role", r.choice([None] * 9 + ["SE"]), " ".join(w)))
        return rows

    schema = "id long, company_id long, title string, country string, description string"
    stored = {x[0]: x for x in make(range(100, 400))}
    index = start_index(spark.createDataFrame(list(stored.values()), schema))
    for changed, gone in ((make([*range(90), *range(100, 400, 5)]), range(101, 400, 9)), (make(range(400, 410)), range(0))):
        index = update_index(index, spark.createDataFrame(changed, schema), spark.createDataFrame([(k,) for k in gone], "id long"))
        stored = {k: x for k, x in stored.items() if k not in gone} | {x[0]: x for x in changed}
    of_index, jobs = list(links), spark.createDataFrame(list(stored.values()), schema)
    assert {tuple(x) for x in index.labels.collect()} == {tuple(x) for x in assign_canonicals(jobs).collect()}
    assert max(of_index) < len(stored) * (len(stored) // 64 + 2) < links[-1] / 2


# ---- indexes ----
def test_searches_are_looked_up_by_their_rarest_criterion(spark):
    jobs = postings(spark, SF)
    searches = spark.createDataFrame([(1, "a", '{"countries": ["SE"], "levels": ["senior"]}'), (2, "b", '{"q": "Kubernetes"}'), (3, "c", '{"categories": ["ios", "backend"]}')], "id long, name string, filters_json string")
    hits = notify.search_hits(searches, jobs)
    text = plan(hits)
    assert "BroadcastHashJoin" in text and "CartesianProduct" not in text
    nested = [x for x in text.split("\n") if "BroadcastNestedLoopJoin" in x]
    assert len(nested) <= 2  # those that nothing restricts: none here, and the plan shows an empty side
    assert hits.groupBy("search_id", "id").count().where("count > 1").isEmpty() and hits.where("search_id = 3").count() > 0
    index = {r.search_id: r["keys"] for r in notify._indexed(searches.select(F.col("id").alias("search_id"), F.col("name").alias("search"), notify.parse_filters(F.col("filters_json")).alias("f")), jobs).collect()}
    assert index[2] == ["q:kubernetes"] and set(index[3]) == {"categories:ios", "categories:backend"} and index[1] in (["countries:SE"], ["levels:senior"])


def test_a_keyword_reads_its_postings_alone(spark, tmp_path):
    from pyspark.sql import Observation

    root = f"file://{tmp_path}/index"
    rows = [(k, f"title {k}", ("needle %d in the hay" % k if k in (17, 1800) else "plain hay %d" % k) + " x" * 50) for k in range(2000)]
    keywords.build_index(spark.createDataFrame(rows, "id long, title string, description string"), root)
    found = keywords.keyword_jobs(spark, root, "NEEDLE%hay")
    assert {r.id for r in found.collect()} == {17, 1800}
    filters = plan(found).split("PushedFilters: ")[1].split("]")[0]
    assert "And(GreaterThanOrEqual(id,17),LessThanOrEqual(id,17))" in filters and "GreaterThanOrEqual(id,1800)" in filters
    assert keywords._stretches([1, 2, 3, 900]) == [(1, 1), (2, 2), (3, 3), (900, 900)]
    assert len(keywords._stretches(list(range(0, 10_000, 7)))) == keywords.STRETCHES
    for q in ("needle", "e 17 i", "hay 5", "zzz", "%", "a", "hay_x", "titlE 19"):
        want = {r.id for r in spark.createDataFrame(rows, "id long, title string, description string").where(keywords.like_ascii(F.col("title"), q) | keywords.like_ascii(F.col("description"), q)).collect()}
        assert {r.id for r in keywords.keyword_jobs(spark, root, q).collect()} == want, q
    seen = Observation()
    read = spark.read.parquet(f"{root}/jobs").where("(id BETWEEN 17 AND 17) OR (id BETWEEN 1800 AND 1800)").observe(seen, F.count(F.lit(1)).alias("n"))
    assert read.count() == 2 and seen.get["n"] == 2


def test_registers_are_recorded_and_empty_ones_too(spark):
    meta = spark.createDataFrame([("UK", datetime(2025, 1, 1), 9), ("AU", datetime(2025, 1, 1), 3)], schemas.REGISTRIES_META)
    after = registry.record_registers(meta, spark.createDataFrame([("UK",), ("UK",)], "registry string"), ["UK", "NL"], datetime(2026, 1, 1))
    assert {tuple(r) for r in after.collect()} == {("UK", datetime(2026, 1, 1), 2), ("NL", datetime(2026, 1, 1), 0), ("AU", datetime(2025, 1, 1), 3)}
    assert newest_version(spark, "file:///tmp/no-such-table") == 0


# ---- scores ----
def test_only_missing_scores_are_worked_out(spark):
    from jobscope.operators import fit

    jobs = spark.createDataFrame([(k, "new" if k in (5, 9) else "h") for k in range(40)], "id long, content_hash string")
    valid = spark.createDataFrame([(r, k) for r in ("r1", "r2") for k in range(40) if k not in (5, 9) and (r, k) != ("r2", 7)] + [("r3", 1)], "resume_hash string, id long")
    profiles = spark.createDataFrame([("r1",), ("r2",), ("r3",), ("r4",)], "resume_hash string")
    found = [tuple(x) for x in fit._unscored(valid, jobs, profiles).collect()]
    want = {("r1", 5), ("r1", 9), ("r2", 5), ("r2", 9), ("r2", 7)} | {("r3", k) for k in range(40) if k != 1} | {("r4", k) for k in range(40)}
    assert len(found) == len(want) and set(found) == want
    assert fit._unscored(valid, jobs.limit(0), profiles).count() == 0 and fit._unscored(valid.limit(0), jobs, profiles.limit(0)).count() == 0


def test_probes_leave_the_health_of_the_batch(spark, tmp_path):
    from jobscope.operators.health import fold_health

    at, kinds = datetime(2026, 1, 1), ["gone", "unreachable", "success", "probe_success", "schema_drift", "gone", "other"]
    rows = [(f"s{k % 5}", at + timedelta(minutes=k), k, kinds[(k * k + k // 3) % 7]) for k in range(120)]
    schema = "source string, ts timestamp, seq long, kind string"
    limits = {"gone": 2, "schema_drift": 3, "unreachable": 4}
    stream = stream_probes(_files(spark, tmp_path, "health", [rows[:50], rows[50:]], schema), every_ms=10**9, thresholds=limits)
    want = {tuple(r) for r in fold_health(spark.createDataFrame(rows, schema), limits).select("source", "failures", "health", "reason", "last_success").collect()}
    last = {}
    # a query with timers of processing time has no end of its own
    query = stream.writeStream.foreachBatch(lambda df, n: last.update({r.source: tuple(r)[:5] for r in df.collect()})).outputMode("update").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + 60
        while set(last.values()) != want and time.time() < end:
            time.sleep(0.3)
    finally:
        query.stop()
    assert set(last.values()) == want
