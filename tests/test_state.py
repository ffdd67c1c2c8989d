"""Snapshots, merges, health and streams."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from jobscope import schemas
from jobscope.operators import fit, ingest, notify, registry, search, state
from jobscope.operators.components import connected_components
from jobscope.operators.dedup import assign_canonicals, dedup_summary, link_canonicals, near_pairs, written_fingerprints
from jobscope.operators.health import fold_health, health_view
from jobscope.plans.feeds import batch_health, stream_events_equal_batch
from jobscope.plans.postings import companies, postings
from jobscope.sources.boards import COMPANY_BOARDS
from jobscope.sources.registers import nl_entries, read_csv, uk_entries
from jobscope.store import SnapshotConflict, newest_version, read_snapshot, with_ids, write_snapshot
from jobscope.streaming.ingest import merge_batches, notify_batches

SF = "/root/testdata/sf0.001"
JOB, COMPANY = schemas.JOBS, schemas.COMPANIES


def board(spark, jobs):
    import json

    return COMPANY_BOARDS["greenhouse"](spark.createDataFrame([("Acme", json.dumps({"jobs": jobs}))], "company_name string, body string"))


def posting(n, title="iOS Engineer", content="We sponsor visas.", place="Stockholm, Sweden"):
    return {"id": n, "title": title, "absolute_url": f"https://a/{n}", "location": {"name": place}, "first_published": "2026-01-01T00:00:00Z", "content": content}


def test_polls_merge_classify_and_sweep(spark):
    jobs = spark.createDataFrame([], JOB)
    firms = spark.createDataFrame([(7, "Acme", "greenhouse", "acme", "SE", 1, None, None, 1, True, 0, None, "ok", None)], COMPANY)
    jobs, _, counters = ingest.poll(jobs, firms, board(spark, [posting(1), posting(2, content="plain")]), datetime(2026, 1, 1), "greenhouse", 7)
    rows = {r.external_id: r for r in jobs.collect()}
    assert rows["1"].sponsor_tier == "explicit_yes" and rows["1"].categories == ["ios"] and rows["1"].country == "SE"
    assert rows["2"].sponsor_tier == "registry_inferred" and tuple(counters.first()) == (2, 2, 0, 0, None) and {r.id for r in jobs.collect()} == {1, 2}
    jobs = jobs.withColumn("user_status", F.lit("starred"))
    for day in (2, 3):  # 2 is absent twice; 1 is there with a changed title alone, then with a changed text
        text = "We sponsor visas." if day == 2 else "No sponsorship."
        jobs, _, _ = ingest.poll(jobs, firms, board(spark, [posting(1, title=f"Title {day}", content=text)]), datetime(2026, 1, day), "greenhouse", 7)
        rows = {r.external_id: r for r in jobs.collect()}
        if day == 2:
            assert (rows["1"].user_status, rows["1"].categories, rows["1"].title) == ("starred", ["ios"], "Title 2")
            assert (rows["2"].consecutive_misses, rows["2"].closed_at) == (1, None)
    assert (rows["1"].user_status, rows["1"].sponsor_tier, rows["1"].categories) == ("new", "explicit_no", [])
    assert rows["2"].consecutive_misses == 2 and rows["2"].closed_at == datetime(2026, 1, 3)
    jobs, _, _ = ingest.poll(jobs, firms, board(spark, [posting(2, content="plain")]), datetime(2026, 1, 4), "greenhouse", 7)
    two = jobs.where("external_id = '2'").first()
    assert (two.closed_at, two.consecutive_misses) == (None, 0)
    assert ingest.backfill(jobs.withColumn("categories", F.lit(None).cast("array<string>"))).where("categories is null").isEmpty()


def test_a_drifted_poll_closes_nothing_and_an_empty_one_sweeps(spark):
    firms = spark.createDataFrame([(7, "Acme", "greenhouse", "acme", "SE", 1, None, None, 1, True, 0, None, "ok", None)], COMPANY)
    jobs, _, _ = ingest.poll(spark.createDataFrame([], JOB), firms, board(spark, [posting(1), posting(2)]), datetime(2026, 1, 1), "greenhouse", 7)
    nothing = board(spark, [{"title": "no id"}, {"id": 3}])
    for day in (2, 3):
        jobs, _, counters = ingest.poll(jobs, firms, nothing, datetime(2026, 1, day), "greenhouse", 7, fetched=2)
        assert tuple(counters.first()) == (2, 0, 2, 0, "schema_drift")
    assert {(r.consecutive_misses, r.closed_at) for r in jobs.collect()} == {(0, None)}
    jobs, _, counters = ingest.poll(jobs, firms, board(spark, [posting(1)]), datetime(2026, 1, 4), "greenhouse", 7, fetched=3)
    assert tuple(counters.first()) == (3, 1, 2, 0, None)
    closed = []
    for day in (5, 6):
        jobs, _, counters = ingest.poll(jobs, firms, board(spark, []), datetime(2026, 1, day), "greenhouse", 7)
        closed.append(counters.first().closed)
    assert closed == [1, 1] and jobs.where("closed_at is null").isEmpty()
    assert {(r.external_id, r.id) for r in jobs.collect()} == {("1", 1), ("2", 2)}


def test_two_writers_of_one_version_conflict(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert newest_version(spark, root) == 0
    write_snapshot(spark.range(1), root)
    seen = newest_version(spark, root)
    write_snapshot(spark.range(2), root, seen)
    with pytest.raises(SnapshotConflict):
        write_snapshot(spark.range(3), root, seen)
    assert read_snapshot(spark, root).count() == 2 and read_snapshot(spark, root, 1).count() == 1 and newest_version(spark, root) == 2


def test_new_employers_get_rows(spark):
    firms = spark.createDataFrame([(7, "Acme", "greenhouse", "acme", "SE", 0, None, None, 1, True, 0, None, "ok", None)], COMPANY)
    after = state.get_or_create_companies(firms, spark.createDataFrame([("Beta",), ("Acme",), ("Beta",), ("Alpha",), (None,), ("",)], "name string"))
    assert {(r.id, r.name) for r in after.collect()} == {(7, "Acme"), (8, "Alpha"), (9, "Beta")}
    seeds = spark.createDataFrame([("Acme", "lever", "acme", "SE", 2), ("New", "ashby", "new", "US", 1)], "name string, ats_type string, ats_slug string, country_hq string, priority int")
    merged = {r.name: r for r in state.upsert_companies(firms.withColumns({"health": F.lit("quarantined"), "consecutive_failures": F.lit(4)}), seeds).collect()}
    assert (merged["Acme"].ats_type, merged["Acme"].health, merged["Acme"].consecutive_failures) == ("lever", "ok", 0) and merged["New"].active and (merged["Acme"].id, merged["New"].id) == (7, 8)


def test_ids_are_consecutive(spark):
    rows = spark.range(500).select(F.xxhash64("id").alias("x"))
    numbered = with_ids(rows, 11, ["x"]).orderBy("x").collect()
    assert [r.id for r in numbered] == list(range(11, 511))


def test_registers_keep_the_manual_bit(spark):
    firms = spark.createDataFrame([(1, "A", "", "", "", 8, 1.0, "MANUAL: x", 1, True, 0, None, "ok", None), (2, "B", "", "", "", 8, 1.0, "MANUAL: y", 1, True, 0, None, "ok", None), (3, "C", "", "", "", 1, 1.0, "UK r", 1, True, 0, None, "ok", None)], COMPANY)
    found = spark.createDataFrame([("B", 1, 0.9, "UK Skilled")], "seed string, flags int, confidence double, evidence string")
    jobs = spark.createDataFrame([(1, 3, "registry_inferred"), (2, 3, "explicit_no"), (3, 1, "unknown")], "id long, company_id long, sponsor_tier string")
    new, tiers = registry.refresh(firms, jobs, found)
    assert [(r.name, r.registry_flags, r.match_confidence, r.match_evidence) for r in new.orderBy("id").collect()] == [("A", 8, 1.0, "MANUAL: x"), ("B", 9, 1.0, "UK Skilled"), ("C", 0, None, None)]
    assert [r.sponsor_tier for r in tiers.orderBy("id").collect()] == ["unknown", "explicit_no", "registry_inferred"]
    flagged = registry.flag_manual(firms, "C", "told so", "2026-01-01").where("name = 'C'").first()
    assert (flagged.registry_flags, flagged.match_evidence) == (9, "MANUAL: told so (flagged 2026-01-01)")
    with pytest.raises(ValueError):
        registry.flag_manual(firms, "nobody", "", "")


def test_csv_registers(spark, tmp_path):
    (tmp_path / "uk.csv").write_bytes('﻿Organisation Name,Town/City,Route\r\n Acme Ltd ,X,Skilled\r\nACME LTD,Y,Other\r\n,,\r\n"Beta, Inc t/a Bee",Z,R\r\n'.encode())
    assert [(r.name, r.aliases, r.evidence) for r in uk_entries(read_csv(spark, str(tmp_path / "uk.csv"))).orderBy("pos").collect()] == [("Acme Ltd", [], "Skilled"), ("Beta, Inc", ["Bee"], "R")]
    (tmp_path / "nl.csv").write_text('Organisation,KvK number\n"A, B",01234\n')
    assert nl_entries(read_csv(spark, str(tmp_path / "nl.csv"))).first().evidence == "KvK 01234"


def test_dedup_is_idempotent_and_null_safe(spark):
    text = "we build payments with rust and postgres for merchants " * 8
    rows = [(3, 1, "Engineer", None, text), (1, 1, " engineer ", None, text), (2, 1, "Engineer", "SE", text), (5, 2, "Engineer", None, text), (6, 1, "Engineer", None, "sell shoes by the sea " * 9)]
    jobs = spark.createDataFrame(rows, "id long, company_id long, title string, country string, description string")
    found = assign_canonicals(jobs)
    assert {(r.id, r.canonical) for r in found.collect()} == {(1, 1), (3, 1), (2, 2), (5, 5), (6, 6)}
    linked = link_canonicals(jobs, found)
    assert {r.id: r.canonical_id for r in linked.collect()} == {1: None, 2: None, 3: 1, 5: None, 6: None}
    assert tuple(dedup_summary(assign_canonicals(linked)).first()) == (1, 1)


def test_a_poll_merges_without_texts(spark, monkeypatch):
    """Merge and sweep go without the texts; each posting has its own afterwards, stored ones the poll didn't bring included."""
    merged, firms = [], spark.createDataFrame([(7, "Acme", "greenhouse", "acme", "SE", 1, None, None, 1, True, 0, None, "ok", None)], COMPANY)
    monkeypatch.setattr(ingest, "upsert_jobs", lambda stored, incoming: merged.extend((stored, incoming)) or state.upsert_jobs(stored, incoming))
    jobs, _, _ = ingest.poll(spark.createDataFrame([], JOB), firms, board(spark, [posting(1, content="first text"), posting(2, content="second text")]), datetime(2026, 1, 1), "greenhouse", 7)
    jobs, _, _ = ingest.poll(jobs, firms, board(spark, [posting(2, content="changed text"), posting(3, content="third text")]), datetime(2026, 1, 2), "greenhouse", 7)
    assert {r.external_id: r.description for r in jobs.collect()} == {"1": "first text", "2": "changed text", "3": "third text"}
    assert len(merged) == 4 and not any("text" in r.description for df in merged for r in df.collect())


def test_segments_meet_by_shuffle(spark):
    """However few the fingerprints are, their segments, 45 to each, aren't sent through the driver."""
    jobs = spark.createDataFrame([(k, 1, "a", "SE", f"text {k}") for k in range(4)], "id long, company_id long, title string, country string, description string")
    plan = near_pairs(written_fingerprints(jobs))._jdf.queryExecution().sparkPlan().toString()
    joins = [x for x in plan.splitlines() if "Join [" in x and "place" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 1)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_mixed_streaks_use_the_current_threshold(spark):
    kinds = ["unreachable"] * 9 + ["gone"] + ["success"] + ["probe_failure"] + ["probe_success"] + ["gone"] * 2
    ts = datetime(2026, 1, 1)
    for n, want in ((9, (9, "degraded", "unreachable")), (10, (10, "quarantined", "gone")), (11, (10, "quarantined", "gone")), (13, (0, "ok", None)), (15, (2, "degraded", "gone"))):
        events = spark.createDataFrame([("s", ts, i, k) for i, k in enumerate(kinds[:n])], "source string, ts timestamp, seq long, kind string")
        r = fold_health(events).first()
        assert (r.failures, r.health, r.reason) == want
    assert health_view(companies(spark, SF)).where("status = 'pending'").count() > 0


def test_stream_equals_batch(spark):
    a, b = stream_events_equal_batch(spark, SF), batch_health(spark, SF)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_stream_merge_can_run_again(spark, tmp_path):
    jobs, landing = f"file://{tmp_path}/jobs", f"file://{tmp_path}/landing"
    write_snapshot(spark.createDataFrame([], JOB), jobs)
    cols = "company_id long, source_id string, external_id string, title string, description string, url string, location_raw string, country string, city string, categories array<string>, level string, sponsor_tier string, sponsor_evidence string, content_hash string, posted_at timestamp, seen_at timestamp"
    for day, ids in ((1, "ab"), (2, "a"), (3, "a")):
        rows = [(1, "hn", x, "t", "d", "u", "", None, None, None, None, None, None, "h", None, datetime(2026, 1, day)) for x in ids]
        spark.createDataFrame(rows, cols).write.mode("append").parquet(landing)
        merge_batches(spark.readStream.schema(cols).parquet(landing), jobs, f"file://{tmp_path}/cp", "hn").awaitTermination()
    found = {r.external_id: r for r in read_snapshot(spark, jobs).collect()}
    assert found["a"].consecutive_misses == 0 and found["b"].closed_at == datetime(2026, 1, 3)
    again = f"file://{tmp_path}/cp2"  # the same files once more, as after a lost checkpoint
    merge_batches(spark.readStream.schema(cols).parquet(landing), jobs, again, "hn").awaitTermination()
    assert {r.external_id: r.consecutive_misses for r in read_snapshot(spark, jobs).collect()} == {"a": 0, "b": 2}


def test_matches_are_sent_once(spark, tmp_path):
    root, landing, sent = f"file://{tmp_path}/ledger", f"file://{tmp_path}/found", []
    write_snapshot(spark.createDataFrame([], "search_id long, job_canonical_id long, notified_at timestamp, match_reason string"), root)
    cols = "search_id long, job_canonical_id long, reason string"
    fail = {"now": True}

    def send(rows):
        if fail["now"]:
            raise RuntimeError("no network")
        sent.extend((r.search_id, r.job_canonical_id) for r in rows.collect())

    spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (1, 1, "x")], cols).write.parquet(landing)
    source = lambda: spark.readStream.schema(cols).parquet(landing)
    with pytest.raises(Exception):  # noqa: B017, PT011
        notify_batches(source(), root, send, f"file://{tmp_path}/cp").awaitTermination()
    assert read_snapshot(spark, root).isEmpty()
    fail["now"] = False
    for cp in ("cp", "cp2"):
        notify_batches(source(), root, send, f"file://{tmp_path}/{cp}").awaitTermination()
    assert sorted(sent) == [(1, 1), (1, 2)]


def test_resumes_are_reused_and_one_is_active(spark):
    none = spark.createDataFrame([], "id long, label string, source_text string, target_countries array<string>, resume_hash string, active boolean, created_at timestamp")
    a = fit.add_resume(none, "swift", "first", ["SE"], datetime(2026, 1, 1))
    b = fit.add_resume(fit.add_resume(a, "rust", "second", [], datetime(2026, 1, 2)), "swift", "other label", ["US"], datetime(2026, 1, 3))
    assert [(r.id, r.label, r.active) for r in b.orderBy("id").collect()] == [(1, "first", True), (2, "second", False)]


def test_filters_and_pages(spark):
    jobs = spark.createDataFrame([("100% \\ é_x",), ("ABC",)], "t string")
    keep = lambda q: {r.t for r in jobs.where(search.like_ascii(F.col("t"), q)).collect()}
    assert keep("a_c") == {"ABC"} and keep("\\") == {"100% \\ é_x"} and keep("É") == set() and keep("%") == {"ABC", "100% \\ é_x"}
    with pytest.raises(ValueError):
        search.JobFilters(limit=0)
    detail = search.job_detail(postings(spark, SF), companies(spark, SF).withColumns({"match_confidence": F.lit(1.0), "match_evidence": F.lit("e")}), 11)
    assert all(r.id == 10 and len(r.sources) == 2 for r in detail.collect())
    parsed = spark.createDataFrame([('{"q": "x", "levels": ["lead"]}',), ("{}",)], "j string").select(notify.parse_filters(F.col("j")).alias("f")).collect()
    assert parsed[0].f.levels == ["lead"] and parsed[1].f.countries == []


def test_searches_beyond_one_broadcast_and_wildcards(spark):
    jobs = postings(spark, SF)
    searches = spark.createDataFrame([(n, f"s{n}", '{"q": "K_bern%RUST"}' if n % 2 else '{"q": "a\\\\b"}') for n in range(40)], "id long, name string, filters_json string")
    wanted = jobs.where("canonical_id is null").where(search.like_ascii(F.col("title"), "K_bern%RUST") | search.like_ascii(F.col("description"), "K_bern%RUST")).count()
    found = notify.search_hits(searches, jobs, max_searches=7).groupBy("search_id").count().collect()
    assert wanted > 0 and {r.search_id: r["count"] for r in found} == {n: wanted for n in range(1, 40, 2)}
    with pytest.raises(ValueError):
        search.JobFilters(limit=201)


def test_the_first_calls_of_a_month_are_admitted(spark):
    calls = spark.range(5000).select(F.timestamp_seconds(1_700_000_000 + (F.col("id") * 7919) % 5000 * 3600).alias("ts"), F.col("id").alias("call_id"))
    found = state.admit_calls(calls, 100).collect()
    for month in {r.month for r in found}:
        own = sorted((r.ts, r.call_id, r.admitted) for r in found if r.month == month)
        assert [r[2] for r in own] == [k < 100 for k in range(len(own))]


def test_fingerprints_need_no_shuffle_and_near_pairs_are_all_found(spark):
    import random

    from jobscope.operators.dedup import fingerprints, near_pairs

    plan = fingerprints(postings(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    r, rows = random.Random(2), []
    for _ in range(300):
        base = r.getrandbits(64)
        for _ in range(2):
            f = base
            for k in r.sample(range(64), r.randrange(11)):
                f ^= 1 << k
            rows.append((len(rows), len(rows) // 50, "t", None if len(rows) % 100 < 50 else "SE", f - (1 << 64) if f >> 63 else f))
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1:4] == b[1:4] and ((a[4] ^ b[4]) & (1 << 64) - 1).bit_count() <= 8}
    found = [tuple(x) for x in near_pairs(spark.createDataFrame(rows, "id long, company_id long, title_key string, country string, fingerprint long")).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_matches_keep_the_first_of_each_search_before_the_shuffle(spark):
    plan = notify.matches(spark.createDataFrame([(1, "a", "{}")], "id long, name string, filters_json string"), postings(spark, SF), 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from jobscope.store import shared_dir

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_dir(far)


def test_every_pattern_holds_a_signal_word(spark):
    from jobscope import vocab
    from jobscope.functions.classify import with_sponsorship

    assert all(any(w in p.replace("[sz]", "s").replace("authoris", "authori") for w in vocab.SIGNAL_WORDS) for p in vocab.NO_PATTERNS + vocab.YES_PATTERNS)
    texts = ["No SPONSORSHIP here.", "We are AUTHORISED to work.", "authorized to work only", "Happy to Sponsor!", "nothing"]
    found = with_sponsorship(spark.createDataFrame(list(enumerate(texts)), "n int, t string"), "t").orderBy("n").collect()
    assert [r.text_tier for r in found] == ["explicit_no", "explicit_no", "explicit_no", "explicit_yes", None]


def test_every_profile_is_matched(spark):
    resumes = spark.range(1003).select(F.col("id").cast("string").alias("resume_hash"), F.lit("Senior Swift developer").alias("source_text"), F.array(F.lit("SE")).alias("target_countries"))
    found = fit.deep_match(postings(spark, SF).limit(2), fit.build_profiles(resumes))
    assert found.select("resume_hash").distinct().count() == 1003


def test_a_source_is_folded_in_chunks(spark):
    import random

    r, limits = random.Random(4), {"gone": 3, "schema_drift": 2, "unreachable": 5}
    kinds, rows, want = [*limits, *limits, "success", "probe_success", "probe_failure", None], [], {}
    for source in ["a", "b", "c", "d", None]:
        failures, health, reason, last = 0, "ok", None, None
        for i in range(r.choice((1, 60, 97))):
            kind, ts = r.choice(kinds if source != "c" else [*limits, "probe_failure", None]), datetime(2026, 1, 1, i // 60, i % 60)
            rows.append((source, ts, i, kind))
            if kind == "probe_success" or (kind == "success" and health != "quarantined"):
                failures, health, reason, last = 0, "ok", None, ts
            elif health != "quarantined" and kind not in ("success", "probe_failure"):
                failures, reason = failures + 1, kind
                health = "quarantined" if kind and failures >= limits[kind] else "degraded"
        want[source] = (failures, health, reason, last)
    r.shuffle(rows)
    events = spark.createDataFrame(rows, "source string, ts timestamp, seq long, kind string")
    for bits in (0, 2, 14):
        found = {x.source: tuple(x)[1:] for x in fold_health(events, limits, bits).collect()}
        assert {k: v[:3] for k, v in found.items()} == {k: v[:3] for k, v in want.items()}
        assert {k: v[3] for k, v in found.items()} == {k: v[3] for k, v in want.items()}


def test_equal_searches_are_looked_up_once(spark, monkeypatch):
    asked, hits = [], notify.search_hits
    monkeypatch.setattr(notify, "search_hits", lambda searches, jobs: asked.append(searches.count()) or hits(searches, jobs))
    searches = spark.createDataFrame([(n, f"s{n}", '{"countries": ["SE"]}' if n % 2 else None) for n in range(40)], "id long, name string, filters_json string")
    jobs = spark.createDataFrame([(1, "a", "b", "SE", ["ios"], "senior", "unknown", None), (2, "a", "b", "DE", [], "senior", "unknown", None)], "id long, title string, description string, country string, categories array<string>, level string, sponsor_tier string, canonical_id long")
    found = {r.search_id: (r.n, r.ids) for r in notify.search_totals(searches, jobs).collect()}
    assert asked == [2] and all(found[n] == ((1, 1) if n % 2 else (2, 3)) for n in range(40))
