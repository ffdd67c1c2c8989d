"""Employers against sponsor registers, by equal sets of distinctive words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobscope import vocab
from jobscope.functions.classify import resolve_tier
from jobscope.functions.names import name_core, name_key, name_variants
from jobscope.store import written


def _keyed(df: DataFrame, keep: list[str], names) -> DataFrame:  # noqa: ANN001
    one = df.select(*keep, F.explode(names).alias("name"))
    keyed = one.select(*keep, F.array_join(name_key(F.col("name")), " ").alias("key"), F.array_join(name_core(F.col("name")), " ").alias("core"))
    return keyed.where("key != ''").distinct()


def match_entries(seeds: DataFrame, entries: DataFrame) -> DataFrame:
    """The best entry of each register for each seed: ``seed``, ``registry``, ``confidence``, ``evidence``, ``pos``.

    ``seeds``: seed. ``entries``: registry, pos (place in its file), name, aliases, evidence. Names
    become keys once on either side, so this is a hash join, not a comparison of all pairs; ties go
    to the entry that stands first.
    """
    wanted = _keyed(seeds.select("seed"), ["seed"], name_variants(F.col("seed")))
    listed = _keyed(entries, ["registry", "pos", "evidence"], F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    met = wanted.alias("w").join(listed.alias("l"), F.col("w.key") == F.col("l.key"))
    confidence = F.when(F.col("w.core") == F.col("l.core"), vocab.FULL_CONFIDENCE).otherwise(vocab.STRIPPED_CONFIDENCE)
    each = met.groupBy("seed", "registry", "pos").agg(F.max(confidence).alias("confidence"), F.min("l.evidence").alias("evidence"))
    best = each.groupBy("seed", "registry").agg(F.max_by(F.struct("confidence", "evidence", "pos"), F.struct("confidence", (-F.col("pos")).alias("p"))).alias("b"))
    return best.select("seed", "registry", "b.confidence", "b.evidence", "b.pos")


def rollup_matches(matches: DataFrame) -> DataFrame:
    """One verdict for each seed: ``flags`` (bits OR-ed), best ``confidence``, ``evidence`` in the registers' order."""
    bit = F.lit(None).cast("int")
    for name, value in vocab.REGISTRY_BITS.items():
        bit = F.when(F.col("registry") == name, value).otherwise(bit)
    reason = F.concat(F.col("registry"), F.lit(" "), F.coalesce("evidence", F.format_string("%.2f", "confidence")))
    lines = F.sort_array(F.collect_list(F.struct(bit.alias("bit"), reason.alias("reason"))))
    return matches.groupBy("seed").agg(F.bit_or(bit).alias("flags"), F.max("confidence").alias("confidence"), F.array_join(F.transform(lines, lambda x: x["reason"]), "; ").alias("evidence"))


def refresh(companies: DataFrame, jobs: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New snapshots of companies and jobs after the registers were read again.

    The manual bit stays; a company with that bit alone is left as it is unless a register names it,
    and then has full confidence with the register's evidence. Tiers that a posting states stay.
    """
    manual = vocab.REGISTRY_BITS["MANUAL"]
    found = companies.alias("c").join(matches.alias("m"), F.col("c.name") == F.col("m.seed"), "left")
    machine, kept = F.coalesce(F.col("m.flags"), F.lit(0)), F.col("c.registry_flags").bitwiseAND(manual)
    skip = (machine == 0) & (kept != 0)
    flags = F.when(skip, F.col("c.registry_flags")).otherwise(machine.bitwiseOR(kept))
    changed = {
        "registry_flags": flags,
        "match_confidence": F.when(skip, F.col("c.match_confidence")).when(kept != 0, vocab.FULL_CONFIDENCE).otherwise(F.col("m.confidence")),
        "match_evidence": F.when(skip, F.col("c.match_evidence")).otherwise(F.col("m.evidence")),
    }
    new = found.select(*(changed.get(c, F.col(f"c.{c}")).alias(c) for c in companies.columns))
    by_company = new.select(F.col("id").alias("_c"), F.col("registry_flags").alias("_flags"))
    tier = F.when(F.col("_c").isNull() | F.col("sponsor_tier").isin("explicit_yes", "explicit_no"), F.col("sponsor_tier")).otherwise(resolve_tier(F.lit(None).cast("string"), F.col("_flags")))
    return new, jobs.join(by_company, F.col("company_id") == F.col("_c"), "left").withColumn("sponsor_tier", tier).drop("_c", "_flags")


def record_registers(meta: DataFrame, entries: DataFrame, registers: list[str], at) -> DataFrame:  # noqa: ANN001
    """Metadata (registry, fetched_at, row_count) after ``registers`` were read at a time: theirs is new, that of others stays."""
    read = meta.sparkSession.createDataFrame([(r,) for r in registers], "registry string")
    sizes = entries.groupBy("registry").agg(F.count(F.lit(1)).alias("n"))
    fresh = read.join(sizes, "registry", "left").select("registry", F.lit(at).cast("timestamp").alias("fetched_at"), F.coalesce("n", F.lit(0)).cast("long").alias("row_count"))
    return meta.join(read, "registry", "left_anti").unionByName(fresh)


def refresh_all(companies: DataFrame, jobs: DataFrame, entries: DataFrame, meta: DataFrame, registers: list[str], at) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:  # noqa: ANN001
    """Registers read (entries: registry, pos, name, aliases, evidence), matched, and handed on to companies and the tiers of their postings.

    New snapshots of companies, jobs and metadata, and one row of ``companies`` and ``matched`` (those
    that a register names, or that have further bits beside the manual one, which alone isn't a match).
    """
    found = written(rollup_matches(match_entries(companies.select(F.col("name").alias("seed")), entries)), "register-matches")
    new, tiered = refresh(companies, jobs, found)
    named = companies.join(found.select(F.col("seed").alias("name"), "flags"), "name", "left")
    totals = named.agg(F.count(F.lit(1)).alias("companies"), F.count_if(F.coalesce(F.col("flags"), F.lit(0)) != 0).alias("matched"))
    return new, tiered, record_registers(meta, entries, registers, at), totals


def flag_manual(companies: DataFrame, name: str, evidence: str, flagged_on: str) -> DataFrame:
    """A new snapshot where one company has the manual bit; an unknown name is an error."""
    if companies.where(F.col("name") == name).isEmpty():
        raise ValueError(f"no company {name!r}")
    own = F.col("name") == name
    return companies.withColumns(
        {
            "registry_flags": F.when(own, F.col("registry_flags").bitwiseOR(vocab.REGISTRY_BITS["MANUAL"])).otherwise(F.col("registry_flags")),
            "match_confidence": F.when(own, 1.0).otherwise(F.col("match_confidence")),
            "match_evidence": F.when(own, f"MANUAL: {evidence} (flagged {flagged_on})").otherwise(F.col("match_evidence")),
        }
    )


def first_rows(rows: DataFrame, key: list, pos: str = "pos") -> DataFrame:  # noqa: ANN401
    """The first row, by ``pos``, of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(pos))).where("_n = 1").drop("_n")


def stale_registers(meta: DataFrame, now, days: int = vocab.REGISTRY_STALE_DAYS) -> DataFrame:  # noqa: ANN001
    """Registers whose snapshot is older than ``days``."""
    return meta.where(F.col("fetched_at") < F.lit(now) - F.make_dt_interval(F.lit(days))).orderBy("registry")
