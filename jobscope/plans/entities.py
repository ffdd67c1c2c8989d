"""Queries of entities: names, registers, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope import vocab
from jobscope.functions import names
from jobscope.functions.simhash import simhash_by_md5
from jobscope.operators.dedup import assign_canonicals, dedup_summary, link_canonicals, near_pairs, start_index, update_index, written_fingerprints
from jobscope.operators.registry import first_rows, match_entries, rollup_matches
from jobscope.operators.search import JobFilters, count_jobs
from jobscope.plans.postings import POSTINGS, postings
from jobscope.sources.registers import uk_entries, us_entries
from jobscope.store import spread

NAMES = ["Cohere US, Inc.", "Cohere Health, Inc.", "Cohere", "Reddit", "Redditch Ltd", "N.V. Philips", "Stripe Payments UK Ltd", "Bird (MessageBird)", "AgileBits UK Ltd trading as 1Password", "Foo T/A Bar dba Baz", "", "Global Services Group", "Acme  Labs, LLC (Acme Europe)"]
DECORATIONS = [" Limited", " UK Ltd", " trading as Brand ", " Health Inc", " Holdings B.V.", " Consulting"]


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two registers made from supplier names with decorations; the third names themselves."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    n = F.col("s_suppkey")
    decoration = F.element_at(F.array(*map(F.lit, DECORATIONS)), (n % 6).cast("int") + 1)
    raw = F.concat(F.col("s_name"), decoration, F.when(n % 6 == 2, n.cast("string")).otherwise(""))
    parts = names.split_trading_as(raw)
    uk = s.select(F.lit("UK").alias("registry"), n.cast("long").alias("pos"), parts["legal"].alias("name"), parts["aliases"].alias("aliases"), F.concat(F.lit("Route "), (n % 4).cast("string")).alias("evidence"))
    us = s.select(F.lit("US").alias("registry"), n.cast("long").alias("pos"), F.when(n % 4 == 0, F.col("s_name")).otherwise(F.concat(F.lit("Other "), "s_name")).alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("evidence"))
    return uk.unionByName(us)


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_name").alias("seed"))


def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.createDataFrame(list(enumerate(NAMES)), "n long, raw string")
    parts = names.split_trading_as(F.col("raw"))
    return v.select("n", F.array_join(names.name_key(F.col("raw")), " ").alias("key"), F.array_join(names.name_core(F.col("raw")), " ").alias("core"), parts["legal"].alias("legal"), F.array_join(parts["aliases"], "|").alias("aliases"), F.array_join(names.name_variants(F.col("raw")), "|").alias("variants"))


def registry_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_entries(_seeds(spark, sf_dir), _entries(spark, sf_dir)).select("seed", "registry", "confidence", "pos")


def registry_flags_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup_matches(match_entries(_seeds(spark, sf_dir), _entries(spark, sf_dir)))


def registry_names_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(16).select("id", F.array_join(names.registry_names(F.col("id").cast("int")), ",").alias("names"))


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings of customers."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").join(spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_custkey") % 200
    status = F.when(F.col("o_orderstatus") == "F", "Certified").when(F.col("o_orderstatus") == "O", "Denied").otherwise("Certified - Withdrawn")
    return o.select(F.col("o_orderkey").alias("pos"), status.alias("CASE_STATUS"), F.concat(F.lit(" Employer "), k.cast("string"), F.when(k % 5 == 0, " dba Shop").otherwise("")).alias("EMPLOYER_NAME"), F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("Brand "), (k % 3).cast("string"))).otherwise(" ").alias("TRADE_NAME_DBA"))


def lca_employers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return us_entries(_filings(spark, sf_dir)).select("name", "evidence", F.array_join("aliases", "|").alias("aliases"))


def uk_first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    rows = c.select(F.col("c_custkey").alias("pos"), F.concat(F.lit(" Organisation "), (F.col("c_custkey") % 300).cast("string"), F.when(F.col("c_custkey") % 9 == 0, " trading as Nine").otherwise("")).alias("Organisation Name"), F.col("c_mktsegment").alias("Route"))
    return uk_entries(rows).select("name", "pos", "evidence", F.array_join("aliases", "|").alias("aliases"))


def first_event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "event_id")
    return first_rows(e, ["user_id", "event_type"], "event_id")


def simhash_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spread(docs, "doc_id").select("doc_id", simhash_by_md5(F.col("text")).alias("fingerprint"))


def neardup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs between the first postings of each fingerprint and their copies."""
    return near_pairs(written_fingerprints(postings(spark, sf_dir)))


def canonical_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_canonicals(postings(spark, sf_dir))


def canonical_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters of ``canonical_map`` after polls: even postings, some with another text, and strangers; then odd ones, the right texts, and the strangers gone."""
    p, n = postings(spark, sf_dir), F.col("id")
    wrong = p.where(n % 2 == 0).withColumn("description", F.when(n % 6 == 0, F.concat("description", F.lit(" "), F.sha2("description", 256))).when(n % 10 == 0, F.lit("one text for many")).otherwise(F.col("description")))
    strangers = p.where(n % 5 == 1).withColumn("id", -n - 1)
    index = start_index(wrong.unionByName(strangers))
    index = update_index(index, p.where(n % 4 == 1))
    index = update_index(index, p.where((n % 4 == 3) | ((n % 2 == 0) & ((n % 6 == 0) | (n % 10 == 0)))), strangers.select("id"))
    return index.labels.select("id", "canonical")


def dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_summary(assign_canonicals(postings(spark, sf_dir)))


def list_canonical_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings(spark, sf_dir)
    return count_jobs(link_canonicals(p, assign_canonicals(p)), JobFilters())


# ---- SQL ----
def _l(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _tokens(c: str) -> str:
    return f"list_filter(string_split_regex(replace(lower({c}), '.', ''), '[^a-z0-9]+'), lambda t: t <> '')"


def _core(c: str) -> str:
    return f"list_sort(list_distinct(list_filter({_tokens(c)}, lambda t: NOT list_contains({_l(vocab.SUFFIX_TOKENS)}, t))))"


def _key(c: str) -> str:
    return f"list_filter({_core(c)}, lambda t: NOT list_contains({_l(vocab.GEO_TOKENS + vocab.STRUCTURAL_TOKENS)}, t))"


def _trading(c: str) -> str:
    return f"list_transform(string_split_regex({c}, '(?i)\\s+(?:trading\\s+as|t/a|dba)\\s+'), lambda p: trim(p))"


def _variants(c: str) -> str:
    return f"[trim(regexp_replace({c}, '\\([^)]*\\)', '', 'g'))] || list_filter(list_transform(regexp_extract_all({c}, '\\(([^)]*)\\)', 1), lambda p: trim(p)), lambda p: p <> '')"


_ENTRIES = f"""raw AS (SELECT s_suppkey AS n, s_name, s_name || {_l(DECORATIONS)}[CAST(s_suppkey % 6 AS INT) + 1] || CASE WHEN s_suppkey % 6 = 2 THEN CAST(s_suppkey AS VARCHAR) ELSE '' END AS raw FROM supplier),
entries AS (SELECT 'UK' AS registry, 1 AS bit, CAST(n AS BIGINT) AS pos, {_trading('raw')} AS names, 'Route ' || n % 4 AS evidence FROM raw
  UNION ALL SELECT 'US', 4, CAST(n AS BIGINT), [CASE WHEN n % 4 = 0 THEN s_name ELSE 'Other ' || s_name END], NULL FROM raw),
w AS (SELECT seed, {_key('name')} AS key, {_core('name')} AS core FROM (SELECT s_name AS seed, unnest({_variants('s_name')}) AS name FROM supplier)),
l AS (SELECT registry, bit, pos, evidence, {_key('name')} AS key, {_core('name')} AS core FROM (SELECT registry, bit, pos, evidence, unnest(names) AS name FROM entries)),
m AS (SELECT seed, registry, bit, pos, min(evidence) AS evidence, max(CASE WHEN w.core = l.core THEN 1.0 ELSE 0.9 END)::DOUBLE AS confidence FROM w JOIN l ON w.key = l.key AND len(w.key) > 0 GROUP BY ALL),
best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY seed, registry ORDER BY confidence DESC, pos) = 1)"""

_BITS = " || ".join(f"CASE WHEN id & {bit} <> 0 THEN ['{n}'] ELSE [] END" for n, bit in vocab.REGISTRY_BITS.items())

_PRINTS = """words AS (SELECT {id} AS i, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS token FROM {table}),
cnt AS (SELECT i, token, count(*) AS w FROM words GROUP BY ALL),
bits AS (SELECT i, w, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) AS high, CAST('0x' || substr(md5(token), 9, 8) AS BIGINT) AS low FROM cnt),
pos AS (SELECT unnest(range(64)) AS b),
sums AS (SELECT i, b, sum(CASE WHEN (CASE WHEN b < 32 THEN high ELSE low END >> (b % 32)) & 1 = 1 THEN w ELSE -w END) AS s FROM bits CROSS JOIN pos GROUP BY i, b),
fp AS (SELECT i, sum(CASE WHEN s > 0 THEN (CASE WHEN b = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << b) END) ELSE 0 END)::BIGINT AS f FROM sums GROUP BY i)"""
_PRINTS = _PRINTS.replace("CASE WHEN b < 32 THEN high ELSE low END", "CASE WHEN b < 32 THEN low ELSE high END")
_DOC_PRINTS = _PRINTS.format(id="doc_id", text="text", table="documents")
_JOB_PRINTS = POSTINGS + ", " + _PRINTS.format(id="id", text="description", table="postings") + """,
j AS (SELECT id, company_id, trim(regexp_replace(lower(title), '[\\t\\n\\x0B\\f\\r \\x{0085}\\x{00A0}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')) AS t, country, coalesce(f, 0) AS f FROM postings LEFT JOIN fp ON i = id)"""
_EDGES = f"{_JOB_PRINTS}, e AS (SELECT a.id AS a, b.id AS b FROM j a JOIN j b ON a.company_id = b.company_id AND a.t = b.t AND a.country IS NOT DISTINCT FROM b.country AND a.id <> b.id AND bit_count(xor(a.f, b.f)) <= {vocab.DEDUP_HAMMING})"
_CANON = f"WITH RECURSIVE {_EDGES}, r(id, c) AS (SELECT id, id FROM j UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id), canon AS (SELECT id, min(c) AS canonical FROM r GROUP BY id)"

QUERIES = {
    f.__name__: f
    for f in (name_keys, registry_match, registry_flags_rollup, registry_names_bits, lca_employers, uk_first_row, first_event_rows, simhash_docs, neardup_pairs, canonical_map, canonical_incremental, dedup_counts, list_canonical_total)
}

ORACLES = {
    "name_keys": "WITH v(n, raw) AS (VALUES " + ", ".join(f"({n}, '{r}')" for n, r in enumerate(NAMES)) + f") SELECT CAST(n AS BIGINT) AS n, array_to_string({_key('raw')}, ' ') AS key, array_to_string({_core('raw')}, ' ') AS core, {_trading('raw')}[1] AS legal, array_to_string(list_filter({_trading('raw')}[2:], lambda p: p <> ''), '|') AS aliases, array_to_string({_variants('raw')}, '|') AS variants FROM v",
    "registry_match": f"WITH {_ENTRIES} SELECT seed, registry, confidence, pos FROM best",
    "registry_flags_rollup": f"WITH {_ENTRIES} SELECT seed, CAST(bit_or(bit) AS INT) AS flags, max(confidence) AS confidence, string_agg(registry || ' ' || coalesce(evidence, printf('%.2f', confidence)), '; ' ORDER BY bit) AS evidence FROM best GROUP BY seed",
    "registry_names_bits": f"SELECT id, array_to_string({_BITS}, ',') AS names FROM (SELECT unnest(range(16)) AS id)",
    "lca_employers": "WITH f AS (SELECT o_orderkey, trim(' Employer ' || o_custkey % 200 || CASE WHEN o_custkey % 200 % 5 = 0 THEN ' dba Shop' ELSE '' END) AS raw, CASE WHEN o_orderkey % 7 = 0 THEN 'Brand ' || o_custkey % 200 % 3 END AS dba FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'O'), "
    + f"g AS (SELECT raw, count(*) AS n, list(DISTINCT dba) FILTER (dba IS NOT NULL) AS dbas FROM f GROUP BY raw) SELECT {_trading('raw')}[1] AS name, n || CASE WHEN n = 1 THEN ' certified LCA filing' ELSE ' certified LCA filings' END AS evidence, array_to_string(list_sort(list_distinct({_trading('raw')}[2:] || coalesce(dbas, []))), '|') AS aliases FROM g",
    "uk_first_row": "WITH r AS (SELECT c_custkey AS pos, trim(' Organisation ' || c_custkey % 300 || CASE WHEN c_custkey % 9 = 0 THEN ' trading as Nine' ELSE '' END) AS raw, c_mktsegment FROM customer), "
    + f"b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY lower(raw) ORDER BY pos) = 1) SELECT {_trading('raw')}[1] AS name, CAST(pos AS BIGINT) AS pos, c_mktsegment AS evidence, array_to_string({_trading('raw')}[2:], '|') AS aliases FROM b",
    "first_event_rows": "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL",
    "simhash_docs": f"WITH {_DOC_PRINTS} SELECT doc_id, coalesce(f, 0) AS fingerprint FROM documents LEFT JOIN fp ON i = doc_id",
    "neardup_pairs": f"WITH {_JOB_PRINTS}, o AS (SELECT company_id, t, country, f, min(id) AS rep FROM j GROUP BY ALL) SELECT a.rep AS a, b.rep AS b FROM o a JOIN o b ON a.company_id = b.company_id AND a.t = b.t AND a.country IS NOT DISTINCT FROM b.country AND a.rep < b.rep AND bit_count(xor(a.f, b.f)) <= {vocab.DEDUP_HAMMING} UNION ALL SELECT o.rep, j.id FROM j JOIN o ON j.company_id = o.company_id AND j.t = o.t AND j.country IS NOT DISTINCT FROM o.country AND j.f = o.f AND j.id > o.rep",
    "canonical_map": f"{_CANON} SELECT id, canonical FROM canon",
    "canonical_incremental": f"{_CANON} SELECT id, canonical FROM canon",
    "dedup_counts": f"{_CANON} SELECT count(*) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT canonical, count(*) AS n FROM canon GROUP BY 1 HAVING count(*) > 1)",
    "list_canonical_total": f"{_CANON} SELECT count(*) AS total FROM canon JOIN postings USING (id) WHERE canonical = id AND user_status <> 'hidden'",
}
