"""Resumes: profiles, scores kept by content hash, ranked pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope import vocab
from jobscope.functions import classify
from jobscope.functions.score import rationale, score_match
from jobscope.operators.search import JobFilters, order, predicate
from jobscope.store import written

#: Profiles that are broadcast at once.
BLOCK = 1000


def blocks(df: DataFrame, key: str, most: int) -> list[DataFrame]:
    """The table in parts of about half of ``most`` rows by hash of ``key``, or whole if it is counted to have no more."""
    n = df.count()
    parts = -(-2 * n // most)
    return [df] if n <= most else [df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k) for k in range(parts)]


def build_profiles(resumes: DataFrame) -> DataFrame:
    """``profile`` of each resume (source_text, target_countries), everything read from the one text."""
    text = F.col("source_text")
    return resumes.withColumn("profile", F.struct(classify.skills(text).alias("skills"), classify.categories(text).alias("categories"), classify.resolve_level(text, text).alias("level"), classify.years_of_experience(text).alias("years"), F.col("target_countries")))


def with_facts(jobs: DataFrame) -> DataFrame:
    """``facts`` of each posting; skills come from the description alone."""
    none = F.array().cast("array<string>")
    return jobs.withColumn("facts", F.struct(classify.skills(F.col("description")).alias("skills"), F.coalesce("categories", none).alias("categories"), F.coalesce("level", F.lit(vocab.UNSPECIFIED)).alias("level"), F.col("country"), F.col("sponsor_tier")))


def stored_facts(jobs: DataFrame) -> DataFrame:
    """``id``, ``content_hash`` and ``facts``, written: read from each text once, however many profiles they are held against."""
    return written(with_facts(jobs).select("id", "content_hash", "facts"), "facts")


def _with_profiles(facts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every posting with every given profile; profiles are broadcast in parts of bounded size."""
    parts = [facts.join(F.broadcast(p)) for p in blocks(profiles.select("resume_hash", "profile"), "resume_hash", BLOCK)]
    return reduce(DataFrame.unionByName, parts)


def score_jobs(jobs: DataFrame, profiles: DataFrame) -> DataFrame:
    """``resume_hash``, ``id``, ``content_hash`` and ``score`` of every posting for every given profile."""
    return _with_profiles(stored_facts(jobs), profiles).select("resume_hash", "id", "content_hash", score_match(F.col("profile"), F.col("facts")).alias("score"))


def _unscored(cached: DataFrame, jobs: DataFrame, profiles: DataFrame) -> DataFrame:
    """``resume_hash`` and ``id`` of the pairs that ``cached`` (valid pairs) hasn't got.

    A resume that lacks more than half of the postings is held against all of them. For all others,
    only postings that one of them lacks are: those that are new or have changed, which as a rule all
    of them lack.
    """
    total = jobs.count()
    have = cached.groupBy("resume_hash").agg(F.count(F.lit(1)).alias("n"))
    resumes = written(profiles.select("resume_hash").distinct().join(have, "resume_hash", "left").select("resume_hash", F.coalesce("n", F.lit(0)).alias("n")), "coverage")
    dense, sparse = resumes.where(F.col("n") * 2 > total).select("resume_hash"), resumes.where(F.col("n") * 2 <= total).select("resume_hash")
    full = dense.count()
    held = cached.join(F.broadcast(dense) if full <= BLOCK else dense, "resume_hash", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    lacking = jobs.select("id").join(held, "id", "left").where(F.coalesce("n", F.lit(0)) < full).select("id")
    pairs = [jobs.select("id").join(F.broadcast(p)) for p in blocks(sparse, "resume_hash", BLOCK)] + [lacking.join(F.broadcast(p)) for p in blocks(dense, "resume_hash", BLOCK)]
    return reduce(DataFrame.unionByName, pairs).join(cached, ["resume_hash", "id"], "left_anti").select("resume_hash", "id")


def refresh_scores(cache: DataFrame, jobs: DataFrame, profiles: DataFrame) -> DataFrame:
    """The score cache with scores worked out anew only for pairs of resume and posting whose content hash isn't the cached one."""
    met = cache.join(jobs.select(F.col("id").alias("_i"), F.col("content_hash").alias("_now")), F.col("job_canonical_id") == F.col("_i"), "left")
    current = met.where(F.coalesce(F.col("_now") == F.col("content_hash"), F.lit(True))).drop("_i", "_now")
    valid = written(met.where(F.col("_now") == F.col("content_hash")).select("resume_hash", F.col("job_canonical_id").alias("id")).distinct(), "valid-scores")
    todo = written(_unscored(valid, jobs, profiles), "unscored")
    facts = stored_facts(jobs.join(todo.select("id").distinct(), "id", "left_semi"))
    met = facts.join(todo, "id").join(profiles.select("resume_hash", "profile"), "resume_hash")
    fresh = met.select("resume_hash", "id", "content_hash", score_match(F.col("profile"), F.col("facts")).alias("score")).select("resume_hash", F.col("id").alias("job_canonical_id"), "score.*", "content_hash", F.current_timestamp().alias("computed_at"))
    return current.unionByName(fresh.select(*current.columns), allowMissingColumns=True)


def ranked_page(jobs: DataFrame, profile: DataFrame, cache: DataFrame, f: JobFilters) -> DataFrame:
    """A page by cached scores (uncached last), in the order of fresh ones: scored after the limit."""
    own = cache.where(F.col("resume_hash") == f.resume_hash).select(F.col("job_canonical_id").alias("_j"), "overall")
    page = jobs.where(predicate(f)).join(own, F.col("id") == F.col("_j"), "left").orderBy(*order(f, True)).offset(f.offset).limit(f.limit)
    scored = with_facts(page).join(F.broadcast(profile.select("profile").limit(1)))
    fresh = scored.withColumn("fresh", score_match(F.col("profile"), F.col("facts"))["overall"]).withColumn("cached", F.col("overall"))
    return fresh.orderBy(F.desc("fresh"), *order(f, True)).select("id", "title", "cached", "fresh")


def deep_match(jobs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Score and rationale of every posting for every given profile, never from the cache."""
    scored = _with_profiles(stored_facts(jobs), profiles).withColumn("score", score_match(F.col("profile"), F.col("facts")))
    return scored.select("resume_hash", "id", "score", rationale(F.col("profile"), F.col("facts"), F.col("score")).alias("rationale"))


def add_resume(resumes: DataFrame, text: str, label: str, targets: list[str], created_at) -> DataFrame:  # noqa: ANN001
    """Resumes with one more, active alone; a text that is there already is reused as it was stored."""
    spark = resumes.sparkSession
    row = spark.createDataFrame([(label, text, targets, created_at)], "label string, source_text string, target_countries array<string>, created_at timestamp")
    row = row.withColumn("resume_hash", F.sha2("source_text", 256)).join(resumes.select("resume_hash"), "resume_hash", "left_anti")
    top = resumes.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
    shaped = row.join(top).withColumn("active", F.lit(True))
    both = resumes.unionByName(shaped, allowMissingColumns=True)
    return both.withColumn("active", F.col("resume_hash") == F.sha2(F.lit(text), 256))
