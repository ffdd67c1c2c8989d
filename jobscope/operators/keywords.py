"""The keyword filter through an index of trigrams."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.functions.keywords import gram_rows, grams, literal_runs
from jobscope.operators.search import like_ascii

#: Trigrams of a keyword whose lists are intersected, rarest first.
LISTS = 4

#: Candidates up to which only stretches of ids around them are read, and how many stretches.
MAX_IDS, STRETCHES = 10_000, 64


def build_index(jobs: DataFrame, root: str) -> None:
    """Write the index of a job table: the postings in order of id, (gram, id) in order of both, and how many postings hold each gram.

    One pass over the texts; lists are rows, so a gram that every posting holds is no large row anywhere.
    """
    shards = max(1, int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spark = jobs.sparkSession
    jobs.repartitionByRange(shards, "id").sortWithinPartitions("id").write.option("parquet.page.row.count.limit", 100).parquet(f"{root}/jobs")
    text = F.concat_ws("\n", "title", "description")
    spark.read.parquet(f"{root}/jobs").select("id", text.alias("text")).mapInArrow(gram_rows, f"id {dict(jobs.dtypes)['id']}, gram string").write.parquet(f"{root}/unsorted")
    lists = spark.read.parquet(f"{root}/unsorted")
    lists.repartitionByRange(shards, "gram", "id").sortWithinPartitions("gram", "id").write.parquet(f"{root}/lists")
    lists.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{root}/counts")


def candidates(spark: SparkSession, root: str, keyword: str) -> DataFrame | None:
    """``id`` of the postings that hold the rarest trigrams of all of a keyword's literal runs; None if it has no run of three characters."""
    wanted = sorted({g for run in literal_runs(keyword) for g in grams(run)})
    if not wanted:
        return None
    counts = spark.read.parquet(f"{root}/counts").where(F.col("gram").isin(wanted)).collect()  # as many as the keyword has
    rare = sorted((r["n"], r["gram"]) for r in counts)[:LISTS]
    lists = spark.read.parquet(f"{root}/lists")
    if len(counts) < len(wanted):  # one stands nowhere
        return lists.select("id").limit(0)
    own = reduce(operator.or_, (F.col("gram") == g for _, g in rare))  # equalities, which the files' statistics are held against
    return lists.where(own).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rare)).select("id")


def _stretches(ids: list[int]) -> list[tuple[int, int]]:
    """Sorted ids as a few stretches with the widest gaps between them."""
    gaps = sorted(range(1, len(ids)), key=lambda k: ids[k - 1] - ids[k])[: STRETCHES - 1]
    cuts = [0, *sorted(gaps), len(ids)]
    return [(ids[a], ids[b - 1]) for a, b in zip(cuts, cuts[1:], strict=False)]


def keyword_jobs(spark: SparkSession, root: str, keyword: str) -> DataFrame:
    """The postings of an index whose title or description holds the keyword, as the list's filter has it."""
    jobs = spark.read.parquet(f"{root}/jobs")
    ids = candidates(spark, root, keyword)
    if ids is not None:
        few = [r[0] for r in ids.orderBy("id").limit(MAX_IDS + 1).collect()]
        if len(few) <= MAX_IDS:
            jobs = jobs.where(reduce(operator.or_, (F.col("id").between(a, b) for a, b in _stretches(few)))) if few else jobs.limit(0)
        jobs = jobs.join(ids, "id", "left_semi")
    return jobs.where(like_ascii(F.col("title"), keyword) | like_ascii(F.col("description"), keyword))
