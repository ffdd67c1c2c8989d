"""Snapshots: tables kept as Parquet folders, replaced by writing a new one."""

from __future__ import annotations

import operator
import tempfile
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, a temporary one on a local master and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.jobscope.sharedDir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="jobscope-")
        spark.conf.set("spark.jobscope.sharedDir", named)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, name: str) -> str:
    """A path for one run's files in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from the shared folder: lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows over all cores where they come from fewer files than there are cores; larger tables stay as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if 0 < len(df.inputFiles()) < cores else df


def _versions(root: str) -> str:
    return f"{root.rstrip('/')}-versions"


def version_path(root: str, number: int) -> str:
    """Where a version's entry lies."""
    return f"{_versions(root)}/version={number}"


def newest_version(spark: SparkSession, root: str) -> int:
    """The number of a table's newest complete version, 0 if it has none."""
    try:
        found = spark.read.schema("version int").parquet(_versions(root)).agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = None
    return found or 0


class SnapshotConflict(RuntimeError):
    """Another writer has written the version that was to be written."""


def write_snapshot(df: DataFrame, root: str, after: int | None = None) -> str:
    """Write a table's next version; readers take the newest that is complete.

    ``after`` is the version that ``df`` was made from (the newest, if it isn't given). A version's
    entry is made only if it isn't there, so of two writers that read the same version one fails with
    ``SnapshotConflict`` and can read again; clocks play no part.
    """
    spark = df.sparkSession
    version = (newest_version(spark, root) if after is None else after) + 1
    path = f"{root.rstrip('/')}/v={uuid.uuid4().hex}"
    df.write.parquet(path)
    try:
        spark.createDataFrame([(path,)], "path string").coalesce(1).write.mode("errorifexists").parquet(version_path(root, version))
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        raise SnapshotConflict(f"version {version} of {root} is there already") from e
    return path


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A version of a table, the newest complete one if none is given."""
    entries = spark.read.schema("path string, version int").parquet(_versions(root))
    found = entries.orderBy(F.desc("version")).first() if version is None else entries.where(F.col("version") == version).first()
    return spark.read.parquet(found["path"])


def same_keys(keys: list[str], left: str, right: str) -> Column:
    """Null-safe equality of the keys of two aliased sides."""
    return reduce(operator.and_, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys))


def with_new_ids(stored: DataFrame, incoming: DataFrame, keys: list[str], name: str = "new_id", first: list[str] | None = None) -> DataFrame:
    """``incoming`` with ``name``: for keys that ``stored`` hasn't got, numbers after its largest ``id`` in the order of ``first`` and the keys; else null."""
    first = first or []
    new = incoming.select(*first, *keys).distinct().alias("i").join(stored.select(*keys).alias("s"), same_keys(keys, "i", "s"), "left_anti")
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("_top"))
    numbered = with_ids(new, 1, [*first, *keys], "_n").join(F.broadcast(top)).select(*keys, (F.col("_top") + F.col("_n")).alias(name))  # one row, one number
    met = incoming.alias("i").join(numbered.alias("n"), same_keys(keys, "i", "n"), "left")
    return met.select("i.*", F.col(f"n.{name}"))


def merge(stored: DataFrame, incoming: DataFrame, keys: list[str], merged: dict[str, Column], inserted: dict[str, Column]) -> DataFrame:
    """A new snapshot: stored rows changed by ``merged``, new ones from ``inserted``, all others as they are.

    Expressions see the two sides as ``s`` and ``i``; columns they don't name are taken from the
    stored row if there is one, else from the incoming row, else null. Keys are compared null-safely.
    """
    both = stored.withColumn("_s", F.lit(True)).alias("s").join(incoming.withColumn("_i", F.lit(True)).alias("i"), same_keys(keys, "s", "i"), "full_outer")
    return both.select(*merged_rows(stored.columns, incoming.columns, merged, inserted))


def merged_rows(stored: list[str], incoming: list[str], merged: dict[str, Column], inserted: dict[str, Column]) -> list[Column]:
    """The columns of a merge, over the two sides joined as ``s`` and ``i``, of which ``_s`` and ``_i`` say that they are there."""
    known, new = F.col("s._s").isNotNull(), F.col("i._i").isNotNull()
    fresh = lambda c: inserted.get(c, F.col(f"i.{c}") if c in incoming else F.lit(None))
    return [F.when(known & new, merged.get(c, F.col(f"s.{c}"))).when(known, F.col(f"s.{c}")).otherwise(fresh(c)).alias(c) for c in stored]


def with_ids(df: DataFrame, first: Column | int, order: list[str], name: str = "id") -> DataFrame:
    """Number rows from ``first`` on: ranges of the order are numbered apart and put after each other."""
    shards = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = written(df.repartitionByRange(shards, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    shard = F.shiftright("_at", 33)
    sizes = dealt.groupBy(shard.alias("_shard")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a shard
    starts = sizes.select("_shard", "_low", before.alias("_before"))
    first = first if isinstance(first, Column) else F.lit(first)
    return dealt.join(F.broadcast(starts), shard == F.col("_shard")).withColumn(name, (first + F.col("_before") + F.col("_at") - F.col("_low")).cast("long")).drop("_at", "_shard", "_low", "_before")
