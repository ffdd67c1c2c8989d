"""Tables kept in buckets of their key's hash: a new version rewrites the buckets it touches and names the files of all others again.

A version is a list of folders, one for each bucket that has rows, with the largest id of the table. It is
entered as a snapshot's is: an entry is made only if it isn't there, so of two writers that read the
same version one fails with ``SnapshotConflict``. Files are never changed, so readers of an older version
go on, and a run that fails before its entry leaves nothing but files that no version names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobscope.store import SnapshotConflict, merged_rows, newest_version, same_keys, version_path, with_ids, written

BUCKETS = 64

#: Bytes of a poll (texts, and ``ROW_BYTES`` for each row) up to which it goes to the stored rows, instead of both being shuffled.
SMALL_BYTES, ROW_BYTES = 64 << 20, 200

_BUCKET = "_bucket"


@dataclass(frozen=True)
class Version:
    """What a version's entry says."""

    number: int
    keys: tuple[str, ...]
    buckets: int
    schema: StructType
    top: int
    paths: dict[int, str]


def bucket_of(keys: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def read_version(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """The entry of a version, the newest if none is given: one row for each bucket at most."""
    number = newest_version(spark, root) if number is None else number
    rows = spark.read.parquet(version_path(root, number)).collect()
    head = rows[0]
    return Version(number, tuple(head["keys"]), head["buckets"], StructType.fromJson(json.loads(head["schema"])), head["top"], {r["bucket"]: r["path"] for r in rows if r["path"] is not None})


def read_buckets(spark: SparkSession, version: Version, only: list[int] | None = None) -> DataFrame:
    """The rows of a version, or of some of its buckets."""
    paths = [p for b, p in sorted(version.paths.items()) if only is None or b in only]
    return spark.read.schema(version.schema).parquet(*paths) if paths else spark.createDataFrame([], version.schema)


def _enter(spark: SparkSession, root: str, version: Version) -> Version:
    rows = [(b, p, version.top, list(version.keys), version.buckets, version.schema.json()) for b, p in (version.paths or {None: None}).items()]
    entry = spark.createDataFrame(rows, "bucket int, path string, top long, keys array<string>, buckets int, schema string").coalesce(1)
    try:
        entry.write.mode("errorifexists").parquet(version_path(root, version.number))
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        raise SnapshotConflict(f"version {version.number} of {root} is there already") from e
    return version


def _write(rows: DataFrame, root: str, keys: tuple[str, ...], buckets: int) -> tuple[dict[int, str], int]:
    """Write rows by bucket; the folders, and the largest id among the rows."""
    path = f"{root.rstrip('/')}/v={uuid.uuid4().hex}"
    rows.withColumn(_BUCKET, bucket_of(keys, buckets)).write.partitionBy(_BUCKET).parquet(path)
    try:
        back = rows.sparkSession.read.parquet(path)
    except AnalysisException as e:  # no rows, no files
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return {}, 0
    id_ = F.max("id") if "id" in rows.columns else F.lit(0)
    found = back.groupBy(_BUCKET).agg(id_.alias("top")).collect()  # a row for each bucket
    return {r[_BUCKET]: f"{path}/{_BUCKET}={r[_BUCKET]}" for r in found}, max((r["top"] or 0 for r in found), default=0)


def create(rows: DataFrame, root: str, keys: list[str], buckets: int = BUCKETS) -> Version:
    """The first version of a table, from all its rows (one for each key)."""
    paths, top = _write(rows.repartition(bucket_of(tuple(keys), buckets)), root, tuple(keys), buckets)
    return _enter(rows.sparkSession, root, Version(1, tuple(keys), buckets, rows.schema, top, paths))


def is_small(rows: DataFrame) -> bool:
    """Whether rows may be broadcast, by the bytes of their texts."""
    texts = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in rows.dtypes if kind == "string"), F.lit(ROW_BYTES))
    return (rows.agg(F.sum(texts.cast("long"))).first()[0] or 0) <= SMALL_BYTES


def update(spark: SparkSession, root: str, version: Version, touched: list[int], change: Callable[[DataFrame], DataFrame]) -> Version:
    """The version after ``version``: the touched buckets with ``change`` made to their rows, all others by the files they have."""
    rows = change(read_buckets(spark, version, touched)).select(*version.schema.names)
    paths, top = _write(rows, root, version.keys, version.buckets)
    kept = {b: p for b, p in version.paths.items() if b not in touched}
    return _enter(spark, root, Version(version.number + 1, version.keys, version.buckets, version.schema, max(top, version.top), kept | paths))


def touched_by(rows: DataFrame, version: Version) -> list[int]:
    """The buckets of the keys of some rows."""
    return sorted(r[0] for r in rows.select(bucket_of(version.keys, version.buckets)).distinct().collect())  # at most as many as there are buckets


def with_numbers(stored: DataFrame, incoming: DataFrame, version: Version, small: bool, order: list[str] | None = None) -> DataFrame:
    """``incoming`` with ``new_id`` for keys that ``stored`` hasn't got: numbers after the version's largest id, in the order of ``order`` and the keys.

    Where ``incoming`` is small the stored rows are passed once, and aren't shuffled.
    """
    keys = list(version.keys)
    hint = F.broadcast if small else lambda df: df
    known = stored.select(*keys).alias("s").join(hint(incoming.select(*keys)).alias("i"), same_keys(keys, "s", "i"), "left_semi")
    new = incoming.alias("i").join(hint(written(known, "known-keys")).alias("s"), same_keys(keys, "i", "s"), "left_anti").select(*{*keys, *(order or [])})
    numbered = with_ids(new, version.top + 1, [*(order or []), *(k for k in keys if k not in (order or []))], "new_id").select(*keys, "new_id")
    return incoming.alias("i").join(hint(numbered).alias("n"), same_keys(keys, "i", "n"), "left").select("i.*", "n.new_id")


def merge_rows(stored: DataFrame, incoming: DataFrame, version: Version, merged: dict[str, Column], inserted: dict[str, Column], small: bool) -> DataFrame:
    """What ``store.merge`` gives, from ``incoming`` with ``new_id``; if it is ``small``, without a shuffle of the stored rows."""
    keys = list(version.keys)
    s, i = stored.withColumn("_s", F.lit(True)), incoming.withColumn("_i", F.lit(True))
    select = merged_rows(stored.columns, incoming.columns, merged, inserted)
    if not small:
        return s.alias("s").join(i.alias("i"), same_keys(keys, "s", "i"), "full_outer").select(*select)
    old = s.alias("s").join(F.broadcast(i).alias("i"), same_keys(keys, "s", "i"), "left").select(*select)
    none = stored.sparkSession.createDataFrame([], s.schema)
    new = i.where("new_id is not null").repartition(bucket_of(version.keys, version.buckets)).alias("i").join(none.alias("s"), same_keys(keys, "s", "i"), "left").select(*select)
    return old.unionByName(new)


def merge_into(spark: SparkSession, root: str, incoming: DataFrame, merged: dict[str, Column], inserted: dict[str, Column], number: int | None = None, order: list[str] | None = None) -> Version:
    """The next version after a merge of ``incoming`` (one row for each key); expressions see the sides as ``s`` and ``i``, new rows have ``i.new_id``."""
    version = read_version(spark, root, number)
    incoming = written(incoming, "incoming")
    small = is_small(incoming)
    touched = touched_by(incoming, version)

    def change(stored: DataFrame) -> DataFrame:
        return merge_rows(stored, with_numbers(stored, incoming, version, small, order), version, merged, inserted, small)

    return update(spark, root, version, touched, change)
