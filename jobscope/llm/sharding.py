"""Groups of equal texts packed into shards, best fit decreasing.

All rows of one text are one indivisible group, as large as its rows together (the bytes of their texts
and one more for each row). Groups are taken from the largest to the smallest, ties by the text's md5;
each enters the shard that it leaves least room in, found in a balanced tree of the shards by their
remaining capacity, or opens a new one where it fits nowhere. That fills few shards of a fixed
``capacity``. Where a number of shards is given instead, groups that alone are larger than an equal
share of what is left get a shard each, and the others are packed into the rest with the least capacity,
found by halving, at which they fit: then sizes are as near to equal as whole groups allow.

Groups of one size are packed together, a run of them into a shard at once, which gives what one at a
time would. So the packing needs only how many groups there are of each size, at most the square root of
twice the input's bytes of different sizes (14 million at 100 TB), and it gives runs of places in the
order of all groups. Everything that has a row for each text or document stays in Spark: groups are
numbered through ranges of that order and find their run within blocks of 1024 places; rows join their
group (a text of very many rows is a skewed key, which adaptive execution splits) and are numbered in
their shard through ranges of shard, group and row.

Cases: a null text counts as empty, of size 1, and is one group with empty texts; rows that repeat an id,
or have none, are rows of their own; a group larger than ``capacity`` gets a shard alone; there may be
fewer groups than shards, and some are then empty; empty tables give empty results; further columns are
passed on (``write_shards``) or ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobscope.store import with_ids, written

SHARDS = 16

#: Bits of the number of places that find their run together.
BLOCK_BITS = 10


class RoomTree:
    """Shards by their room, as (room, shard): a B+ tree of two levels whose leaves part in halves when they are full."""

    LEAF = 512

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = []
        self.last: list[tuple[int, int]] = []

    def add(self, entry: tuple[int, int]) -> None:
        at = min(bisect_left(self.last, entry), len(self.leaves) - 1)
        if at < 0:
            self.leaves, self.last = [[entry]], [entry]
            return
        leaf = self.leaves[at]
        insort(leaf, entry)
        if len(leaf) > self.LEAF:
            half = len(leaf) // 2
            self.leaves[at : at + 1] = [leaf[:half], leaf[half:]]
            self.last[at : at + 1] = [leaf[half - 1], leaf[-1]]
        else:
            self.last[at] = leaf[-1]

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and give the shard of least room that holds ``size``; of equal ones the first."""
        at = bisect_left(self.last, (size, -1))
        if at == len(self.leaves):
            return None
        leaf = self.leaves[at]
        entry = leaf.pop(bisect_left(leaf, (size, -1)))
        if leaf:
            self.last[at] = leaf[-1]
        else:
            del self.leaves[at], self.last[at]
        return entry


def pack(sizes: np.ndarray, counts: np.ndarray, capacity: int, most: int | None = None) -> list[tuple[int, int]] | None:
    """Best fit decreasing of ``counts[i]`` groups of each size, sizes falling: runs (groups, shard) in that order.

    None if it takes more than ``most`` shards.
    """
    tree, runs, opened = RoomTree(), [], 0
    for size, left in zip(sizes.tolist(), counts.tolist(), strict=True):
        while left:
            found = tree.take(size)
            if found is None:
                if opened == most:
                    return None
                found = max(capacity, size), opened
                opened += 1
            room, shard = found
            n = min(left, room // size)  # it stays the tightest until it is too small
            runs.append((n, shard))
            left -= n
            if room - n * size:
                tree.add((room - n * size, shard))
    return runs


def pack_evenly(sizes: np.ndarray, counts: np.ndarray, shards: int) -> list[tuple[int, int]]:
    """Runs (groups, shard), in the order of falling sizes, of a packing into ``shards`` of as near to equal sizes as can be."""
    if not len(sizes):
        return []
    counts, alone, total = counts.copy(), 0, int((sizes * counts).sum())
    at = 0
    while at < len(sizes) and alone < shards - 1 and int(sizes[at]) * (shards - alone) > total:
        total, alone = total - int(sizes[at]), alone + 1
        counts[at] -= 1
        at += counts[at] == 0
    runs = [(1, k) for k in range(alone)]
    if at == len(sizes):
        return runs
    rest, own = shards - alone, (sizes[at:], counts[at:])
    low = max(int(sizes[at]), -(-total // rest))
    high = -(-total // rest) + int(sizes[at])  # any shard has less room than the group that opens a new one, so this is enough
    best = pack(*own, high, rest)
    while low < high:
        middle = (low + high) // 2
        found = pack(*own, middle, rest)
        low, high, best = (middle + 1, high, best) if found is None else (low, middle, found)
    return runs + [(n, alone + shard) for n, shard in best]


def text_md5(text: Column) -> Column:
    """The 16 bytes that stand for a text, a null one as the empty one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _rows(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``text_md5`` and ``row`` (a number of its own) of each row, written: no text is read again."""
    text = F.coalesce(docs["text"], F.lit(""))
    return written(docs.select(docs["doc_id"].cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), text_md5(text).alias("text_md5"), F.monotonically_increasing_id().alias("row")), "shard-rows")


def _group_shards(rows: DataFrame, shards: int | None, capacity: int | None) -> DataFrame:
    """``text_md5``, ``place`` (in falling order of size) and ``shard`` of each group."""
    groups = rows.groupBy("text_md5").agg((-F.sum("size")).alias("less"))
    placed = with_ids(groups, 0, ["less", "text_md5"], "place")
    sizes = placed.groupBy("less").agg(F.count(F.lit(1)).alias("n")).toArrow()
    order = np.argsort(less := sizes["less"].to_numpy())
    falling, counts = -less[order], sizes["n"].to_numpy()[order]
    runs = pack(falling, counts, capacity) if shards is None else pack_evenly(falling, counts, shards)
    n, shard = np.array(runs, np.int64).reshape(-1, 2).T
    ends = np.cumsum(n)
    begins = rows.sparkSession.createDataFrame(pa.table({"begin": ends - n, "end": ends - 1, "shard": shard.astype(np.int32)}))
    block = lambda c: F.shiftright(c, BLOCK_BITS)
    # a run begins anew in each block that it reaches
    cut = begins.select("begin", "shard", F.explode(F.sequence(block("begin"), block("end"))).alias("block")).select("block", F.greatest("begin", F.shiftleft("block", BLOCK_BITS)).alias("place"), "shard", F.lit(None).cast("binary").alias("text_md5"))
    both = placed.select(block("place").alias("block"), "place", F.lit(None).cast("int").alias("shard"), "text_md5").unionByName(cut)
    order_ = Window.partitionBy("block").orderBy("place", F.col("text_md5").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("shard", F.last("shard", True).over(order_)).where("text_md5 is not null").drop("block")


def shard_rows(docs: DataFrame, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``text_md5``, ``shard`` and ``slot`` (from 0 in each shard, groups together) of each row.

    Either ``shards`` is given, for as many of near to equal size, or ``capacity`` in bytes, for few that hold at most as much.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    rows = _rows(docs)
    order = ["shard", "place", "doc_id", "row"]
    met = rows.join(_group_shards(rows, shards, capacity), "text_md5")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = written(met.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "shard-slots")
    part = F.shiftright("at", 33)
    # a row for each shard that a range holds: at most as many as there are ranges and shards
    sizes = dealt.groupBy(F.col("shard").alias("_shard"), part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("at").alias("_low"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("_before", before)
    found = dealt.join(F.broadcast(starts), (F.col("shard") == F.col("_shard")) & (part == F.col("_part")))
    return found.select("doc_id", "size", "text_crc32", "text_md5", "shard", (F.col("at") - F.col("_low") + F.col("_before")).alias("slot"))


def shard_table(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` (null: this law moves any row when a shard is added)."""
    return shard_rows(docs, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int | None = None, capacity: int | None = None) -> None:
    """Write all rows and columns of ``docs`` as Parquet files in a folder ``shard=N`` for each shard, groups of one text together.

    A column of ``docs`` named ``shard`` gives way to the folder's.
    """
    rows = _rows(docs)
    found = _group_shards(rows, shards, capacity)
    kept = [docs[c] for c in docs.columns if c.lower() != "shard"]
    met = docs.join(found, text_md5(docs["text"]) == found["text_md5"]).select(*kept, found["shard"], found["place"].alias("_place"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met.repartitionByRange(parts, "shard", "_place", F.xxhash64(*(c for c in met.columns if c not in ("shard", "_place")))).sortWithinPartitions("shard", "_place").drop("_place").write.partitionBy("shard").parquet(path)


def _crc32_table() -> list[int]:
    """What each byte adds, from the polynomial."""

    def one(x: int) -> int:
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        return x

    return [one(k) for k in range(256)]


def oracle_sql(documents: str = "documents", shards: int = SHARDS) -> str:
    """The same group by group, rooms as a list; crc32 byte by byte, as this dialect has none."""
    whole = 4294967295
    after = """list_reduce(list_concat([{s: 0::BIGINT, rooms: []::BIGINT[], path: []::BIGINT[]}], xs), lambda a, x: {s: x.s,
    rooms: CASE WHEN len(list_filter(a.rooms, lambda r: r >= x.s)) = 0 THEN list_append(a.rooms, @capacity - x.s)
      ELSE list_transform(a.rooms, lambda r, i: CASE WHEN i = list_position(a.rooms, list_min(list_filter(a.rooms, lambda q: q >= x.s))) THEN r - x.s ELSE r END) END,
    path: list_append(a.path, CAST(coalesce(list_position(a.rooms, list_min(list_filter(a.rooms, lambda r: r >= x.s))), len(a.rooms) + 1) AS BIGINT))})"""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM {documents}),
k AS MATERIALIZED (SELECT doc_id, r, md5(t) AS key, CAST(octet_length(encode(t)) + 1 AS BIGINT) AS size, t FROM d),
c AS MATERIALIZED (SELECT key, xor(list_reduce(list_concat([{whole}::BIGINT], list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda s, b: xor(s >> 8, {_crc32_table()}[CAST(xor(s, b) & 255 AS INT) + 1])), {whole}::BIGINT) AS crc FROM (SELECT key, any_value(t) AS t FROM k GROUP BY key)),
g AS MATERIALIZED (SELECT key, CAST(sum(size) AS BIGINT) AS bytes, row_number() OVER (ORDER BY sum(size) DESC, key) AS place FROM k GROUP BY key),
left_ AS (SELECT place, bytes, sum(bytes) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM g),
alone AS (SELECT coalesce(min(place) - 1, 0) AS n FROM left_ WHERE NOT (place - 1 < {shards} - 1 AND bytes * ({shards} - place + 1) > rest)),
l AS MATERIALIZED (SELECT any_value(n) AS alone, {shards} - any_value(n) AS rest, list({{s: bytes, rooms: []::BIGINT[], path: []::BIGINT[]}} ORDER BY place) AS xs, max(bytes) AS largest, CAST(ceil(sum(bytes) / ({shards} - any_value(n))) AS BIGINT) AS mean FROM g, alone WHERE place > n),
search(low, high) AS (SELECT greatest(largest, mean), mean + largest FROM l
  UNION ALL SELECT CASE WHEN fits THEN low ELSE middle + 1 END, CASE WHEN fits THEN middle ELSE high END FROM (SELECT low, high, middle, len({after.replace('@capacity', 'middle')}.rooms) <= rest AS fits FROM (SELECT *, (low + high) // 2 AS middle FROM search WHERE low < high), l)),
best AS (SELECT low AS capacity FROM search WHERE low >= high LIMIT 1),
packed AS (SELECT {after.replace('@capacity', 'capacity')}.path AS path, alone FROM l, best),
shard AS (SELECT alone + generate_subscripts(path, 1) AS place, CAST(alone + unnest(path) - 1 AS INT) AS shard FROM packed UNION ALL SELECT place, CAST(place - 1 AS INT) FROM g, alone WHERE place <= n)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place, doc_id NULLS FIRST, r) - 1 AS slot, NULL::INT AS grown_shard
FROM k JOIN g USING (key) JOIN shard USING (place) JOIN c USING (key)
"""


ORACLE = oracle_sql()
