"""Line dedup within one edit, by a deletion-neighbourhood join.

A line (trimmed of spaces, not blank) is dropped if an earlier line of the corpus is within the edit
bound of it. The bound is one edit (one character put in, taken out or changed) where both lines have
``min_chars`` characters at least, and none for shorter ones: these are dropped only if an earlier line
is equal. Lines are ordered by ``doc_id``, then by a number from the text's md5, then by their place,
and a row is known by its id *and* its text, so rows that share an id (or have none) keep lines of
their own. Equal lines are found by hash. For the rest, all variants of a line with one character
deleted are hashed and joined:

* two lines whose variants with the *same place* deleted are equal differ by one changed character,
  so a group of equal (variant, place) keys is within one edit as a whole and its earliest line
  stands for it: no pairs within a group are made;
* a variant that is equal to a whole line is one deletion away from it.

The edit distance of each line and the earlier line found for it is verified on the texts. Before
variants are made, an exact filter leaves out lines without a partner: two lines within one edit
share their first or their last half (of the shorter length), so only lines that share a half with
another line are expanded, and only by deletions in the other half.

Cases: null and empty texts have no lines to drop; blank lines always stay; rows with one ``doc_id``
and different texts are different documents, ordered by their texts' md5; rows that repeat both id and
text count as one document, so each of them keeps its first lines; null ids come first; a text all of
whose lines are repeats becomes empty and its row stays; empty tables give empty results; all columns
of ``docs`` besides ``text`` and ``n_chars`` are passed on, and none is clashed with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import keyed_text_of, per_slice, text_key_of, text_of
from jobscope.store import written

#: Characters from which on one edit makes a near copy.
MIN_CHARS = 20

_LINES = "doc_id long, text_key long, line_no int, h1 long, h2 long, halves array<struct<key:long,side:int>>"

#: A line's place in the order of all lines.
_PLACE = ("doc_id", "text_key", "line_no")


def _half_keys(line: str) -> list[tuple[int | None, int]]:
    """Hashes of the first (side 1) and last (side 2) half, for the one or two lengths that a half can have with a partner.

    A line of one or two characters can have a partner of which no half is left: it has no hash and counts as one that shares both (side 3).
    """
    n = len(line)
    if n <= 2:
        return [(None, 3)]
    return [(xxhash.xxh64_intdigest(part.encode("utf-8", "replace"), 2 * size + side), side) for size in {n // 2, (n - 1) // 2} for side, part in ((1, line[:size]), (2, line[n - size :]))]


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """``doc_id``, ``text_key``, ``line_no`` (from 0), 128 bits that stand for the trimmed line, and ``halves`` (of lines that are long enough) of all lines that aren't blank."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[int] = []
        numbers, h1, h2, keys, sides, ends = [], [], [], [], [], [0]
        for i, text in enumerate(batch["text"].to_pylist()):
            for number, raw in enumerate(text.split("\n")):
                line = raw.strip(" ")
                if not line:
                    continue
                data = line.encode("utf-8", "replace")
                rows.append(i)
                numbers.append(number)
                h1.append(xxhash.xxh64_intdigest(data, 42))  # as Spark's xxhash64 has it
                h2.append(xxhash.xxh64_intdigest(data, 43))
                for key, side in _half_keys(line) if len(line) >= min_chars else ():
                    keys.append(key)
                    sides.append(side)
                ends.append(len(keys))
        signed = lambda x, absent=None: pa.array(np.array(x, np.uint64).view(np.int64), mask=absent)
        absent = np.array([k is None for k in keys], bool)
        halves = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([signed([k or 0 for k in keys], absent), pa.array(sides, pa.int32())], ["key", "side"]))
        at = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays([batch["doc_id"].take(at), batch["text_key"].take(at), pa.array(numbers, pa.int32()), signed(h1), signed(h2), halves], ["doc_id", "text_key", "line_no", "h1", "h2", "halves"])

    return keyed_text_of(docs).mapInArrow(per_slice(work), _LINES)


_B1, _B2 = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F | 1)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ (b << np.uint64(31) | b >> np.uint64(33))
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)).view(np.int64)


def _running(c: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and hashes of all prefixes."""
    n = len(c)
    powers = np.ones(n + 1, np.uint64)
    np.multiply.accumulate(np.full(n, base, np.uint64), out=powers[1:])
    # sum of c[i] * base ** i, so that a part's hash is a difference
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((c + np.uint64(1)) * powers[:-1], out=sums[1:])
    return powers, sums


def deletion_keys(line: str) -> tuple[int, np.ndarray]:
    """Hash of the line, and those of its variants with the character at each place deleted."""
    c = np.frombuffer(line.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    whole, cut = [], []
    for base, inverse in ((_B1, _I1), (_B2, _I2)):
        _, sums = _running(c, base)
        whole.append(sums[-1:])
        # what follows the deleted place moves one power down
        cut.append(sums[:-1] + (sums[-1] - sums[1:]) * inverse)
    return int(_mixed(*whole)[0]), _mixed(*cut)


_I1, _I2 = (np.uint64(pow(int(b), -1, 1 << 64)) for b in (_B1, _B2))


def within_one_edit(a: str, b: str) -> bool:
    """Whether one edit at most turns one string into the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[p + (len(a) == len(b)) :] == b[p + 1 :]


def _variants(candidates: DataFrame) -> DataFrame:
    """``key``, ``place`` (-1: the whole line), ``h1``, ``h2`` and ``first`` from lines with the sides they share."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (line, sides) in enumerate(zip(batch["line"].to_pylist(), batch["sides"].to_pylist(), strict=True)):
                whole, cut = deletion_keys(line)
                n, half = len(line), (len(line) - 1) // 2
                low, high = (0 if sides & 2 else half), (n if sides & 1 else n - half)
                places = np.append(np.arange(low, high), -1).astype(np.int32)
                size = len(places)
                row = [pa.array(np.append(cut[low:high], whole)), pa.array(places), *(pa.array(np.full(size, batch[c][i].as_py()), pa.int64()) for c in ("h1", "h2", "seq"))]
                yield pa.RecordBatch.from_arrays(row, ["key", "place", "h1", "h2", "seq"])

    return candidates.select("line", "sides", "h1", "h2", "seq").mapInArrow(work, "key long, place int, h1 long, h2 long, seq long")


def _texts_of(met: DataFrame) -> DataFrame:
    """``h1``, ``h2``, ``sides``, ``first`` (its place) and ``line`` of each of the ``lines`` wanted of a text, which is split once."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for doc_id, text_key, text, lines in zip(*(batch[c].to_pylist() for c in ("doc_id", "text_key", "text", "lines")), strict=True):
            split = text.split("\n")
            out += [(x["h1"], x["h2"], x["sides"], {"doc_id": doc_id, "text_key": text_key, "line_no": x["line_no"]}, split[x["line_no"]].strip(" ")) for x in lines]
        place = pa.struct([("doc_id", pa.int64()), ("text_key", pa.int64()), ("line_no", pa.int32())])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), place, pa.string()), strict=True)], ["h1", "h2", "sides", "first", "line"])

    return met.select("doc_id", "text_key", "text", "lines").mapInArrow(per_slice(work), "h1 long, h2 long, sides int, first struct<doc_id:long,text_key:long,line_no:int>, line string")


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each line to drop: ``doc_id``, ``text_key``, ``line_no``, ``keep_doc_id``, ``keep_line_no``, ``distance`` (0 or 1).

    Of several earlier lines, an equal one is named first, then the earliest within one edit.
    """
    # hashes of all lines, then one row for each distinct line: written once, read by all that follows
    lines = written(_lines(docs, min_chars), "lines")
    distinct = written(lines.groupBy("h1", "h2").agg(F.min(F.struct(*_PLACE)).alias("first"), F.count(F.lit(1)).alias("n"), F.first("halves").alias("halves")), "distinct-lines")

    halves = distinct.select("h1", F.explode("halves").alias("half")).select("h1", "half.key", "half.side")
    shared = halves.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where(F.col("low") != F.col("high")).select("key")
    sides = halves.join(shared, "key", "left_semi").unionByName(halves.where("key is null").select("key", "h1", "side")).groupBy("h1").agg(F.bit_or("side").alias("sides"))
    wanted = distinct.join(sides, "h1").groupBy(F.col("first.doc_id").alias("of"), F.col("first.text_key").alias("of_key")).agg(F.collect_list(F.struct(F.col("first.line_no").alias("line_no"), "h1", "h2", "sides")).alias("lines"))
    texts = keyed_text_of(docs).join(wanted, (F.col("text_key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of")))
    near = _near(written(_texts_of(texts).dropDuplicates(["h1", "h2"]), "candidate-lines"))
    place = F.struct(*_PLACE)
    equal = lines.select(*_PLACE, "h1", "h2").join(distinct.where("n > 1").select("h1", "h2", "first"), ["h1", "h2"]).where(place != F.col("first"))
    equal = equal.select(*_PLACE, F.col("first.doc_id").alias("keep_doc_id"), F.col("first.line_no").alias("keep_line_no"), F.lit(0).alias("distance"))
    near = near.select(*(F.col(f"first.{c}").alias(c) for c in _PLACE), F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.line_no").alias("keep_line_no"), F.lit(1).alias("distance"))
    return equal.unionByName(near).distinct()


def _near(candidates: DataFrame) -> DataFrame:
    """``first`` of each distinct line that has an earlier one within one edit, and ``keep``, the earliest such.

    ``seq`` stands for ``first`` in the groups, as an order that fits one number: the rank of the
    candidate among all candidates, from their ranges of ``first``.
    """
    ranked = _with_order(candidates)
    variants = _variants(ranked)
    whole = variants.where("place < 0").select("key", "h1", "h2", "seq")
    cut = variants.where("place >= 0")
    # one changed character: equal variants with the same place deleted
    changed = cut.groupBy("key", "place").agg(F.min("seq").alias("keep"), F.max("seq").alias("last")).where("keep < last").select("key", "place", "keep")
    by_change = cut.join(changed, ["key", "place"]).where("keep < seq").select("seq", "keep")
    # one character more or less
    met = cut.join(whole.select("key", F.col("seq").alias("shorter")), "key")
    longer_later = met.where("shorter < seq").select("seq", F.col("shorter").alias("keep"))
    shorter_later = met.groupBy("shorter").agg(F.min("seq").alias("keep")).where("keep < shorter").select(F.col("shorter").alias("seq"), "keep")
    earliest = by_change.unionByName(longer_later).unionByName(shorter_later).groupBy("seq").agg(F.min("keep").alias("keep"))
    one = ranked.select(F.col("seq").alias("s"), "first", "line")
    other = ranked.select(F.col("seq").alias("k"), F.col("first").alias("keep_first"), F.col("line").alias("keep_line"))
    pairs = earliest.join(one, F.col("seq") == F.col("s")).join(other, F.col("keep") == F.col("k"))
    return pairs.where(F.levenshtein("line", "keep_line", 1) >= 0).select("first", F.col("keep_first").alias("keep"))


def _with_order(candidates: DataFrame) -> DataFrame:
    """``seq``: a number for each candidate that orders them as ``first`` does.

    Candidates are dealt by ranges of ``first`` and numbered within each range; the range's number
    stands above, so nothing passes through one task.
    """
    shards = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(candidates.repartitionByRange(shards, "first").sortWithinPartitions("first").withColumn("seq", F.monotonically_increasing_id()), "ordered-lines")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """All columns of ``docs``, with repeated lines taken out of ``text`` and ``n_chars`` (if there) made to fit."""
    return _without(docs, repeated_lines(docs, min_chars), _free_name(docs)).select(*docs.columns)


def _free_name(docs: DataFrame) -> str:
    """A column name that ``docs`` hasn't got."""
    name = "dropped_lines"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _without(docs: DataFrame, repeated: DataFrame, dropped: str) -> DataFrame:
    """``docs`` without the repeated lines, and the column ``dropped`` with their numbers; a row's lines are those of its id and text."""
    drop = repeated.groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias(dropped))
    joined = docs.join(drop, (text_key_of(docs["text"]) == drop["text_key"]) & docs["doc_id"].cast("long").eqNullSafe(drop["doc_id"]), "left").select(*(docs[c] for c in docs.columns), drop[dropped])
    numbers, whole = F.col(dropped), F.col(dropped).isNull()
    # the lines are split once, as the one element that the outer function is given, and those that stay are told by hash
    left = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), numbers)
    kept = F.transform(F.array(F.split("text", "\n")), lambda lines: F.array_join(F.transform(left(lines), lambda i: F.get(lines, i)), "\n"))[0]
    out = joined.withColumn("text", F.when(whole, F.col("text")).otherwise(kept))
    return out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in docs.columns else out


def dedup_table(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped``, ``dropped`` (line numbers, joined by commas) and ``text`` without them."""
    plain = text_of(docs).withColumn("n_lines", F.size(F.split("text", "\n")).cast("long"))
    out = _without(plain, repeated_lines(docs, min_chars), "dropped_lines")
    numbers = F.coalesce(F.array_join(F.transform(F.array_sort("dropped_lines"), lambda n: n.cast("string")), ","), F.lit(""))
    return out.select("doc_id", "n_lines", F.coalesce(F.size("dropped_lines"), F.lit(0)).cast("long").alias("n_dropped"), numbers.alias("dropped"), "text")


def oracle_sql(documents: str = "documents", min_chars: int = MIN_CHARS) -> str:
    """The drops by comparing every distinct line with every other of about its length.

    This dialect's ``levenshtein`` counts bytes, of which one edit changes four at most; characters are compared after it.
    """
    return f"""
WITH l AS (SELECT doc_id, coalesce(text, '') AS text, CAST('0x' || left(md5(coalesce(text, '')), 15) AS BIGINT) AS text_key, string_split(coalesce(text, ''), chr(10)) AS ls FROM {documents}),
x AS (SELECT doc_id, text_key, unnest(ls) AS raw, generate_subscripts(ls, 1) - 1 AS line_no FROM (SELECT DISTINCT doc_id, text_key, ls FROM l)),
t AS (SELECT doc_id, text_key, line_no, trim(raw, ' ') AS line, length(trim(raw, ' ')) AS n FROM x WHERE trim(raw, ' ') <> ''),
r AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_key, line_no) AS place FROM t),
u AS (SELECT line, n, min(place) AS first FROM r GROUP BY line, n),
bytes AS (SELECT a.line, b.line AS other, a.n, b.n AS m FROM u a JOIN u b ON a.n >= {min_chars} AND b.n >= {min_chars} AND b.n BETWEEN a.n - 1 AND a.n + 1 AND b.first < a.first AND levenshtein(a.line, b.line) <= 4),
near AS (SELECT DISTINCT line FROM (SELECT line, n, m, CASE WHEN n > m THEN line ELSE other END AS p, CASE WHEN n > m THEN other ELSE line END AS q FROM bytes)
  WHERE CASE WHEN n = m THEN len(list_filter(range(1, n + 1), lambda i: p[i] <> q[i])) <= 1 ELSE len(list_filter(range(greatest(n, m)), lambda i: left(p, i) || substr(p, i + 2) = q)) > 0 END),
d AS (SELECT doc_id, text_key, line_no FROM r JOIN u USING (line) LEFT JOIN near USING (line) WHERE place <> u.first OR near.line IS NOT NULL),
g AS (SELECT doc_id, text_key, list_sort(list(line_no)) AS dropped FROM d GROUP BY ALL)
SELECT l.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(len(dropped), 0) AS BIGINT) AS n_dropped, coalesce(array_to_string(dropped, ','), '') AS dropped,
  CASE WHEN dropped IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda s, i: NOT list_contains(dropped, i - 1)), chr(10)) END AS text
FROM l LEFT JOIN g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.text_key = g.text_key
"""


ORACLE = oracle_sql()
