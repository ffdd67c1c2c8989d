"""Vectors as short codes: product quantization in whole numbers, nearest entries by annular norm pruning.

A component x becomes floor(256 * x), and a vector is cut into ``parts`` equal consecutive parts, each
with a codebook of its own. Codebooks start as the parts of the vectors of smallest id and are moved
``rounds`` times to the floor of the mean of the parts nearest to each entry; entries that no part is
nearest to stay. A vector's code is the number of the nearest entry in each part.

The nearest entry is found exactly: entries are sorted by norm; the distance of the best of the few
entries whose norms are next to the part's own bounds the norms that a nearer entry can have (norms of
two vectors differ by their distance at most), the annulus between these bounds is found by binary
search, bounds included, and only its entries are measured. Ties go to the entry of lower number.

Each round reads the vectors once and keeps, in each task, one sum for each entry and component; these
are added up by Spark, and the driver gets as many numbers as the codebooks have. Nothing is shuffled
for each vector but by ``label_error``.

Cases: rows whose vector is null or holds a null, NaN or infinite component are dropped; so are vectors
without components and those of another length than most (of equally frequent lengths the largest
counts); a length that ``parts`` doesn't divide gives parts that differ by one component; whole numbers
are held within +-2**25 (components of +-131,072), so that squares fit; of rows that share an id the one of smaller vector
comes first, and rows without one come last; where fewer vectors than entries are kept, codebooks are so
much smaller; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope.store import written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE, BOUND = 256, 1 << 25

#: Rows of which a task measures the annuli at once, and entries next in norm that give the first bound.
ROWS, NEXT = 4096, 4

#: Labels up to which their sums are broadcast.
MAX_BROADCAST_LABELS = 100_000


@dataclass(frozen=True)
class Codebooks:
    """The entries of each part, as arrays of entries by components."""

    entries: tuple[np.ndarray, ...]

    @property
    def dimension(self) -> int:
        return sum(e.shape[1] for e in self.entries)

    def sha256(self) -> str:
        """Of all components as decimal numbers, by part, entry and place."""
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()


def _cuts(dimension: int, parts: int) -> list[int]:
    return [k * dimension // parts for k in range(parts + 1)]


def _whole(column: pa.Array, dimension: int) -> np.ndarray:
    """A batch's vectors as whole numbers."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
    return np.clip(np.floor(values * SCALE), -BOUND, BOUND).astype(np.int64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest entry of each row, and its squared distance."""
    k = len(entries)
    squares = lambda a: np.einsum("ij,ij->i", a, a)
    norms = np.sqrt(squares(entries).astype(np.float64))
    number = np.argsort(norms, kind="stable")
    norms, entries = norms[number], entries[number]
    own = np.sqrt(squares(x).astype(np.float64))
    at = np.searchsorted(norms, own)
    best = np.min([squares(x - entries[np.clip(at + step, 0, k - 1)]) for step in range(-NEXT // 2, NEXT // 2)], axis=0)
    far = np.sqrt(best.astype(np.float64))
    slack = 1e-9 * (own + far) + 1e-9  # of the roots' rounding
    low, high = np.searchsorted(norms, own - far - slack, "left"), np.searchsorted(norms, own + far + slack, "right")
    sizes = high - low
    begins = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(x)), sizes)
    entry = np.arange(len(row)) - np.repeat(begins - low, sizes)
    distance = squares(x[row] - entries[entry])
    least = np.minimum.reduceat(distance, begins)
    found = np.minimum.reduceat(np.where(distance == np.repeat(least, sizes), number[entry], k), begins)
    return found, least


def _assigned(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Codes of whole vectors (rows by parts), and the squared distances summed over the parts."""
    cuts = np.cumsum([0, *(e.shape[1] for e in books.entries)])
    codes, error = np.zeros((len(x), len(books.entries)), np.int64), np.zeros(len(x), np.int64)
    for begin in range(0, len(x), ROWS):
        rows = slice(begin, begin + ROWS)
        for p, entries in enumerate(books.entries):
            codes[rows, p], distance = nearest(x[rows, cuts[p] : cuts[p + 1]], entries)
            error[rows] += distance
    return codes, error


def kept_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id``, ``label`` and ``vector`` (of doubles) of the rows that are kept, all of one length."""
    v = F.col("vector")
    plain = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), embeddings["label"].alias("label"), embeddings["embedding"].cast("array<double>").alias("vector"))
    finite = plain.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))  # NaN counts as larger
    lengths = finite.groupBy(F.size(v).alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    return finite.where(F.size(v) == (lengths["length"] if lengths else 0))


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of ``kept_vectors``; none if there are no rows."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()["vector"].combine_chunks()
    if not len(first):
        return None
    dimension = len(first[0])
    cuts = _cuts(dimension, parts)
    begun = _whole(first, dimension)
    books = Codebooks(tuple(begun[:, a:b].copy() for a, b in zip(cuts, cuts[1:], strict=False)))
    for _ in range(rounds):
        books = _moved(kept, books)
    return books


def _moved(kept: DataFrame, books: Codebooks) -> Codebooks:
    """Codebooks after one round."""
    k, dimension, width = len(books.entries[0]), books.dimension, len(books.entries)
    part_of = np.repeat(np.arange(width), [e.shape[1] for e in books.entries])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dimension), np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            x = _whole(batch["vector"], dimension)
            codes, _ = _assigned(x, books)
            for p in range(width):
                counts[:, p] += np.bincount(codes[:, p], minlength=k)
                np.add.at(sums, (codes[:, p, None], np.flatnonzero(part_of == p)[None]), x[:, part_of == p])
        entry, place = np.nonzero(counts[:, part_of])
        if len(entry):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (entry, place, sums[entry, place], counts[entry, part_of[place]])], ["entry", "place", "total", "n"])

    added = kept.select("vector").mapInArrow(work, "entry long, place long, total long, n long").groupBy("entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
    entry, place, total, n = (added[c].to_numpy() for c in ("entry", "place", "total", "n"))
    whole = np.concatenate(books.entries, axis=1)
    whole[entry, place] = total // n
    cuts = np.cumsum([0, *(e.shape[1] for e in books.entries)])
    return Codebooks(tuple(whole[:, a:b].copy() for a, b in zip(cuts, cuts[1:], strict=False)))


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id``, ``label``, ``code`` (two hex digits for each part) and ``error`` of ``kept_vectors``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, error = _assigned(_whole(batch["vector"], books.dimension), books)
                hexes = [row.tobytes().hex() for row in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array(hexes), pa.array(error)], ["vec_id", "label", "code", "error"])

    return kept.select("vec_id", "label", "vector").mapInArrow(work, f"vec_id long, label {kept.schema['label'].dataType.simpleString()}, code string, error long")


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """All columns of ``codes`` and ``vector``, the entries that ``code`` names, put together and scaled back."""
    book = F.lit([[[x / SCALE for x in e] for e in part.tolist()] for part in books.entries])
    part = lambda k: F.conv(F.substring("code", 2 * k + 1, 2), 16, 10).cast("int")
    return codes.withColumn("vector", F.concat(*(book[k][part(k)] for k in range(len(books.entries)))))


def code_table(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error`` (summed over equal labels, nulls together) and ``codebooks_sha256``."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits for each part: at most 256 entries")
    kept = kept_vectors(embeddings)
    books = train(kept, parts, entries, rounds)
    if books is None:
        return embeddings.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    codes = written(encode(kept, books), "codes")
    sums = written(codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    sums = F.broadcast(sums) if sums.count() <= MAX_BROADCAST_LABELS else sums
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def oracle_sql(embeddings: str = "embeddings", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same with every part held against every entry."""
    steps = [
        f"""v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v, len(embedding) AS d
  FROM {embeddings} WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, p, v[p * d // {parts} + 1:(p + 1) * d // {parts}] AS x FROM v, range({parts}) t(p)),
b0 AS (SELECT p, r - 1 AS i, x AS e FROM p WHERE r <= {entries})"""
    ]
    for k in range(rounds + 1):
        steps.append(f"a{k} AS (SELECT r, p, any_value(x) AS x, min(list_sum(list_transform(range(1, len(x) + 1), lambda j: (x[j] - e[j]) * (x[j] - e[j]))) * 256 + i) AS best FROM p JOIN b{k} USING (p) GROUP BY r, p)")
        if k < rounds:
            steps.append(f"""s{k} AS (SELECT p, i, j, sum(x) AS s, count(*) AS n FROM (SELECT p, CAST(best % 256 AS BIGINT) AS i, unnest(x) AS x, generate_subscripts(x, 1) AS j FROM a{k}) GROUP BY ALL),
m{k} AS (SELECT p, i, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS e FROM s{k} GROUP BY p, i),
b{k + 1} AS (SELECT p, i, coalesce(m{k}.e, b{k}.e) AS e FROM b{k} LEFT JOIN m{k} USING (p, i))""")
    return f"""WITH {", ".join(steps)},
c AS (SELECT r, string_agg(printf('%02x', CAST(best % 256 AS INT)), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, i, j)) AS codebooks_sha256 FROM (SELECT p, i, unnest(e) AS x, generate_subscripts(e, 1) AS j FROM b{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN v USING (r), h"""


ORACLE = oracle_sql()
