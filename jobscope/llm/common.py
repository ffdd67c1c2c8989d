"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of texts, that a Python operator handles at once (one row at least).
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20

#: Texts whose new words a ``WordTable`` learns together.
GROUP = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, by a path that only Spark needs to open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text as the empty one; further columns can't clash."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def text_key_of(text: Column) -> Column:
    """60 bits of the text's md5 as a number, a null text as the empty one: with the id it says which row is meant."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long")


def keyed_text_of(docs: DataFrame) -> DataFrame:
    """``text_of`` with ``text_key``."""
    return text_of(docs).withColumn("text_key", text_key_of(F.col("text")))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of bounded rows and bytes."""
    sizes = [0] * batch.num_rows
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes = [a + (b or 0) for a, b in zip(sizes, pc.binary_length(column).to_pylist(), strict=True)]
    begin = held = 0
    for at, size in enumerate(sizes):
        if at > begin and (held + size > SLICE_BYTES or at - begin >= SLICE_ROWS):
            yield batch.slice(begin, at - begin)
            begin, held = at, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def per_slice(work: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function that applies ``work`` to slices of bounded rows and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out

    return run


#: Longest word that a ``WordTable`` keeps, and characters of words that one of its generations holds.
KEPT_CHARS, HELD_CHARS = 64, 8 << 20


class WordTable:
    """What a function gives for distinct words, worked out once each and bounded in size.

    ``learn`` takes a list of new words and gives their values, whose size follows the word's. Two
    generations of at most ``most`` words and ``HELD_CHARS`` characters are kept; when the younger is
    full it becomes the older, so that frequent words stay. Words of more than ``KEPT_CHARS`` characters
    (texts without spaces, encoded data) are worked out each time they are met, and never kept.
    """

    def __init__(self, learn: Callable[[list[str]], list[bytes]], most: int) -> None:
        self.learn, self.most = learn, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.chars = 0

    def get(self, word: str) -> bytes | None:
        """A word's value, if it is kept."""
        value = self.young.get(word)
        return self.old.get(word) if value is None else value

    def joined(self, lists: list[list[str]]) -> list[bytes]:
        """For each list, the values of its words put together in their order; new words are learned in one go."""
        words = set().union(*lists)
        missing = words.difference(self.young)
        long = [w for w in missing if len(w) > KEPT_CHARS]
        missing.difference_update(long)
        chars = sum(map(len, missing))
        if len(self.young) + len(missing) > self.most or self.chars + chars > HELD_CHARS:
            self.old, self.young = self.young, {}
            missing, self.chars = words.difference(long), 0
            chars = sum(map(len, missing))
        self.chars += chars
        young, old = self.young, self.old
        new = []
        for w in missing:
            value = old.get(w)
            if value is None:
                new.append(w)
            else:
                young[w] = value
        if new:
            young.update(zip(new, self.learn(new), strict=True))
        if not long:
            return [b"".join(map(young.__getitem__, words)) for words in lists]
        once = dict(zip(long, self.learn(long), strict=True))
        return [b"".join(young[w] if w in young else once[w] for w in words) for words in lists]
