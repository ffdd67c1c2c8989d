"""Keywords as the list has them: A-Z folded, ``%`` and ``_`` as wildcards; their literal runs and trigrams."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from jobscope.functions.batches import mapped, parts

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM = 3

_FOLD = str.maketrans(UPPER, LOWER)


def folded(text: Column) -> Column:
    """Text with only A-Z lower-cased."""
    return F.translate(text, UPPER, LOWER)


def literal_runs(keyword: str) -> list[str]:
    """The folded keyword cut at its wildcards, without runs that are too short to have a trigram."""
    return [r for r in re.split("[%_]", keyword.translate(_FOLD)) if len(r) >= GRAM]


def grams(run: str) -> list[str]:
    return sorted({run[i : i + GRAM] for i in range(len(run) - GRAM + 1)})


#: Rows of trigrams that are held at once, besides those of one text.
HELD = 1 << 16


def gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A ``mapInArrow`` function: ``id`` and each distinct trigram of the folded ``text``, in batches of bounded size."""
    for batch in batches:
        ids, begin = batch.column("id"), 0
        for part in parts(batch.column("text")):
            at: list[int] = []
            found: list[str] = []
            for n, t in enumerate(part.to_pylist(), begin):
                own = grams((t or "").translate(_FOLD))
                at += [n] * len(own)
                found += own
                if len(at) >= HELD:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(found)], ["id", "gram"])
                    at, found = [], []
            begin += len(part)
            if at:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(found)], ["id", "gram"])


def runs_in(texts: Column, runs: Iterable[str]) -> Column:
    """Which of the (folded) ``runs`` stand in a folded text: one pass over it, however many there are."""
    by_gram: dict[str, list[str]] = defaultdict(list)
    for run in sorted(set(runs)):
        by_gram[run[:GRAM]].append(run)
    starts = dict(by_gram)

    @F.arrow_udf(ArrayType(StringType()))
    def found(array: pa.Array) -> pa.Array:
        def one(t: str | None) -> list[str]:
            text, out = t or "", set()
            for i in range(len(text) - GRAM + 1):
                for run in starts.get(text[i : i + GRAM], ()):
                    if text.startswith(run, i):
                        out.add(run)
            return sorted(out)

        return mapped(array, one, pa.list_(pa.string()))

    return found(texts)
