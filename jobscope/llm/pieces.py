"""SentencePiece encoding and decoding through a table of distinct marked words.

In a piece model where no piece has a white-space mark after another character, merges never cross
the place before a mark, so the ids of a text are the ids of its marked words put together. Each
Python worker keeps a table of the distinct marked words it has met, has the library segment those
that are new, and joins the ids back by position. The table is bounded, so it isn't one table for the
whole corpus: a word is segmented once in each worker, and again if it was rare enough to be put out.
Per-row maps only: no shuffle, nothing broadcast but the model's path.

Cases: a null text counts as empty, whose ids are the begin and end ids alone; runs of spaces stay
with the word after them; repeated rows and null ids are kept as they are.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from jobscope.llm.common import GROUP, WordTable, per_slice, text_of

MAX_WORDS = 300_000
MARK = "\u2581"
_RUNS = re.compile(" +[^ ]*")


class PieceTable:
    """Distinct marked words and their ids under one model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece of this model crosses white space")
        #: A single trailing mark; the library gives nothing for the empty word.
        self.lone = np.array([self.library.piece_to_id(MARK)], "<u4").tobytes()
        self.words = WordTable(self._segment, MAX_WORDS)
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()

    def marked(self, text: str) -> list[str]:
        """The text's marked words, each without its first mark."""
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " in text or text.startswith(" "):
            return [x[1:] for x in _RUNS.findall(" " + text)]
        return text.split(" ") if text else []

    def _segment(self, new: list[str]) -> list[bytes]:
        ids = self.library.encode(new, num_threads=1)
        return [np.array(x, "<u4").tobytes() if w else self.lone for w, x in zip(new, ids, strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, with the begin and end ids."""
        begin, end = (np.array([i], "<u4").tobytes() for i in (self.begin, self.end))
        found: list[bytes] = []
        for at in range(0, len(texts), GROUP):
            found += self.words.joined([self.marked(t) for t in texts[at : at + GROUP]])
        return [np.frombuffer(begin + ids + end, "<u4") for ids in found]

    def decode(self, ids: np.ndarray) -> str:
        """The library's own decoding."""
        return self.library.decode(ids.tolist())


_TABLES: dict[str, PieceTable] = {}


def piece_table(path: str) -> PieceTable:
    """One table for each model file and Python worker."""
    if path not in _TABLES:
        _TABLES[path] = PieceTable(path)
    return _TABLES[path]


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id`` and ``ids``, an array of all ids of the whole text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = piece_table(model).encode(batch["text"].to_pylist())
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return text_of(docs).mapInArrow(per_slice(work), "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id`` and ``text`` from ``encode_pieces``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = piece_table(model)
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([table.decode(np.array(x or [], np.int64)) for x in batch["ids"].to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(per_slice(work), "doc_id long, text string")


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every whole text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = piece_table(model)
        ids = table.encode(batch["text"].to_pylist())
        digest = [hashlib.sha256(x.tobytes()).hexdigest() for x in ids]
        decoded = [hashlib.sha256(table.decode(x).encode()).hexdigest() for x in ids]
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(x) for x in ids], pa.int64()), pa.array(digest), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return text_of(docs).mapInArrow(per_slice(work), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenized(docs: DataFrame, model: str) -> DataFrame:
    """A training table: all columns of ``docs`` but ``text``, and ``n_tokens``, ``ids`` and ``round_trip`` (whether decoding gives the text back).

    Columns of ``docs`` with one of these three names give way to them.
    """
    own = StructType.fromDDL("n_tokens long, ids array<int>, round_trip boolean")
    kept = [c for c in docs.columns if c.lower() not in ("text", *(f.name for f in own))]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = piece_table(model)
        texts = [t or "" for t in batch["text"].to_pylist()]
        ids = table.encode(texts)
        sizes = np.array([len(x) for x in ids], np.int64)
        offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids).astype(np.int32)))
        same = [table.decode(x) == t for x, t in zip(ids, texts, strict=True)]
        return pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(sizes), lists, pa.array(same)], [*kept, *(f.name for f in own)])

    schema = StructType([docs.schema[c] for c in kept] + own.fields)
    return docs.select(*kept, docs["text"].alias("text")).mapInArrow(per_slice(work), schema)
