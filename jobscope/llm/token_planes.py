"""Token ids in files of bit planes.

Ids of all documents, in ascending ``doc_id`` order, are cut into blocks of fixed size. A block is
transposed into byte planes (smaller and faster here) or bit planes, each plane is compressed with
zstandard, and planes
above the highest set bit are left out. Blocks are rows of a Parquet table; beside its planes, a row
carries its part of the chunk index: shard, block number, first id, number of ids, plane kind, and
which documents begin in it. Readers that need the index read those columns only.

Documents are dealt by ranges of ``doc_id``, so that a shard is one task and no shard grows with a
hot source; text is encoded after the exchange, and each task holds one block at a time.

Cases: a null text counts as empty and has the end id alone; null ``doc_id`` come first; rows that
repeat a ``doc_id`` are documents of their own, ordered by text; an empty table gives an empty table.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobscope.llm.common import GROUP, WordTable, text_of
from jobscope.llm.token_counts import byte_letters

BLOCK_IDS = 65536
MAX_WORDS = 450_000

#: Separators that Python's ``split`` knows as white space and the tokenizer file doesn't.
_OTHER_SPACES = ("\x1c", "\x1d", "\x1e", "\x1f")

#: Marks that the tokenizer file always makes an id of their own after a letter.
MARKS = ".,;:!?|"

BLOCKS = "shard int, block int, first long, n_ids int, kind string, planes array<binary>, doc_ids array<long>, doc_at array<long>"
_BLOCK_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64())]
_BLOCK_NAMES = [x.split()[0] for x in BLOCKS.split(", ")]


def _latin(text: str) -> bool:
    """Whether every character is of Latin-1, where lower case depends on the character alone."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordEncoder:
    """Encodes through the library word by word: no id of this kind of tokenizer crosses white space.

    A new word of lower-case letters needs none of the file's normalizing and splitting, and goes to
    the library's model alone; one mark after such a word is always an id of its own.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        #: The letter that stands for each byte in the vocabulary, by the byte read as Latin-1.
        self.letters = dict(enumerate(byte_letters()))
        self.marks = dict(zip(MARKS, self._library(list(MARKS)), strict=True))
        self.words = WordTable(self._learn, MAX_WORDS)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _model_alone(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _learn(self, new: list[str]) -> list[bytes]:
        values: dict[str, bytes | None] = {}
        other = []
        for w in new:
            core = w[:-1] if w[-1] in MARKS else w
            if core.isalpha() and core.islower() and _latin(core):
                values[core] = self.words.get(core)
            else:
                other.append(w)
        if plain := [w for w, known in values.items() if known is None]:
            values.update(zip(plain, map(self._model_alone, plain), strict=True))
        whole = dict(zip(other, self._library(other), strict=True)) if other else {}
        return [whole[w] if w in whole else values[w] if w in values else values[w[:-1]] + self.marks[w[-1]] for w in new]

    def _split(self, text: str) -> list[str] | None:
        if any(c in text for c in _OTHER_SPACES):
            return None
        if "<|" not in text and _latin(text):  # the file lowers case itself; lowered first, more words are alike
            text = text.lower()
        return text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        split = [self._split(t) for t in texts]
        found = self.words.joined([w or [] for w in split])
        return [ids if w is not None else self._library([t])[0] for t, w, ids in zip(texts, split, found, strict=True)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each tokenizer file and Python worker, without threads of its own."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def to_planes(ids: np.ndarray, kind: str = "bit") -> list[bytes]:
    """Compressed planes of a block, lowest first; as many as its largest id needs."""
    pack = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
    ids = np.ascontiguousarray(ids, "<u4")
    bits = int(ids.max()).bit_length() if len(ids) else 0
    if kind == "byte":
        raw = ids.view(np.uint8).reshape(-1, 4)
        return [pack(np.ascontiguousarray(raw[:, k]).tobytes()) for k in range(-(-bits // 8))]
    narrow = ids.astype(np.uint16) if bits <= 16 else ids
    return [pack(np.packbits((narrow >> k & 1).astype(np.uint8), bitorder="little").tobytes()) for k in range(bits)]


def from_planes(planes: list[bytes], n: int, kind: str = "bit") -> np.ndarray:
    """The ids of a block."""
    unpack = zstandard.ZstdDecompressor().decompress
    out = np.zeros(n, "<u4")
    for k, plane in enumerate(planes):
        raw = np.frombuffer(unpack(plane), np.uint8)
        if kind == "byte":
            out |= raw.astype(np.uint32) << np.uint32(8 * k)
        else:
            out |= np.unpackbits(raw, count=n, bitorder="little").astype(np.uint32) << np.uint32(k)
    return out


def write_token_planes(docs: DataFrame, path: str, tokenizer: str, end_id: int, kind: str = "byte", block_ids: int = BLOCK_IDS, shards: int | None = None) -> None:
    """Encode every text, append ``end_id`` to each, and write blocks of planes to ``path``."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = struct.pack("<I", end_id)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(tokenizer).encode, TaskContext.get().partitionId()
        held, size, number, first = [], 0, 0, 0
        doc_ids: list[int | None] = []
        doc_at: list[int] = []

        def block(data: bytes) -> pa.RecordBatch:
            ids = np.frombuffer(data, "<u4")
            here = sum(a < first + len(ids) for a in doc_at)
            row = [shard, number, first, len(ids), kind, to_planes(ids, kind), doc_ids[:here], doc_at[:here]]
            del doc_ids[:here], doc_at[:here]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _BLOCK_TYPES, strict=True)], _BLOCK_NAMES)

        for batch in batches:
            names, coded = batch["doc_id"].to_pylist(), (x for at in range(0, batch.num_rows, GROUP) for x in encode(batch["text"].slice(at, GROUP).to_pylist()))
            for doc_id, ids in zip(names, coded, strict=True):
                doc_ids.append(doc_id)
                doc_at.append(first + size // 4)
                held += [ids, end]
                size += len(ids) + 4
                if size >= 4 * block_ids:
                    data = b"".join(held)
                    for at in range(0, size - size % (4 * block_ids), 4 * block_ids):
                        yield block(data[at : at + 4 * block_ids])
                        number, first = number + 1, first + block_ids
                    held = [data[size - size % (4 * block_ids) :]]
                    size = len(held[0])
        if size:
            yield block(b"".join(held))

    # ids that many rows share, or null ones, are parted by their texts, and rows that are alike in both by a number
    keyed = text_of(docs).withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(shards, "doc_id", "_hash", "_row").sortWithinPartitions("doc_id", "_hash", "text")
    dealt.select("doc_id", "text").mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(path)


def shard_starts(stored: DataFrame) -> DataFrame:
    """``shard`` and ``before``: ids of all shards before it. One row for each shard."""
    sizes = stored.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    return sizes.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))


def _times(matrix: list[int], vector: int) -> int:
    out, k = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[k]
        vector >>= 1
        k += 1
    return out


def crc32_join(a: int, b: int, size: int) -> int:
    """The crc32 of two byte strings put together, from theirs and the second's length."""
    step = [0xEDB88320, *(1 << k for k in range(31))]  # one zero bit
    for _ in range(3):
        step = [_times(step, x) for x in step]  # one zero byte
    while size:
        if size & 1:
            a = _times(step, a)
        size >>= 1
        if size:
            step = [_times(step, x) for x in step]
    return a ^ b


def read_pieces(stored: DataFrame) -> DataFrame:
    """Decode the blocks: a row for each part of a document in a block.

    ``shard``, ``at`` (where the part begins in the shard), ``doc_id`` (of documents that begin with
    this part), ``begins``, ``n`` and ``crc``. A part that goes on from the block before has a null
    ``doc_id`` and ``begins`` false.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one block is decoded at a time; Spark bounds a batch in bytes
                row = batch.slice(i, 1).to_pylist()[0]
                ids = from_planes(row["planes"], row["n_ids"], row["kind"])
                raw = ids.astype("<u4").tobytes()
                starts = [x - row["first"] for x in row["doc_at"]]
                names: list[int | None] = list(row["doc_ids"])
                begins = [True] * len(starts)
                if not starts or starts[0] > 0:
                    starts, names, begins = [0, *starts], [None, *names], [False, *begins]
                ends = [*starts[1:], row["n_ids"]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * len(starts), pa.int32()),
                        pa.array([row["first"] + s for s in starts], pa.int64()),
                        pa.array(names, pa.int64()),
                        pa.array(begins, pa.bool_()),
                        pa.array([e - s for s, e in zip(starts, ends, strict=True)], pa.int64()),
                        pa.array([zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts, ends, strict=True)], pa.int64()),
                    ],
                    ["shard", "at", "doc_id", "begins", "n", "crc"],
                )

    return stored.select(*_BLOCK_NAMES).mapInArrow(work, "shard int, at long, doc_id long, begins boolean, n long, crc long")


def read_documents(spark, path: str) -> DataFrame:  # noqa: ANN001
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of each document, from the files."""
    stored = spark.read.schema(BLOCKS).parquet(path)
    pieces = read_pieces(stored)

    @F.pandas_udf("long")
    def joined(parts: pd.Series) -> pd.Series:
        def one(rows: list) -> int:
            crc = 0
            for r in sorted(rows, key=lambda r: r["at"]):
                crc = crc32_join(crc, int(r["crc"]), 4 * int(r["n"]))
            return crc

        return parts.map(one).astype("int64")

    # A part that goes on belongs to the last document that began in an earlier block of its shard: the index has it.
    earlier = Window.partitionBy("shard").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    carried = stored.select("shard", "first", F.try_element_at("doc_at", F.lit(-1)).alias("began")).select(F.col("shard"), F.col("first"), F.last("began", ignorenulls=True).over(earlier).alias("began"))
    goes_on = (pieces["shard"] == carried["shard"]) & (pieces["at"] == carried["first"]) & ~pieces["begins"]
    placed = pieces.join(carried, goes_on, "left").select(pieces["shard"], F.coalesce(F.when(~pieces["begins"], carried["began"]), pieces["at"]).alias("began"), "at", "doc_id", "n", "crc")
    documents = placed.groupBy("shard", "began").agg(F.max("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.min("crc").alias("crc"), F.collect_list(F.struct("at", "n", "crc")).alias("parts"))
    # few documents lie in several blocks; both branches read one exchange
    alone = documents.where(F.size("parts") == 1).select("shard", "began", "doc_id", "n_tokens", "crc")
    several = documents.where(F.size("parts") > 1).select("shard", "began", "doc_id", "n_tokens", joined("parts").alias("crc"))
    return alone.unionByName(several).join(shard_starts(stored), "shard").select("doc_id", (F.col("before") + F.col("began")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32"))
