"""Near-duplicate documents by Order MinHash and banded alignment.

A text's words (lower-cased, split at white space) give k-mers of five and of three words, each
labelled with its occurrence number. For each of several hash functions the two labelled k-mers of
least hash are kept *in their order in the text*; documents that agree in such an ordered pair share
a bucket, which favours texts with a small edit distance. Five-word k-mers alone miss most pairs near
the least similarity (a fifth of the words changed leaves a third of them), so most hash functions
look at three words. Texts of at most ``SHORT_WORDS`` words, in which one edit touches most k-mers, are
sketched with k-mers of two words as well. Candidates are verified by a banded alignment: two texts
are near if their word edit distance is at most ``1 - least`` of the longer one's length; words are
compared by 32-bit hashes, of which two different words share one in four billion. A document's
class is its connected component of verified links.

Scale: texts with equal words are one from the start (by a 128-bit hash). Buckets of one text go
first, and of buckets of the same texts all but one. Words are fetched from the table for the texts of
pairs that are to be compared, others stay where they lie: a bitmap of bounded size tells most of them.
A bucket, however large, is compared with one leader: the text of most company, as the one that others
were made from shares buckets with all of them. Texts that are near one hub are of one label and
needn't be compared. A bucket is done if all its texts are of one label, and texts near its leader
leave it if all those of other labels are far from the leader (so far that none of them can be near a
text that is). If what is left has at most ``FEW`` pairs of different labels for each text, these are
made as rows. A bucket with more of them is cut in chunks of bounded size, of which each meets each in
a group of its own: there all pairs are held against bounds that no near pair fails (length, and
words in common as counted in ``BINS``), and those that pass are aligned unless their labels are
linked already. So no two texts of a bucket are left out but by what rules them out; a large
bucket's time grows with the square of its texts, its memory and the rows made don't. ``lost_links``
compares the outcome with that of all pairs of every bucket.

Cases: null and empty texts have no words and are one class (they are equal); texts of fewer words
than a k-mer have one k-mer, all of them; texts with equal words are of one class, whatever their ids;
rows of one ``doc_id`` with different texts are different documents, each with its own class; null
ids keep a row, with the class of the texts near theirs (null if none of these has an id); ties are
broken by the smallest id; empty tables give no rows; further columns are passed on by ``keep_one``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import keyed_text_of, per_slice, text_key_of
from jobscope.operators.components import connected_components
from jobscope.store import written

#: Words of a k-mer and the number of hash functions for it, and what short texts have besides.
KMERS, SHORT_KMER, SHORT_WORDS = ((5, 16), (3, 32)), (2, 32), 40
PICKED, LEAST = 2, 0.8

#: Pairs of a bucket, for each of its rows, that are made as rows; where there are more, chunks are compared.
FEW = 8

#: Texts and words of a chunk (about, as texts are dealt by hash), and the counts that bound the words in common.
CHUNK, CHUNK_WORDS, BINS = 1024, 1 << 20, 256

_MOST = max(n for _, n in (*KMERS, SHORT_KMER))
_SEEDS, _TIMES = np.random.default_rng(20240607).integers(1, 2**63, (2, _MOST), dtype=np.uint64) | np.uint64(1)
_ODD = np.array([2 * int(x) + 1 for x in np.random.default_rng(11).integers(1, 2**62, 8)], np.uint64)

#: Half width of the band that is tried first.
NARROW = 30

#: Bits of a block of a bitmap (what ``bitmap_construct_agg`` makes), and blocks that a bitmap has at most (8 MB in all).
BLOCK_BITS, BLOCKS = 1 << 15, 1 << 11

#: k-mers whose hashes are held at once for all sketches.
STRIDE = 1 << 15


def words_of(text: str) -> np.ndarray:
    """A 32-bit hash of each word."""
    return np.fromiter(map(zlib.crc32, text.lower().encode("utf-8", "replace").split()), np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)


def labelled_kmers(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-mers with their occurrence numbers, in text order; one of all words where there are fewer than k."""
    w = words.astype(np.uint64)
    n = len(w) - k + 1
    if n < 1:
        return _mix(np.array([int((w * _ODD[: len(w)]).sum()) & 2**64 - 1], np.uint64)) if len(w) else np.zeros(0, np.uint64)
    h = _mix(sum((w[j : n + j] * _ODD[j] for j in range(1, k)), w[:n] * _ODD[0]))
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if same.any():
        starts = np.flatnonzero(np.append(True, ~same))
        number = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
        label = np.empty(n, np.uint64)
        label[order] = number
        h = np.where(label > 0, _mix(h + label * _ODD[7]), h)  # a first occurrence is alike in texts with and without repeats
    return h


def sketch(kmers: np.ndarray, salt: int, functions: int) -> np.ndarray:
    """For each hash function, one number for its two least k-mers in text order."""
    if not len(kmers):
        return np.zeros(0, np.int64)
    rows, seeds, times = np.arange(functions)[:, None], _SEEDS[:functions, None], _TIMES[:functions, None]
    at, least = [], []
    for start in range(0, len(kmers), STRIDE):
        hashes = (kmers[None, start : start + STRIDE] ^ seeds) * times
        for _ in range(min(PICKED, hashes.shape[1])):
            own = hashes.argmin(axis=1)[:, None]
            at.append(own + start)
            least.append(hashes[rows, own])
            hashes[rows, own] = np.uint64(2**64 - 1)
    at, least = np.concatenate(at, axis=1), np.concatenate(least, axis=1)
    best = np.argsort(least, axis=1, kind="stable")[:, :PICKED]
    places = np.sort(np.take_along_axis(at, best, axis=1), axis=1)
    key = _SEEDS[:functions] + np.uint64(salt)
    for j in range(places.shape[1]):
        key = _mix(key * _ODD[6] + kmers[places[:, j]])
    return key.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key`` (which row it is), ``content`` (hash of the words), ``n_words`` and ``keys`` of each document."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        content, size, keys = [], [], []
        for text in batch["text"]:
            text = text.as_py()
            words = words_of(text)
            sizes = (*KMERS, SHORT_KMER) if len(words) <= SHORT_WORDS else KMERS
            content.append(hashlib.blake2b(" ".join(text.lower().split()).encode("utf-8", "replace"), digest_size=16).digest())
            size.append(len(words))
            keys.append(np.concatenate([sketch(labelled_kmers(words, k), k, n) for k, n in sizes]))
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_key"], pa.array(content, pa.binary()), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_key", "content", "n_words", "keys"])

    return keyed_text_of(docs).mapInArrow(per_slice(work), "doc_id long, text_key long, content binary, n_words long, keys array<long>")


def _banded(a: list[int], b: list[int], band: int) -> int | None:
    """Edit distance of two lists, the first the longer, if it is ``band`` at most.

    Bit r of the vectors is row ``j - band + r`` of column j, so that only the band is held; the
    distance is followed on the diagonal that ends in the last cell, where it never falls.
    """
    places: dict[int, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    full = (1 << 2 * band + 1) - 1
    last = 1 << len(a) - len(b) + band
    up, down, distance = full >> band << band, 0, len(a) - len(b)
    for j, word in enumerate(b):
        match = places.get(word, 0)
        match = (match >> j - band if j >= band else match << band - j) & full
        free = (((match & up) + up) ^ up) | match | down
        right_up = down | full & ~(free | up)
        right_down = free & up
        if not free & last:
            distance += 1
            if distance > band:
                return None
        free = (free & full) >> 1
        up = (right_down | ~(free | right_up)) & full
        down = free & right_up
    return distance


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Words that two texts have in common, each as often as both have it."""
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    return int(np.minimum(ca[ia], cb[ib]).sum())


def edits_within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Word edit distance if it is ``most`` at most, by alignment in a band of that width (a narrow one first)."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return None
    differ = np.flatnonzero(a[: len(b)] != b)
    head = int(differ[0]) if len(differ) else len(b)
    a, b = a[head:], b[head:]
    differ = np.flatnonzero(a[len(a) - len(b) :] != b)
    tail = len(b) - 1 - int(differ[-1]) if len(differ) else len(b)
    x, y = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    narrow = max(NARROW, 2 * (len(x) - len(y)))
    found = _banded(x, y, min(most, narrow))
    return _banded(x, y, most) if found is None and most > narrow else found


NEAR, BETWEEN, FAR = 1, 0, -1


def relation(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> int:
    """``NEAR`` if the edit distance is at most ``1 - least`` of the longer one's length; ``FAR`` if no text that is near one can be near the other.

    Words without a partner each need an edit, so they bound the distance from below. A text near one
    has at most ``1 / least`` times its length, so it can't be near both if they are further apart
    than twice ``(1 - least) / least`` of the longer one.
    """
    longer = max(len(a), len(b))
    apart = longer - _common(a, b)
    most = int(longer * (1 - least) + 1e-9)
    if apart > most:
        return FAR if apart > 2 * longer * (1 - least) / least + 1e-9 else BETWEEN
    return BETWEEN if edits_within(a, b, most) is None else NEAR


def near(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether the edit distance of two word lists is at most ``1 - least`` of the longer one's length."""
    return relation(a, b, least) == NEAR


#: Bits of a weight that say how many words the node has; as many as they can hold, or more, are not told apart.
SIZE_BITS = 24

_PAIRS = "a long, b long, weight_a long, weight_b long, told int"


def _verified(pairs: DataFrame, texts: Texts, least: float) -> DataFrame:
    """Pairs with ``told``, their relation; where lengths alone tell that a pair isn't near, no words are fetched.

    Both ends' words of a pair are dealt out by the pair, so that a hub's many pairs lie apart.
    """
    mask = F.lit((1 << SIZE_BITS) - 1)
    longer, shorter = (f(F.col("weight_a").bitwiseAND(mask), F.col("weight_b").bitwiseAND(mask)) for f in (F.greatest, F.least))
    unlike = (shorter < longer * least - 1e-9) & (longer < mask)
    pairs = written(pairs.withColumn("told", F.when(unlike & (longer - shorter > 2 * longer * (1 - least) / least + 1e-9), FAR).when(unlike, BETWEEN)), "pairs")
    ends = pairs.where("told is null").select("a", "b", "weight_a", "weight_b", F.explode(F.array("a", "b")).alias("node"))
    both = _with_words(texts, ends).repartition("a", "b").sortWithinPartitions("a", "b", "node")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for batch in batches:
            rows: list[tuple] = []
            columns = [batch[c].to_pylist() for c in ("a", "b", "weight_a", "weight_b")]
            for pair, words in zip(zip(*columns, strict=True), batch["words"], strict=True):
                words = np.frombuffer(words.as_py(), np.uint32)
                if first is None:
                    first = words
                else:
                    rows.append((*pair, relation(first, words, least)))
                    first = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.int32()], strict=True)], ["a", "b", "weight_a", "weight_b", "told"])

    compared = both.select("a", "b", "weight_a", "weight_b", "words").mapInArrow(work, _PAIRS)
    return written(compared.unionByName(pairs.where("told is not null")), "verified")


def _perhaps_among(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` without most of those whose ``keys`` ``wanted`` hasn't got; none that it has is left out.

    A bitmap with a bit for a hash of the keys is broadcast, so nothing is shuffled. It has 16 bits or
    more for each wanted row as long as ``BLOCKS`` allow, then fewer: more rows pass, its size stays.
    """
    blocks = 1
    while blocks < BLOCKS and blocks * BLOCK_BITS < 16 * wanted.count():
        blocks *= 2
    place = F.pmod(F.xxhash64(*keys), F.lit(blocks * BLOCK_BITS))
    block, bit = F.floor(place / BLOCK_BITS).alias("block"), F.pmod(place, F.lit(BLOCK_BITS)).alias("bit")
    bitmap = wanted.select(block, bit).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(F.col("bit") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    met = rows.select("*", block, bit).join(F.broadcast(bitmap), "block")
    return met.where(F.getbit(byte, F.pmod("bit", F.lit(8)).cast("int")) == 1).select(*rows.columns)


class Texts(NamedTuple):
    """Where the nodes' words are fetched from: the documents, ``node``, ``doc_id`` and ``text_key`` of each, and whether rows repeat both id and text."""

    docs: DataFrame
    places: DataFrame
    repeated: bool


def _texts(docs: DataFrame, sketched: DataFrame, contents: DataFrame) -> Texts:
    again = sketched.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return Texts(docs, contents.select("node", "doc_id", "text_key"), not again.isEmpty())


def _with_words(texts: Texts, rows: DataFrame) -> DataFrame:
    """``rows`` with ``words`` (32-bit hashes) of their ``node``."""
    wanted = written(rows.join(texts.places, "node"), "wanted")
    found = _perhaps_among(keyed_text_of(texts.docs), wanted, ["doc_id", "text_key"])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_key"], pa.array([words_of(t).tobytes() for t in batch["text"].to_pylist()], pa.binary())], ["doc_id", "text_key", "words"])

    found = found.mapInArrow(per_slice(work), "doc_id long, text_key long, words binary")
    if texts.repeated:
        found = written(found.dropDuplicates(["doc_id", "text_key"]), "words")
    same = (F.col("t.text_key") == F.col("w.text_key")) & F.col("t.doc_id").eqNullSafe(F.col("w.doc_id"))
    # by shuffle at every size: what is wanted grows with the texts
    return found.alias("t").join(wanted.alias("w").hint("merge"), same).select(*(f"w.{c}" for c in rows.columns), "t.words")


def _set_of() -> list[Column]:
    """``set_1`` and ``set_2``, which say which nodes a group has."""
    return [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"set_{k}") for k in (1, 2)]


def _buckets(contents: DataFrame) -> DataFrame:
    """``node``, ``bucket`` and ``weight`` (how much company the node has, and in its low bits its words) of buckets with several nodes; of buckets of the same nodes there is one."""
    # dealt out once, for the counts and the join: counting nodes, both need the same columns
    rows = contents.select("node", F.explode("keys").alias("bucket")).repartition("bucket")
    shared = rows.groupBy("bucket").agg(F.count("node").alias("n")).where("n > 1")
    live = written(rows.join(shared, "bucket"), "buckets")
    company = live.groupBy("node").agg(F.sum("n").alias("n_shared"))
    sets = live.groupBy("bucket").agg(F.first("n").alias("n"), *_set_of())
    once = written(sets.groupBy("n", "set_1", "set_2").agg(F.min("bucket").alias("bucket")).select("bucket"), "once")
    # a node's buckets, of which there are no more than sketches, are put together, so that company and size are joined to a row a node
    own = live.join(once, "bucket").groupBy("node").agg(F.collect_list("bucket").alias("own"))
    sizes = contents.select("node", F.least("n_words", F.lit((1 << SIZE_BITS) - 1)).alias("size"))
    return own.join(company, "node").join(sizes, "node").select("node", F.explode("own").alias("bucket"), F.shiftleft("n_shared", SIZE_BITS).bitwiseOR(F.col("size")).alias("weight"))


def _pairs(rows: DataFrame, one: str, other: str, weight_one: str, weight_other: str) -> DataFrame:
    """``a`` < ``b`` and their weights, each pair once."""
    first = F.col(one) < F.col(other)
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return rows.select(pick(one, other).alias("a"), pick(other, one).alias("b"), pick(weight_one, weight_other).alias("weight_a"), pick(weight_other, weight_one).alias("weight_b")).distinct()


def _rank(weight: str, node: str) -> Column:
    """More company comes first, then the smaller number."""
    return F.struct(F.col(weight).alias("weight"), (-F.col(node)).alias("turned"))


def _labels(tried: DataFrame) -> DataFrame:
    """``node`` and ``label``: the greatest hub that it is near (or itself), that one's hub, and so on for four steps. Nodes of one label are of one class."""
    links = tried.where(F.col("told") == NEAR)
    sides = [links.select(F.col(x).alias("node"), F.greatest(_rank(f"weight_{x}", x), _rank(f"weight_{y}", y)).alias("top")) for x, y in ("ab", "ba")]
    hub = written(sides[0].unionByName(sides[1]).groupBy("node").agg(F.max("top").alias("top")).select("node", (-F.col("top.turned")).alias("label")), "hubs")
    for _ in range(2):
        on = hub.select(F.col("node").alias("label"), F.col("label").alias("next"))
        hub = hub.join(on, "label").select("node", F.col("next").alias("label"))
    return written(hub, "labels")


def _labelled(rows: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    own = labels.select(F.col("node").alias(node), F.col("label").alias("found"))
    return rows.join(own, node, "left").withColumn(name, F.coalesce("found", node)).drop("found")


def _met(buckets: DataFrame) -> DataFrame:
    """Rows of buckets of several labels with their leader, without the leaders themselves."""
    first = buckets.groupBy("bucket").agg(F.max(F.struct(_rank("weight", "node").alias("rank"), "label")).alias("top"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    # written, so that both sides of the join are dealt out for it and a hot bucket's rows can be split
    lead = written(first.select("bucket", (-F.col("top.rank.turned")).alias("lead"), F.col("top.rank.weight").alias("lead_weight"), F.col("top.label").alias("lead_label")), "leads")
    return written(buckets.join(lead, "bucket").where("node != lead"), "met")


def _rest(met: DataFrame, tried: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """Rows that may still be near one of another label in their bucket, with ``cross`` (pairs of different labels), ``n`` (rows), ``n_words`` (of all rows) and ``major`` (the label of most rows).

    Only buckets with a row that isn't near its leader need labels; one that is takes the leader's.
    """
    told = tried.select(F.col("a").alias("x"), F.col("b").alias("y"), "told")
    rows = met.withColumns({"x": F.least("lead", "node"), "y": F.greatest("lead", "node")}).join(told, ["x", "y"], "left").drop("x", "y").withColumn("told", F.coalesce("told", F.lit(BETWEEN)))
    rows = written(rows.drop("label", "lead_label"), "told")
    mixed = written(rows.groupBy("bucket").agg(F.min("told").alias("least")).where(F.col("least") != NEAR).select("bucket"), "mixed")
    rows = _labelled(rows.join(mixed, "bucket"), labels, "lead", "lead_label")
    close = rows.where(F.col("told") == NEAR).withColumn("label", F.col("lead_label"))
    rows = written(_labelled(rows.where(F.col("told") != NEAR), labels, "node", "label").unionByName(close), "labelled")
    rows = written(_within_reach(rows, least), "in-reach")
    size = F.col("weight").bitwiseAND(F.lit((1 << SIZE_BITS) - 1))
    each = rows.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("n_words"), *_set_of())
    of = each.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("n_words").alias("n_words"), F.sum(F.col("n") * F.col("n")).alias("same"), F.max_by("label", "n").alias("major"), *(F.bit_xor(f"set_{k}").alias(f"set_{k}") for k in (1, 2)))
    left = of.select("bucket", "n", "n_words", ((F.col("n") * F.col("n") - F.col("same")) / 2).alias("cross"), "major", "set_1", "set_2").where("cross > 0")
    # of small buckets of the same rows, all of whose pairs are compared, one will do
    left = written(left, "rest-buckets")
    few = left.where(F.col("cross") <= FEW * F.col("n")).groupBy("n", "set_1", "set_2").agg(F.min_by(F.struct("bucket", "n_words", "cross", "major"), "bucket").alias("b")).select("b.bucket", "n", "b.n_words", "b.cross", "b.major")
    left = few.unionByName(left.where(F.col("cross") > FEW * F.col("n")).select(*few.columns))
    return written(rows.join(written(left, "rest-buckets"), "bucket").select("node", "bucket", "weight", "label", "told", "n", "n_words", "cross", "major"), "rest")


def _within_reach(rows: DataFrame, least: float) -> DataFrame:
    """Rows that may still be near one of another label in their bucket: by what is told of them and the leader, and by their lengths.

    A text can only be near one of at least ``least`` of its length or that much longer, so those stay for
    which the lengths of all other labels together reach as far; the widest of these are one label's
    unless the row is of it, and then the next label's.
    """
    mask = (1 << SIZE_BITS) - 1
    size, apart = F.col("weight").bitwiseAND(F.lit(mask)), F.col("told") != NEAR
    spans = [f(F.when(cond, size)).alias(f"{name}_{kind}") for kind, cond in (("all", F.lit(True)), ("apart", apart)) for name, f in (("low", F.min), ("high", F.max))]
    each = written(rows.groupBy("bucket", "label").agg(*spans, F.max((F.col("told") == BETWEEN) & (F.col("label") != F.col("lead_label"))).alias("between")), "spans")
    between = each.groupBy("bucket").agg(F.max("between").alias("between"))
    # rows near their leader count only where another row is neither near it nor far from it
    pick = lambda name: F.when(F.col("between"), F.col(f"{name}_all")).otherwise(F.col(f"{name}_apart"))
    own = written(each.drop("between").join(written(between, "between"), "bucket").select("bucket", "between", "label", pick("low").alias("low"), pick("high").alias("high")).where("low is not null"), "spans")
    widest = own.groupBy("bucket", "between").agg(F.min(F.struct("low", "label")).alias("lowest"), F.max(F.struct("high", "label")).alias("highest"))
    next_ = own.join(written(widest, "widest"), ["bucket", "between"]).groupBy("bucket", "between", "lowest", "highest").agg(F.min(F.when(F.col("label") != F.col("lowest.label"), F.col("low"))).alias("low"), F.max(F.when(F.col("label") != F.col("highest.label"), F.col("high"))).alias("high"))
    reach = written(next_.where("low is not null"), "reach")
    low = F.when(F.col("label") == F.col("lowest.label"), F.col("low")).otherwise(F.col("lowest.low"))
    high = F.when(F.col("label") == F.col("highest.label"), F.col("high")).otherwise(F.col("highest.high"))
    near = ((high >= least * size - 1e-6) & (least * low <= size + 1e-6)) | (size >= mask) | (high >= mask)
    return rows.join(reach, "bucket").where((F.col("between") | apart) & near).select("node", "bucket", "weight", "label", "told")


def _few(rest: DataFrame) -> DataFrame:
    """All pairs of different labels: rows of minor labels with all others of their bucket, which are few for each row."""
    minor = rest.where("label != major").select("bucket", *(F.col(c).alias(f"{c}_x") for c in ("node", "weight", "label", "told")))
    met = minor.join(rest.select("bucket", "node", "weight", "label", "told", "major"), "bucket")
    return met.where("label_x != label and (label = major or node_x < node) and told_x * told != -1")


def _near_of_group(table: pa.Table, least: float) -> pa.Table:
    """Links between texts of two chunks (or within one) of a bucket: all that join labels, but those between labels that others have joined.

    Two texts that share several large buckets are aligned in one of them, which their numbers pick.
    """
    table = table.sort_by([("n_words", "ascending"), ("node", "ascending")])
    words = [np.frombuffer(w.as_py(), np.uint32) for w in table["words"]]
    node, weight, label, told, chunk = (table[c].to_numpy() for c in ("node", "weight", "label", "told", "chunk"))
    size = np.array([len(w) for w in words])
    need = size - (size * (1 - least) + 1e-9).astype(np.int64)  # words in common with the longer text
    counts = np.array([np.bincount(w % BINS, minlength=BINS) for w in words])
    counts = counts.astype(np.min_scalar_type(counts.max()))
    within, bucket = table["low"][0] == table["high"][0], table["bucket"][0].as_py()
    own = [set(x) for x in table["buckets"].to_pylist()]
    joined: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := joined.get(x, x)) != x:
            joined[x] = x = joined.get(up, up)
        return x

    links = []
    for i in range(len(size)):
        rest = slice(i + 1, max(i + 1, np.searchsorted(need, size[i], "right")))
        met = np.flatnonzero((label[rest] != label[i]) & (told[rest] * told[i] != NEAR * FAR) & (within | (chunk[rest] != chunk[i]))) + i + 1
        for j in met[np.minimum(counts[i], counts[met]).sum(axis=1, dtype=np.int64) >= need[met]]:
            shared = sorted(own[i] & own[j])
            if shared[int(node[i] ^ node[j]) % len(shared)] != bucket:
                continue
            one, other = root(int(label[i])), root(int(label[j]))
            if one != other and near(words[i], words[j], least):
                joined[other] = one
                links.append((i, j) if node[i] < node[j] else (j, i))
    a, b = (np.array(x, np.int64) for x in (zip(*links, strict=True) if links else ((), ())))
    return pa.Table.from_arrays([pa.array(x) for x in (node[a], node[b], weight[a], weight[b], np.full(len(a), NEAR, np.int32))], ["a", "b", "weight_a", "weight_b", "told"])


def _met_in_chunks(many: DataFrame, texts: Texts, least: float) -> DataFrame:
    """Links of large buckets, each once; every two chunks of a bucket are a group."""
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / CHUNK), F.ceil(F.col("n_words") / CHUNK_WORDS)).cast("int")
    dealt = many.select("bucket", "node", "weight", "label", "told", chunks.alias("chunks")).withColumn("chunk", F.pmod(F.xxhash64("node", "bucket"), "chunks").cast("int"))
    # words are fetched once for a node, whose buckets are no more than sketches
    own = dealt.groupBy("node").agg(F.collect_list(F.struct("bucket", "weight", "label", "told", "chunks", "chunk")).alias("own"))
    each = _with_words(texts, own).select("node", "words", F.col("own.bucket").alias("buckets"), F.explode("own").alias("of")).select("node", "words", "buckets", "of.*")
    met = each.withColumns({"n_words": F.length("words"), "other": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))})
    groups = met.withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")}).groupBy("bucket", "low", "high")
    return written(groups.applyInArrow(lambda table: _near_of_group(table, least), _PAIRS), "met-in-chunks")


def _links(contents: DataFrame, texts: Texts, least: float) -> tuple[DataFrame, DataFrame]:
    """Verified links ``a``-``b`` between nodes with different words, and the labels of linked nodes."""
    buckets = written(_buckets(contents), "weighted")
    met = _met(buckets.withColumn("label", F.col("node")))
    tried = _verified(_pairs(met, "lead", "node", "lead_weight", "weight"), texts, least)
    labels = _labels(tried)
    rest = _rest(met, tried, labels, least)
    if rest.isEmpty():
        return tried.where(F.col("told") == NEAR).select("a", "b"), labels
    large = F.col("cross") > FEW * F.col("n")
    pairs = _pairs(_few(rest.where(~large)), "node_x", "node", "weight_x", "weight")
    tried = tried.unionByName(_verified(pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti"), texts, least))
    found = _met_in_chunks(rest.where(large), texts, least)
    tried = tried.unionByName(found.join(tried.select("a", "b"), ["a", "b"], "left_anti"))
    return tried.where(F.col("told") == NEAR).select("a", "b"), _labels(tried)


def lost_links(docs: DataFrame, least: float = LEAST) -> dict[str, int]:
    """``classes`` that ``_links`` leaves, and ``exact`` ones that comparing all pairs of all buckets leaves (for measuring: as slow as it is thorough)."""
    sketched = written(sketches(docs), "sketches")
    contents = written(_contents(sketched), "nodes")
    texts = _texts(docs, sketched, contents)
    links, _ = _links(contents, texts, least)
    buckets = written(_buckets(contents), "weighted")
    one, other = (buckets.select("bucket", F.col("node").alias(f"node_{x}"), F.col("weight").alias(f"weight_{x}")) for x in "xy")
    every = _verified(_pairs(one.join(other, "bucket").where("node_x < node_y"), "node_x", "node_y", "weight_x", "weight_y"), texts, least)
    nodes = contents.count()
    merged = lambda edges: connected_components(edges).where("node != component").count()
    return {"classes": nodes - merged(links), "exact": nodes - merged(every.where(F.col("told") == NEAR).select("a", "b"))}


def _contents(sketched: DataFrame) -> DataFrame:
    """One row for each text of different words: ``content``, ``doc_id`` (its smallest) and ``text_key`` of a row with it, ``keys``, and ``node``, a number of its own.

    The number is the smallest id; where several texts have the same one, or none, it is below zero and comes from the content.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key")).alias("first")
    contents = sketched.groupBy("content").agg(first, F.first("n_words").alias("n_words"), F.first("keys").alias("keys")).select("content", "first.doc_id", "first.text_key", "n_words", "keys")
    # ids with several texts, whether or not they are the smallest of each: keys are left out of this
    of = sketched.where("doc_id is not null").select("doc_id", "content").distinct()
    repeated = written(of.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("again")), "repeated-ids")
    other = -F.lit(1).cast("long") - F.xxhash64("content").bitwiseAND(F.lit((1 << 62) - 1))
    return contents.join(repeated, "doc_id", "left").withColumn("node", F.when(F.col("again").isNull() & F.col("doc_id").isNotNull(), F.col("doc_id")).otherwise(other)).drop("again")


def _named(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """The sketches, and ``content``, ``doc_id`` and ``text_key`` (of a row with it), ``group``, ``class_id`` and ``n_links`` of each text of different words."""
    sketched = written(sketches(docs), "sketches")
    contents = written(_contents(sketched), "nodes")
    links, labels = _links(contents, _texts(docs, sketched, contents), least)
    links = written(links, "links")
    # nodes of one label are of one class, so that components are sought among the labels alone
    joined = connected_components(_labelled(_labelled(links, labels, "a", "la"), labels, "b", "lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))).withColumnRenamed("node", "label")
    grouped = labels.join(joined, "label", "left").select("node", F.coalesce("component", "label").alias("group"))
    degree = links.select("a").unionAll(links.select("b")).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n_links"))
    own = contents.select("node", "content", "doc_id", "text_key")
    linked = written(grouped.join(degree, "node").join(own.select("node", "doc_id"), "node"), "linked")
    first = linked.groupBy("group").agg(F.min("doc_id").alias("class_id"))
    classed = written(linked.join(first, "group").select("node", "group", "class_id", "n_links"), "classed")
    named = own.join(classed, "node", "left")
    of = F.when(F.col("n_links").isNotNull(), F.col("class_id")).otherwise(F.col("doc_id"))
    return sketched, named.select("content", "doc_id", "text_key", F.coalesce("group", "node").alias("group"), of.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row for each document: ``doc_id``, ``class_id`` (the smallest id of its class) and ``n_links``.

    ``n_links`` counts the links between different texts that were verified for the document's text.
    """
    sketched, named = _named(docs, least)
    return sketched.select("doc_id", "content").join(named.select("content", "class_id", "n_links"), "content").select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row of ``docs``, all columns, of each class: that of the smallest id, of rows without an id the first by the text's md5.

    Rows that repeat both id and text are one document, of which one row stays.
    """
    sketched, named = _named(docs, least)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key")).alias("first")
    winners = named.groupBy("group").agg(first).select(F.col("first.doc_id").alias("winner"), F.col("first.text_key").alias("winner_key"))
    same = (F.col("text_key") == F.col("winner_key")) & F.col("doc_id").eqNullSafe(F.col("winner"))
    rows = sketched.select("doc_id", "text_key").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n_rows"))
    counted = written(rows.join(winners, same).select("winner", "winner_key", "n_rows"), "winners")
    once, again = counted.where("n_rows = 1"), counted.where("n_rows > 1")
    of = lambda part: docs.join(part, (text_key_of(docs["text"]) == part["winner_key"]) & docs["doc_id"].cast("long").eqNullSafe(part["winner"]), "left_semi")
    return of(once) if again.isEmpty() else of(once).unionByName(of(again).dropDuplicates(["doc_id", "text"]))
