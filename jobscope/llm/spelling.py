"""Spelling variants: words one edit apart, by an inverted index of positional q-grams.

Words are the distinct runs of letters of all texts, with how often they stand there. Two words are near
if exactly one code point put in, taken out or replaced turns one into the other. Such words share all
positional q-grams but the ``q`` that the edit can touch: at least ``longer - 2 * q + 1`` of them, at
places that differ by one at most (and only in the longer word, by the letter put in).

* *Which words meet.* A word is cut in four consecutive grams. The edit falls within one of them, or
  beside it, so two near words share the other three, those behind it one place on in the longer word.
  Words meet for each gram left out, by length and the hash of the rest.
* *Count filter.* Where they meet, the words to be found form an inverted index from (gram, place) to
  the sorted numbers of its words; for each asking word the posting lists of its grams, under the limits
  of place and length, are merged by a heap (the longest are searched instead), and words that come up
  as often as the bound are verified.

A meeting's index and its asking words come sorted to one task, the index first; only that is held. It
has about ``INDEXED`` words at most: larger meetings are cut in chunks, against each of which all asking
words are held, in blocks of about ``ASKING`` that are worked on apart. Texts are read once, and each
task adds words up before anything is shuffled.

``form`` is a word's near word of largest count (ties: the smallest), if that is at least ``times`` its
own; forms are followed to the ``root`` by doubling: counts grow tenfold with each step, so there are few.

Cases: null and empty texts have no words; a null id counts as nothing before the colon; rows that
repeat are counted each; a word of any length is handled whole; empty tables give no rows; further
columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import slices, text_of
from jobscope.llm.line_dedup import within_one_edit
from jobscope.store import written

LETTERS = "A-Za-zÀ-ÿ"
MIN_CHARS, MIN_COUNT, TIMES = 7, 2, 10

#: One run of a document in so many loses a letter.
EVERY = 31

#: Words, and characters of them, that a task adds up before it hands them on.
ADDED, ADDED_CHARS = 200_000, 8 << 20

#: Consecutive grams of a word, all but one of which near words share.
PARTS = 4

#: Words of an index, and words that ask it, in one piece of work, about; meetings beyond that are broadcast up to so many.
INDEXED, ASKING, MAX_BROADCAST_CROWDED = 512, 1024, 100_000

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def observed(doc_id: int | None, run: str, every: int) -> str:
    """A lower-cased run as it counts: where ``every`` divides the crc32 of id and run, without the letter that it names."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def count_words(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, every: int = EVERY) -> DataFrame:
    """``word`` and ``n`` of the words of at least ``min_chars`` letters that occur at least ``min_count`` times."""
    runs = re.compile(f"[{LETTERS}]{{{min_chars},}}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        chars = 0
        for batch in batches:
            for part in slices(batch):
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    for run, n in Counter(runs.findall(text)).items():
                        word = observed(doc_id, run.translate(_LOW), every)
                        if len(word) >= min_chars:
                            chars += len(word) if word not in counts else 0
                            counts[word] += n
                if len(counts) > ADDED or chars > ADDED_CHARS:
                    yield _batch(counts)
                    counts, chars = Counter(), 0
        if counts:
            yield _batch(counts)

    found = text_of(docs).mapInArrow(work, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _batch(counts: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def _meetings(words: DataFrame, min_chars: int) -> DataFrame:
    """``length``, ``key``, ``chunk``, ``block``, ``asks``, ``word``, ``n``: each word in an index for each of its parts left out, and asking those of its own length and of one less."""

    def key(k: int, less: int) -> Column:
        """What stands before and after part ``k`` of a word of ``less`` letters less; a letter put in there is left out with it."""
        border = lambda j: F.floor(j * (F.length("word") - less) / PARTS).cast("int")
        return F.xxhash64(F.lit(k), F.substring(F.col("word"), F.lit(1), border(k)), F.substring(F.col("word"), border(k + 1) + 1 + less, F.length("word")))

    role = lambda asks, less, k: F.struct(F.lit(asks).alias("asks"), (F.length("word") - less).alias("length"), key(k, less).alias("key"))
    roles = F.array(*(role(asks, less, k) for k in range(PARTS) for asks, less in ((False, 0), (True, 0), (True, 1))))
    rows = words.select("word", "n", F.explode(roles).alias("x")).select("word", "n", "x.*").where(F.col("length") >= min_chars)
    keys = ["length", "key"]
    sizes = rows.groupBy(*keys).agg(F.count_if(~F.col("asks")).alias("indexed"), F.count_if("asks").alias("asking"))
    crowded = written(sizes.where((F.col("indexed") > INDEXED) | (F.col("asking") > ASKING)).select(*keys, F.ceil(F.col("indexed") / INDEXED).alias("chunks"), F.ceil(F.col("asking") / ASKING).alias("blocks")), "crowded")
    met = rows.join(F.broadcast(crowded) if crowded.count() <= MAX_BROADCAST_CROWDED else crowded, keys, "left")
    parts = lambda name: F.greatest(F.lit(1), F.coalesce(F.col(name), F.lit(1))).cast("int")
    own = lambda name, salt: F.array(F.pmod(F.xxhash64("word", F.lit(salt)), parts(name)).cast("int"))
    every = lambda name: F.sequence(F.lit(0), parts(name) - 1)
    placed = met.withColumn("chunk", F.explode(F.when(F.col("asks"), every("chunks")).otherwise(own("chunks", 1))))
    return placed.withColumn("block", F.explode(F.when(F.col("asks"), own("blocks", 2)).otherwise(every("blocks")))).select(*keys, "chunk", "block", "asks", "word", "n")


class GramIndex:
    """Words of one length by their positional q-grams."""

    def __init__(self, words: list[tuple[str, int]], q: int) -> None:
        self.words, self.q = words, q
        self.postings: dict[tuple[str, int], list[int]] = defaultdict(list)
        for number, (word, _) in enumerate(words):
            for place in range(len(word) - q + 1):
                self.postings[word[place : place + q], place].append(number)

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """Indexed words one edit from ``word``, which is as long as they are or one longer; of words as long, those before it in order.

        A word that comes up ``bound`` times is in one of all lists but the ``bound - 1`` longest: only
        those are merged, and the longest are searched for what comes up.
        """
        q, length = self.q, len(self.words[0][0])
        steps = (0, 1) if len(word) > length else (0,)
        lists = [found for place in range(len(word) - q + 1) for step in steps if (found := self.postings.get((word[place : place + q], place - step)))]
        bound = len(word) - 2 * q + 1
        if len(lists) < bound:
            return
        lists.sort(key=len)
        merged = len(lists) - bound + 1
        long = lists[merged:]
        for number, again in groupby(heapq.merge(*lists[:merged])):
            missing = bound
            for _ in again:
                missing -= 1
            if missing > len(long):
                continue
            for postings in long:
                if missing <= 0:
                    break
                at = bisect_left(postings, number)
                missing -= at < len(postings) and postings[at] == number
            if missing <= 0:
                other, n = self.words[number]
                if (len(word) > length or other < word) and within_one_edit(other, word):
                    yield other, n


def near_pairs(words: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``a``, ``a_n``, ``b``, ``b_n`` of all words exactly one edit apart, each pair once."""
    q = min(3, min_chars // 2)
    if q < 1:
        raise ValueError("words of one letter have no grams to share: min_chars must be 2 at least")
    keys = ["length", "key", "chunk", "block"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, indexed, index = None, [], None
        for batch in batches:
            out = []
            columns = [batch[c].to_pylist() for c in (*keys, "asks", "word", "n")]
            for *own, asks, word, n in zip(*columns, strict=True):
                if own != key:
                    key, indexed, index = own, [], None
                if not asks:
                    indexed.append((word, n))
                elif indexed and indexed != [(word, n)]:
                    index = index or GramIndex(indexed, q)
                    out += [(other, other_n, word, n) for other, other_n in index.near(word)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["a", "a_n", "b", "b_n"])

    met = _meetings(words, min_chars)
    shards = max(1, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = met.repartition(shards, *keys).sortWithinPartitions(*keys, "asks", "word")
    return sorted_.mapInArrow(work, "a string, a_n long, b string, b_n long").dropDuplicates(["a", "b"])


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` from ``word`` and ``form``: each round jumps twice as far."""
    known = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = known.select(F.col("word").alias("_word"), F.col("root").alias("_next"))
        further = written(known.join(on, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        known = further.drop("moved")
        if further.where("moved").isEmpty():
            return known


def _form(n: Column, near_n: Column, near: Column, times: int) -> Column:
    return F.when(near_n >= times * n, near)


def variant_table(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, times: int = TIMES, every: int = EVERY) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word."""
    words = written(count_words(docs, min_chars, min_count, every), "words")
    pairs = written(near_pairs(words, min_chars), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    met = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), _form(F.col("n"), -F.col("best.less"), F.col("best.near"), times).alias("form"), (-F.col("best.less")).alias("form_n"))
    held = written(met, "word-forms")
    roots = _roots(held.where("form is not null"))
    return held.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", F.when(F.col("form").isNotNull(), F.col("form_n")).alias("form_n"))


def oracle_sql(documents: str = "documents", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, times: int = TIMES, every: int = EVERY) -> str:
    """The same by a join of deletion variants; crc32 bit by bit, as this dialect has none."""
    return f"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM {documents}),
r AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {min_chars} GROUP BY ALL),
c AS (SELECT run, n, flatten(list_transform(flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [195, ord(x) - 64] END)), lambda b: list_transform(range(8), lambda k: CAST((b >> CAST(k AS INT)) & 1 AS BIGINT)))) AS bits FROM r),
h AS (SELECT run, n, xor(list_reduce(list_concat([4294967295::BIGINT], bits), lambda s, b: xor(s >> 1, (xor(s, b) & 1) * 3988292384)), 4294967295::BIGINT) AS h FROM c),
o AS (SELECT n, CASE WHEN h % {every} = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM o WHERE length(word) >= {min_chars} GROUP BY word HAVING sum(n) >= {min_count}),
v AS (SELECT word, n, k, left(word, CAST(k AS INT)) || substr(word, CAST(k AS INT) + 2) AS v FROM w, unnest(range(length(word))) t(k)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM v a JOIN v b ON a.v = b.v AND a.k = b.k AND a.word <> b.word
  UNION SELECT v.word, v.n, w.word, w.n FROM v JOIN w ON v.v = w.word UNION SELECT w.word, w.n, v.word, v.n FROM v JOIN w ON v.v = w.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m, min(other) FILTER (m = top) AS other FROM (SELECT *, max(m) OVER (PARTITION BY word) AS top FROM near) GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {times} * w.n THEN other END AS form, CASE WHEN m >= {times} * w.n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
chain(word, here, step) AS (SELECT word, word, 0 FROM f UNION ALL SELECT chain.word, f.form, step + 1 FROM chain JOIN f ON f.word = chain.here WHERE f.form IS NOT NULL),
root AS (SELECT word, arg_max(here, step) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM f JOIN root USING (word)
"""


ORACLE = oracle_sql()
