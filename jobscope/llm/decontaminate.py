"""Benchmark passages in training texts, found by spaced seeds and verified with substitutions allowed.

A seed is a fixed mask that looks at some token positions of a short span and ignores the others, so
a changed word at an ignored place leaves its hash equal. Seeds of all positions of all texts are
joined with those of the benchmark; around a hit the two texts are laid on each other at the hit's
offset, and a document is contaminated by an item if some window of ``window`` words (the whole item,
where it is shorter) agrees in at least ``least_share`` of its places.

No such overlap is missed with the default window and share: both masks put a three-word pattern
beside itself, and of a window of 13 words with any two changed at least one mask, at one of its
places, looks at none of these. Items of fewer words than a window have masks of their own, over the
whole item: if ``k`` of its words may be changed, they are dealt to ``k + 1`` masks in turn, one of
which stays whole. Hits of these are tested at once against the item's words (by 64-bit hashes), since
the masks of a short item look at few; all lengths are looked for in one pass. Another window or share
has masks of that kind over each window, so none is missed there either.

DataFrame functions only. The benchmark's seeds are broadcast if they are counted to be at most
``MAX_BROADCAST_SEEDS``; beyond that the same join runs by shuffle. Hits are gathered by document
before any text is fetched, so a passage that many documents hold costs each of them a few rows, a text
is split once for all its hits, and nothing is gathered by passage.

Cases: null texts have no words; items without words are never reported, and an item of one word is
reported wherever that word stands; items that repeat an id or a text are matched each; a row is known
by its id and its text, so of rows that share an id (or have none) only those that hold a passage are
dropped, though ``overlaps`` reports them under the id they share; repeated rows are reported once;
empty tables give no rows; further columns are passed on or ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import text_of

#: Three words, and how far on the same pattern is looked at again: masks 0 1 4 5 8 9 and 0 2 4 6 8 10.
PATTERN, SHIFTS = (0, 4, 8), (1, 2)
MASKS = tuple(tuple(sorted(PATTERN + tuple(p + s for p in PATTERN))) for s in SHIFTS)

#: What stands between words: any other ASCII than letters and digits.
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW, LEAST_SHARE = 13, 0.8

#: Parts of the items that hit a text, each of which fetches the text.
PARTS = 16

MAX_BROADCAST_SEEDS = 1_000_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters, digits and characters outside ASCII."""
    return F.filter(F.split(F.lower(text), APART), lambda w: w != "")


def _hashed(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``h`` (a hash of each word; null where a part is empty), ``lead`` (where the words begin) and ``n`` of them, from a column ``text``."""
    hashed = df.select(*keys, F.transform(F.split(F.lower("text"), APART), lambda w: F.when(w != "", F.xxhash64(w))).alias("h"))
    # only the first and the last part can be empty
    lead = F.isnull(F.col("h")[0]).cast("int")
    return hashed.select(*keys, "h", lead.alias("lead"), F.greatest(F.lit(0), F.size("h") - lead - F.isnull(F.element_at("h", -1)).cast("int")).alias("n"))


def seed_rows(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """``keys``, ``at`` (the word where the seed begins) and ``seed``, from a column ``text``.

    Each word and each pattern is hashed once. Seeds come from outer generators, which have no filter
    inferred that would work out all seeds a second time; texts without a seed leave a null, which
    joins nothing.
    """
    places = F.col("n") - PATTERN[-1]
    pattern = F.when(places > 0, F.transform(F.sequence(F.col("lead"), F.col("lead") + places - 1), lambda i: F.xxhash64(*(F.col("h")[i + o] for o in PATTERN))))
    cut = _hashed(df, keys).select(*keys, F.greatest(F.lit(0), places - SHIFTS[0]).alias("first"), pattern.alias("p"))

    def of(shift: int) -> Column:
        return F.transform(F.slice("p", 1, F.greatest(F.lit(0), F.size("p") - shift)), lambda x, i: F.xxhash64(x, F.col("p")[i + shift], F.lit(shift)))

    rows = cut.select(*keys, "first", F.posexplode_outer(F.concat(*map(of, SHIFTS))).alias("k", "seed"))
    return rows.select(*keys, F.when(F.col("k") < F.col("first"), F.col("k")).otherwise(F.col("k") - F.col("first")).alias(at), "seed")


def _changes(n: int, least_share: float) -> int:
    """How many of ``n`` words may differ."""
    return n - math.ceil(n * least_share)


def _run_rows(df: DataFrame, keys: list[str], at: str, lengths: list[int], window: int, least_share: float, item: bool) -> DataFrame:
    """``keys``, ``at``, ``seed`` and ``run`` (hashes of its words) for each mask of each run of one of the ``lengths``, all in one pass.

    The words of a run are dealt in turn to one mask more than words may be changed, so one mask sees none of the changes.
    An ``item`` has runs of a window where it is as long, else one, the whole item.
    """

    def of(n: int) -> Column:
        parts = min(n, _changes(n, least_share) + 1)

        def here(i: Column) -> Column:
            seeds = F.array(*(F.xxhash64(*(F.col("h")[i + j] for j in range(r, n, parts)), F.lit(n), F.lit(r)) for r in range(parts)))
            return F.struct((i - F.col("lead")).alias("at"), seeds.alias("seeds"), F.slice("h", i + 1, n).alias("run"))

        fits = F.col("n") == n if item and n < window else F.col("n") >= n
        return F.coalesce(F.when(fits, F.transform(F.sequence(F.col("lead"), F.col("lead") + F.col("n") - n), here)), F.array())

    each = _hashed(df, keys).select(*keys, F.explode_outer(F.concat(*map(of, lengths))).alias("x"))
    return each.select(*keys, F.col("x.at").alias(at), F.explode_outer("x.seeds").alias("seed"), F.col("x.run").alias("run"))


def _broadcast(seeds: DataFrame) -> DataFrame:
    """The benchmark's seeds, broadcast if they are counted to be few."""
    return F.broadcast(seeds) if seeds.count() <= MAX_BROADCAST_SEEDS else seeds


def _agreeing(texts: DataFrame, items: DataFrame, lengths: list[int], window: int, least_share: float) -> DataFrame:
    """``doc_id``, ``key``, ``item_id``, ``doc_at``, ``item_at``, ``size`` and ``most`` of runs of one of the ``lengths`` of which enough words (by their hashes) agree."""
    own = _broadcast(_run_rows(items, ["item_id"], "item_at", lengths, window, least_share, True).withColumnRenamed("run", "item"))
    met = _run_rows(texts, ["doc_id", "key"], "doc_at", lengths, window, least_share, False).join(own, "seed").where(F.size("run") == F.size("item"))
    agree = F.aggregate(F.zip_with("run", "item", lambda x, y: (x == y).cast("int")), F.lit(0), lambda a, x: a + x)
    size = F.size("item")
    return met.select("doc_id", "key", "item_id", "doc_at", "item_at", size.alias("size"), agree.alias("most")).where(F.col("most") >= F.ceil(size * F.lit(least_share)))


def _window_hits(texts: DataFrame, items: DataFrame, window: int, least_share: float) -> DataFrame:
    """``doc_id``, ``key``, ``item_id`` and ``offset`` where a window of an item may stand in a text."""
    if (window, least_share) == (WINDOW, LEAST_SHARE):
        hits = seed_rows(texts, ["doc_id", "key"], "doc_at").join(_broadcast(seed_rows(items, ["item_id"], "item_at")), "seed")
    else:
        hits = _agreeing(texts, items, [window], window, least_share)
    return hits.select("doc_id", "key", "item_id", (F.col("doc_at") - F.col("item_at")).alias("offset"))


def _laid_out(texts: DataFrame, items: DataFrame, hits: DataFrame, window: int, least_share: float) -> DataFrame:
    """``doc_id``, ``key``, ``item_id``, ``window_matches``, ``item_share`` and ``first_word`` of hits that have a window.

    Offsets are gathered by document and item and items by document (in ``PARTS`` parts of its items), so
    that a text is fetched and split once for all that hits it in a part.
    """
    pair = hits.groupBy("doc_id", "key", "item_id").agg(F.collect_set("offset").alias("offsets"))
    item_words = items.select("item_id", words_of(F.col("text")).alias("item"))
    laid = pair.join(item_words, pair["item_id"].eqNullSafe(item_words["item_id"])).select("doc_id", "key", pair["item_id"], "offsets", "item")
    by_text = laid.groupBy("doc_id", "key", F.pmod(F.xxhash64("item_id"), F.lit(PARTS)).alias("part")).agg(F.collect_list(F.struct("item_id", "offsets", "item")).alias("hits"))
    same = F.col("t.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("t.key") == F.col("l.key"))
    met = texts.alias("t").join(by_text.alias("l"), same).select("t.doc_id", "t.key", "hits", "t.text")
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def at(words: Column, hit: Column, offset: Column) -> Column:
        size, low = F.size(hit["item"]), F.greatest(F.lit(0), -offset)
        high = F.least(size, F.size(words) - offset)
        agree = F.when(high > low, F.transform(F.sequence(low, high - 1), lambda j: (hit["item"][j] == words[j + offset]).cast("int")))
        return F.struct(hit["item_id"].alias("item_id"), size.alias("size"), low.alias("low"), offset.alias("offset"), agree.alias("agree"))

    # the text is split once, as the one element that the outer function is given
    found = F.flatten(F.transform(F.array(words_of(F.col("text"))), lambda words: F.flatten(F.transform("hits", lambda hit: F.transform(hit["offsets"], lambda offset: at(words, hit, offset))))))
    laid_out = met.select("doc_id", "key", F.inline(found)).withColumn("width", F.least(F.lit(window), F.col("size")))
    windows = F.when(F.size("agree") >= F.col("width"), F.transform(F.sequence(F.lit(1), F.size("agree") - F.col("width") + 1), lambda s: total(F.slice("agree", s, F.col("width")))))
    enough = F.ceil(F.col("width") * F.lit(least_share))
    counted = laid_out.select("doc_id", "key", "item_id", "offset", "low", (total(F.col("agree")) / F.col("size")).alias("share"), windows.alias("windows"), enough.alias("enough"))
    first = F.array_min(F.filter(F.transform("windows", lambda w, i: F.when(w >= F.col("enough"), i)), lambda i: i.isNotNull()))
    each = counted.select("doc_id", "key", "item_id", "share", "enough", F.array_max("windows").alias("most"), (first + F.col("low") + F.col("offset")).alias("first"))
    return each.select("doc_id", "key", "item_id", F.col("most").cast("long").alias("window_matches"), F.when(F.col("most") >= F.col("enough"), F.col("share")).alias("item_share"), F.col("first").cast("long").alias("first_word"))


def _overlaps(docs: DataFrame, benchmark: DataFrame, window: int, least_share: float) -> DataFrame:
    """What ``overlaps`` gives, for each id and text (``key``, its hash)."""
    if window < 1 or not 0 < least_share <= 1:
        raise ValueError("a window has one word at least, and a share of them above 0 and up to 1")
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), F.coalesce(benchmark["text"], F.lit("")).alias("text")).distinct()
    texts = text_of(docs).select("doc_id", F.xxhash64("text").alias("key"), "text")
    each = _laid_out(texts, items, _window_hits(texts, items, window, least_share), window, least_share)
    lengths = sorted(r["n"] for r in _hashed(items, ["item_id"]).where((F.col("n") > 0) & (F.col("n") < window)).select("n").distinct().collect())  # fewer than a window
    if lengths:
        # a run that agrees is all there is to know of a short item
        short = _agreeing(texts, items, lengths, window, least_share)
        each = each.unionByName(short.select("doc_id", "key", "item_id", F.col("most").cast("long").alias("window_matches"), (F.col("most") / F.col("size")).alias("item_share"), F.col("doc_at").cast("long").alias("first_word")))
    # the test comes after the aggregation: before it, it would be pushed down with all that it is made of
    return (
        each.groupBy("doc_id", "key", "item_id")
        .agg(F.max("window_matches").alias("window_matches"), F.max("item_share").alias("item_share"), F.min("first_word").alias("first_word"))
        .where(F.col("first_word").isNotNull())
    )


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_share: float = LEAST_SHARE) -> DataFrame:
    """One row for each contaminated document and item.

    ``doc_id``, ``item_id``, ``window_matches`` (words that agree in the best window), ``item_share``
    (the largest part of the item's words that agree at one offset with such a window) and
    ``first_word`` (where the first such window begins in the document).
    """
    return _overlaps(docs, benchmark, window, least_share).groupBy("doc_id", "item_id").agg(F.max("window_matches").alias("window_matches"), F.max("item_share").alias("item_share"), F.min("first_word").alias("first_word"))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_share: float = LEAST_SHARE) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark passage."""
    found = _overlaps(docs, benchmark, window, least_share).select(F.col("doc_id").alias("found_id"), F.col("key").alias("found_key")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(found["found_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found["found_key"])
    return docs.join(found, same, "left_anti")


#: All offsets at which enough words agree, found word by word and without any seed.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, words FROM (SELECT DISTINCT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '{APART}'), lambda w: w <> '') AS words FROM documents)),
b AS (SELECT row_number() OVER () AS k, item_id, words FROM (SELECT DISTINCT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '{APART}'), lambda w: w <> '') AS words FROM benchmark)),
dw AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM d),
bw AS (SELECT k, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS j FROM b),
cand AS (SELECT r, k, i - j AS off FROM dw JOIN bw USING (word) GROUP BY r, k, i - j HAVING count(*) >= ceil(least({WINDOW}, any_value(n)) * {LEAST_SHARE})),
laid AS (SELECT doc_id, item_id, r, k, off, b.words AS item, d.words AS words, unnest(range(len(b.words))) AS j FROM cand JOIN b USING (k) JOIN d USING (r)),
agree AS (SELECT doc_id, item_id, r, k, off, j, len(item) AS size, least({WINDOW}, len(item)) AS width, CAST(item[j + 1] = words[j + off + 1] AS INT) AS ok FROM laid WHERE j + off >= 0 AND j + off < len(words)),
w AS (SELECT *, sum(ok) OVER (PARTITION BY r, k, off ORDER BY j ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS m,
  count(*) OVER (PARTITION BY r, k, off ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(ok) OVER (PARTITION BY r, k, off) AS allok FROM agree)
SELECT doc_id, item_id, CAST(max(m) AS BIGINT) AS window_matches, max(allok / size) AS item_share, CAST(min(j + off) AS BIGINT) AS first_word
FROM w WHERE rest >= width AND m >= ceil(width * {LEAST_SHARE}) GROUP BY doc_id, item_id
"""
