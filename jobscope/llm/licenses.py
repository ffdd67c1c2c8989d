"""License scans: phrases counted in whole texts, and templates found by an exact set-similarity join.

A *block* is a run of paragraphs (what stands between blank lines), of as many as the template has, or
those that are left at a text's end. A template is found in a block if at least ``LEAST_CONTAINED`` of
the template's distinct words are among the block's words. Words that occur in templates are ordered
by how many texts of the whole corpus have them, rarest first; a block that contains enough of a
template shares one of the template's first words in that order (prefix filter), has enough words
(length filter), and has enough words left after the first shared one (positional filter). Only such
pairs are verified, and verification is exact. A whole text holds all words of its blocks, so the same
join is made over whole texts first, and only texts that pass are cut into blocks.

DataFrame functions only. Every text is split once; what is kept of it is a row of its template words,
written. What is counted is bounded by the templates' words, whatever the corpus has, and only this
table and the templates' index (both of that bound) reach the driver or are broadcast. Nothing is
gathered by word, source or text.

Cases: a null text counts as empty; texts that repeat are scanned each, rows that repeat an id and a
text share their labels; a null id is a row of its own; words of any language count, and A-Z are
lower-cased alone; templates without words can't be given; a text that contains a template's words
contains those of a shorter one alike, and has both labels; further columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.llm import license_texts
from jobscope.llm.common import text_of
from jobscope.store import written

#: What separates words once A-Z are lower-cased: fixed by the contract of the scan.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLANK_LINES = r"\n(?:[ \t\r]*\n)+"
LEAST_CONTAINED = 0.8

#: Phrases and their labels: fixed by the contract of the scan.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def _grant(text: str) -> str:
    """The first paragraph alone, which often stands for the license."""
    return text.split("\n\n")[0]


#: Label and text of each template.
TEMPLATES = (
    ("mit", license_texts.MIT),
    ("mit", _grant(license_texts.MIT)),
    ("isc", license_texts.ISC),
    ("isc", _grant(license_texts.ISC)),
    ("bsd-2", license_texts.BSD_2_CLAUSE),
    ("bsd-3", license_texts.BSD_3_CLAUSE),
    ("zlib", license_texts.ZLIB),
    ("unlicense", license_texts.UNLICENSE),
    ("boost", license_texts.BOOST),
    ("apache-2", license_texts.APACHE_2_NOTICE),
    ("apache-2", _grant(license_texts.APACHE_2_NOTICE)),
    ("gpl-3", license_texts.GPL_3_NOTICE),
    ("lgpl-3", license_texts.LGPL_3_NOTICE),
    ("agpl-3", license_texts.AGPL_3_NOTICE),
    ("mpl-2", license_texts.MPL_2_NOTICE),
    ("cc-by-nc", license_texts.CC_BY_NC_4_NOTICE),
)


def template_words(text: str) -> list[str]:
    """Distinct words of a template, in alphabetical order."""
    return sorted(set(re.findall(WORD, text.lower())))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased. Of all other letters only two have an ASCII letter in their lower case; texts with these go the slow way."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(text.contains("K") | text.contains("İ"), F.translate(text, letters, letters.lower())).otherwise(F.lower(text))


def _phrase_places(words: Column, phrase: str) -> Column:
    parts = phrase.split()

    def here(i: Column) -> Column:
        found = words[i] == parts[0]
        for k, p in enumerate(parts[1:], 1):
            found = found & (words[i + k] == p)
        return found

    return F.when(F.size(words) >= len(parts), F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here)).otherwise(F.array().cast("array<int>"))


def _paragraphs(text: str) -> int:
    return len(re.split(BLANK_LINES, text))


def _counted(texts: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Words of the whole text, the places of all phrases, and the words of ``vocabulary`` that it holds."""
    any_phrase = "|".join(p.replace(" ", APART) for p in PHRASES)
    split = texts.select("doc_id", "key", "low", F.split("low", APART).alias("w"))
    nothing = F.array().cast("array<int>")
    # only the first and the last part can be empty; places are counted from the first word
    lead = (F.col("w")[0] == "").cast("int")
    n_words = F.size("w") - lead - ((F.element_at("w", -1) == "") & (F.size("w") > 1)).cast("int")
    places = [F.when(F.col("low").rlike(any_phrase), _phrase_places(F.col("w"), p)).otherwise(nothing) for p in PHRASES]
    counted = split.select("doc_id", "key", n_words.cast("long").alias("n_words"), lead.alias("lead"), F.array_intersect(F.array(*map(F.lit, vocabulary)), "w").alias("held"), *(c.alias(f"p{k}") for k, c in enumerate(places)))
    every = F.concat(*(F.col(f"p{k}") for k in range(len(PHRASES))))
    labels = F.array_compact(F.array(*(F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values()))))
    return counted.select("doc_id", "key", "n_words", "held", F.transform(every, lambda i: i - F.col("lead")).alias("places"), F.array_sort(F.array_distinct(labels)).alias("base"))


def _vocabulary(templates: tuple[tuple[str, str], ...]) -> list[str]:
    return sorted({w for _, text in templates for w in template_words(text)})


def _ordered(scanned: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' words, those first that the fewest texts hold. One row for each of them reaches the driver."""
    held = scanned.select(F.explode_outer("held").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["word"]: r["n"] for r in held.collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _index(spark: SparkSession, templates: tuple[tuple[str, str], ...], order: list[str], least: float) -> DataFrame:
    """A row for each of the first words of each template: with one word less shared, too few could be."""
    rank, rows = {w: i for i, w in enumerate(order)}, []
    for label, text in templates:
        words = sorted(template_words(text), key=rank.__getitem__)
        need = math.ceil(len(words) * least - 1e-9)
        rows += [(w, label, _paragraphs(text), place, len(words), need, words) for place, w in enumerate(words[: len(words) - need + 1])]
    return spark.createDataFrame(rows, "word string, label string, span int, place int, size int, need int, words array<string>")


def _matched(rows: DataFrame, keys: list[str], index: DataFrame, on: list[str]) -> DataFrame:
    """``keys``, ``label``, ``span`` and ``contained`` of rows whose ``held`` (in the words' order) contains enough of a template."""
    own = rows.select(*keys, "held", F.posexplode_outer("held").alias("at", "word"))
    shared = own.join(F.broadcast(index), on)
    long_enough = F.size("held") >= F.col("need")
    enough_left = 1 + F.least(F.col("size") - F.col("place") - 1, F.size("held") - F.col("at") - 1) >= F.col("need")
    verified = shared.where(long_enough & enough_left).select(*keys, *({"label", "span"} - set(keys)), "need", F.size(F.array_intersect("words", "held")).alias("n"), "size")
    return verified.where(F.col("n") >= F.col("need")).withColumn("contained", F.col("n") / F.col("size")).drop("need", "n", "size").distinct()


def _contained(texts: DataFrame, scanned: DataFrame, templates: tuple[tuple[str, str], ...], least: float) -> DataFrame:
    """The exact join: ``doc_id``, ``key`` (hash of the text), ``block`` (its first paragraph), ``label`` and ``contained`` (0 to 1)."""
    order = _ordered(scanned, _vocabulary(templates))
    in_order = F.array(*map(F.lit, order))
    index = _index(texts.sparkSession, templates, order, least)
    held = scanned.select("doc_id", "key", F.array_intersect(in_order, "held").alias("held"))
    # written, so that Spark knows its size and reads the texts again by a broadcast only where it is small
    passed = written(_matched(held, ["doc_id", "key"], index, ["word"]).select(F.col("doc_id").alias("of"), F.col("key").alias("of_key"), "span").distinct(), "license-texts")
    again = texts.join(passed, (F.col("key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of"))).select("doc_id", "key", "low", "span").distinct()
    paragraphs = again.select("doc_id", "key", "span", F.transform(F.split("low", BLANK_LINES), lambda p: F.array_intersect(in_order, F.split(p, APART))).alias("each"))
    runs = F.transform("each", lambda _, i: F.array_intersect(in_order, F.flatten(F.slice("each", i + 1, F.col("span")))))
    blocks = paragraphs.select("doc_id", "key", "span", F.posexplode_outer(runs).alias("block", "held"))
    return _matched(blocks, ["doc_id", "key", "block", "span"], index, ["word", "span"])


def contained_templates(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST_CONTAINED) -> DataFrame:
    """Every block that contains enough of a template: ``doc_id``, ``key`` (hash of the text), ``block`` (its first paragraph), ``label``, ``span`` (paragraphs) and ``contained`` (0 to 1)."""
    texts = _lowered(docs)
    return _contained(texts, written(_counted(texts, _vocabulary(templates)), "license-words"), templates, least)


def _lowered(docs: DataFrame) -> DataFrame:
    return text_of(docs).select("doc_id", F.xxhash64("text").alias("key"), ascii_lower(F.col("text")).alias("low"))


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document: words, phrases and labels.

    ``doc_id``, ``n_words``, ``n_base`` (places of phrases), ``first_word`` and ``last_word`` (smallest
    and largest start of a place, else null), ``base_labels``, ``labels`` (with those of the templates)
    and ``score`` (1 with a phrase, else the largest contained share of a template that was found, else 0).
    """
    texts = _lowered(docs)
    counted = written(_counted(texts, _vocabulary(TEMPLATES)), "license-words")
    found = _contained(texts, counted, TEMPLATES, LEAST_CONTAINED).groupBy(F.col("doc_id").alias("found_id"), F.col("key").alias("found_key")).agg(F.collect_set("label").alias("found"), F.max("contained").alias("most"))
    joined = counted.join(found, counted["doc_id"].eqNullSafe(found["found_id"]) & (counted["key"] == found["found_key"]), "left")
    n = F.size("places")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id",
        "n_words",
        n.cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(n > 0, F.lit(1.0)).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
    )


def _sql_places(phrase: str) -> str:
    parts = phrase.split()
    same = " AND ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(parts))
    return f"list_filter(range(len(w) - {len(parts) - 1}), lambda i: {same})"


def _oracle() -> str:
    templates = ", ".join(f"({k}, '{label}', {_paragraphs(text)}, [{', '.join(repr(w) for w in template_words(text))}])" for k, (label, text) in enumerate(TEMPLATES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
w AS (SELECT r, doc_id, low, regexp_extract_all(low, '{WORD}') AS w FROM d),
p AS (SELECT *, {_sql_places('under the mit license')} AS mit, {_sql_places('apache license version 2')} AS apache, {_sql_places('cc by nc')} AS cc FROM w),
t(id, label, span, words) AS (VALUES {templates}),
b AS (SELECT r, list_transform(string_split_regex(low, '{BLANK_LINES}'), lambda x: list_distinct(regexp_extract_all(x, '{WORD}'))) AS ps FROM d),
m AS (SELECT r, id, label, len(words) AS size, list_max(list_transform(range(1, len(ps) + 1), lambda i: len(list_intersect(words, flatten(ps[i:i + span - 1]))))) AS n FROM b CROSS JOIN t),
g AS (SELECT r, list(DISTINCT label) AS found, max(n / size) AS most FROM m WHERE n >= ceil(size * {LEAST_CONTAINED} - 1e-9) GROUP BY r),
base AS (SELECT r, doc_id, len(w) AS n_words, mit || apache || cc AS places, list_filter([CASE WHEN len(apache) > 0 THEN 'apache-2' END, CASE WHEN len(cc) > 0 THEN 'cc-by-nc' END, CASE WHEN len(mit) > 0 THEN 'mit' END], lambda x: x IS NOT NULL) AS base FROM p)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
  array_to_string(base, ',') AS base_labels, array_to_string(list_sort(list_distinct(base || coalesce(found, []))), ',') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(most, 0.0) END AS score
FROM base LEFT JOIN g USING (r)
"""


ORACLE = _oracle()
