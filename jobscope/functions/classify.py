"""What a posting is about: categories, skills, seniority, sponsorship."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope import vocab
from jobscope.functions.text import lower


def categories(title: Column) -> Column:
    """Sorted categories whose words the text has; empty, never null, for a text without any."""
    low = lower(title)
    return F.array_compact(F.array(*(F.when(low.rlike(vocab.prefix_alternation(words)), F.lit(name)) for name, words in sorted(vocab.CATEGORIES.items()))))


def skills(text: Column) -> Column:
    """Sorted distinct vocabulary words of the text; at one place the longest counts."""
    found = F.regexp_extract_all(lower(text), F.lit(vocab.prefix_alternation(vocab.ALL_SKILLS)), F.lit(0))
    return F.array_sort(F.array_distinct(found))


def title_level(title: Column) -> Column:
    """The most senior level that the text names, else null."""
    low = lower(title)
    out = F.lit(None).cast("string")
    for name in sorted(vocab.LEVELS, key=vocab.SENIORITY.get):
        out = F.when(low.rlike(vocab.prefix_alternation(vocab.LEVELS[name])), name).otherwise(out)
    return out


def years_of_experience(text: Column) -> Column:
    """The largest number of years that the text asks for, else null."""
    found = F.regexp_extract_all(text, F.lit("(?i)" + vocab.ascii_pattern(vocab.YEARS_PATTERN)), F.lit(1))
    return F.array_max(F.transform(found, lambda y: y.try_cast("int")))


def resolve_level(level_text: Column, years_text: Column) -> Column:
    """A named level wins, then enough years read as senior, else unspecified."""
    return F.coalesce(title_level(level_text), F.when(years_of_experience(years_text) >= vocab.SENIOR_YEARS, "senior"), F.lit(vocab.UNSPECIFIED))


def classify(title: Column, description: Column) -> Column:
    """``categories`` (of the title alone) and ``level`` (title, then years in title and description)."""
    return F.struct(categories(title).alias("categories"), resolve_level(title, F.concat_ws("\n", title, description)).alias("level"))


def tiered(heuristic: Column, reply: Column) -> Column:
    """A heuristic classification, replaced by a parsed model reply where it had found no category.

    ``reply`` is a struct like ``heuristic`` or null; an unspecified level in it keeps the heuristic one.
    """
    use = (F.size(heuristic["categories"]) == 0) & reply.isNotNull()
    return F.struct(
        F.when(use, reply["categories"]).otherwise(heuristic["categories"]).alias("categories"),
        F.when(use, F.coalesce(F.nullif(reply["level"], F.lit(vocab.UNSPECIFIED)), heuristic["level"])).otherwise(heuristic["level"]).alias("level"),
    )


def parse_reply(text: Column) -> Column:
    """Categories and level of a model's JSON reply, prose around it ignored; null if there is none."""
    known = F.array(*map(F.lit, sorted(vocab.CATEGORIES)))
    parsed = F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), "struct<categories:array<string>,level:string>")
    found = F.array_sort(F.array_intersect(F.coalesce(parsed["categories"], F.array().cast("array<string>")), known))
    level = F.when(parsed["level"].isin(*vocab.LEVELS), parsed["level"]).otherwise(vocab.UNSPECIFIED)
    return F.when(parsed["categories"].isNotNull() | parsed["level"].isNotNull(), F.struct(found.alias("categories"), level.alias("level")))


def _any(sentence: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns matches; those are tried whose signal words the sentence has."""
    of: dict[tuple[str, ...], list[str]] = {}
    for p in patterns:
        of.setdefault(_signals(p), []).append(p)
    return reduce(operator.or_, (_has(sentence, words) & sentence.rlike(vocab.ascii_pattern("(?i)(?:" + "|".join(own) + ")")) for words, own in of.items()))


def _signals(pattern: str) -> tuple[str, ...]:
    """The signal words without which a pattern can't match."""
    return tuple(w for w in vocab.SIGNAL_WORDS if w in pattern)


def _has(sentence: Column, words: tuple[str, ...]) -> Column:
    return reduce(operator.and_, (F.lower(sentence).contains(w) for w in words), F.lit(True))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def _clip(sentence: Column, patterns: list[str]) -> Column:
    """The sentence, or a window of whole words around what the first pattern matches in a long one. Each step is worked out once."""
    like = [(_has(sentence, _signals(p)), "(?i)" + vocab.ascii_pattern(p)) for p in patterns]
    start = F.coalesce(*(F.when(has, F.nullif(F.regexp_instr(sentence, F.lit(p)), F.lit(0))) for has, p in like)) - 1
    length = F.coalesce(*(F.when(has, F.nullif(F.length(F.regexp_extract(sentence, p, 0)), F.lit(0))) for has, p in like))
    bounds = lambda m: F.struct(F.greatest(F.lit(0), m["start"] - vocab.EVIDENCE_RADIUS).alias("low"), F.least(F.length(sentence), m["start"] + m["length"] + vocab.EVIDENCE_RADIUS).alias("high"))
    window = lambda b: F.struct(b["low"].alias("low"), b["high"].alias("high"), F.trim(F.substring(sentence, b["low"] + 1, b["high"] - b["low"])).alias("text"))
    body = lambda w: F.when(F.locate(" ", w["text"]) > 0, F.substring(w["text"], F.locate(" ", w["text"]) + 1, F.length(w["text"]))).otherwise("")
    headed = lambda w: F.struct(w["high"].alias("high"), F.when(w["low"] > 0, F.concat(F.lit("… "), body(w))).otherwise(w["text"]).alias("text"))
    tailed = lambda h: F.when(h["high"] < F.length(sentence), F.concat(F.regexp_extract(h["text"], r"(?s)^(.*) ", 1), F.lit(" …"))).otherwise(h["text"])
    steps = reduce(F.transform, (bounds, window, headed, tailed), F.array(F.struct(start.alias("start"), length.alias("length"))))
    return F.when(F.length(sentence) <= 2 * vocab.EVIDENCE_RADIUS, sentence).otherwise(F.get(steps, F.lit(0)))


def with_sponsorship(df: DataFrame, text: str, tier: str = "text_tier", evidence: str = "evidence") -> DataFrame:
    """``df`` with what its text column states: refusals in any sentence come before offers; both null if it is silent.

    Sentences without any word that all patterns are made of are left out before patterns are tried,
    and offers are looked for only where no refusal was found. The steps are columns of their own, so
    that each is worked out once for a row.
    """
    speaks = lambda t: reduce(operator.or_, (F.lower(t).contains(w) for w in vocab.SIGNAL_WORDS))
    said = df.withColumn("_said", F.when(speaks(F.col(text)), F.filter(sentences(F.col(text)), speaks)))
    first = lambda patterns: F.get(F.filter("_said", lambda s: _any(s, patterns)), F.lit(0))
    found = said.withColumn("_no", first(vocab.NO_PATTERNS)).withColumn("_yes", F.when(F.col("_no").isNull(), first(vocab.YES_PATTERNS)))
    told = found.withColumns({tier: F.when(F.col("_no").isNotNull(), "explicit_no").when(F.col("_yes").isNotNull(), "explicit_yes"), evidence: F.when(F.col("_no").isNotNull(), _clip(F.col("_no"), vocab.NO_PATTERNS)).when(F.col("_yes").isNotNull(), _clip(F.col("_yes"), vocab.YES_PATTERNS))})
    return told.drop("_said", "_no", "_yes")


def resolve_tier(text_tier: Column, registry_flags: Column) -> Column:
    """What the text says, else what the registers imply, else unknown."""
    return F.when(text_tier.isin("explicit_no", "explicit_yes"), text_tier).when(registry_flags != 0, "registry_inferred").otherwise("unknown")


def tier_rank(tier: Column) -> Column:
    """Sort rank of a tier, 0 for any other value."""
    out = F.lit(0)
    for name, rank in vocab.TIER_RANK.items():
        out = F.when(tier == name, rank).otherwise(out)
    return out


def match_reason(search: Column, found: Column, country: Column, level: Column, tier: Column) -> Column:
    """Which of a search's criteria a posting meets, in fixed order; ``all`` for a search without any."""
    none = F.array().cast("array<string>")
    wanted = lambda field: F.size(F.coalesce(search[field], none)) > 0
    parts = F.concat(
        F.filter(F.coalesce(search["categories"], none), lambda c: F.array_contains(F.coalesce(found, none), c)),
        F.array_compact(F.array(F.when(wanted("countries"), country), F.when(wanted("levels"), level), F.when(wanted("tiers"), tier))),
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, " · ")).otherwise("all")
