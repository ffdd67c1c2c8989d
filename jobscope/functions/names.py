"""Company names as sets of distinctive words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobscope import vocab


def _literals(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def name_tokens(name: Column) -> Column:
    """Lower-cased words; full stops are glue, everything else that isn't a letter or digit separates."""
    return F.filter(F.split(F.replace(F.lower(name), F.lit("."), F.lit("")), "[^a-z0-9]+"), lambda t: t != "")


def name_core(name: Column) -> Column:
    """Sorted distinct words without legal suffixes."""
    return F.array_sort(F.array_distinct(F.filter(name_tokens(name), lambda t: ~t.isin(vocab.SUFFIX_TOKENS))))


def name_key(name: Column) -> Column:
    """The core without geography and structural words: two names match if their keys are equal."""
    return F.array_except(name_core(name), _literals(vocab.GEO_TOKENS + vocab.STRUCTURAL_TOKENS))


def split_trading_as(raw: Column) -> Column:
    """``legal`` name and ``aliases`` of "Legal trading as Alias"."""
    parts = F.transform(F.split(raw, r"(?i)\s+(?:trading\s+as|t/a|dba)\s+"), lambda p: F.trim(p))
    return F.struct(parts[0].alias("legal"), F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda p: p != "").alias("aliases"))


def name_variants(seed: Column) -> Column:
    """The name without its brackets, and what stands in them."""
    inner = F.filter(F.transform(F.regexp_extract_all(seed, F.lit(r"\(([^)]*)\)"), F.lit(1)), lambda p: F.trim(p)), lambda p: p != "")
    return F.concat(F.array(F.trim(F.regexp_replace(seed, r"\([^)]*\)", ""))), inner)


def registry_names(flags: Column) -> Column:
    """Names of the registers in a bit mask."""
    return F.array_compact(F.array(*(F.when(flags.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for name, bit in vocab.REGISTRY_BITS.items())))
