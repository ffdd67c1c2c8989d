"""Headers of hiring-thread comments: ``Company | Location | Role | …``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobscope import vocab
from jobscope.functions.location import parse_location
from jobscope.functions.text import normalize_description


def parse_header(text: Column) -> Column:
    """``company``, ``location`` and ``role`` from the first paragraph with text; null if it has fewer than two fields."""
    paragraphs = F.filter(F.transform(F.split(text, r"<p\b[^>]*>|\n"), normalize_description), lambda p: p != "")
    fields = F.filter(F.transform(F.split(F.get(paragraphs, F.lit(0)), r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    # the text is read once: what is found in its fields is worked out from them alone
    return F.get(F.transform(F.array(fields), _header), F.lit(0))


def _header(fields: Column) -> Column:
    rest = F.slice(fields, F.lit(2), F.greatest(F.size(fields), F.lit(1)))
    role = F.get(F.filter(rest, lambda f: F.lower(f).rlike(r"\b(?:" + "|".join(vocab.ROLE_WORDS) + r")\b")), F.lit(0))
    named = F.get(F.filter(rest, lambda f: parse_location(f)["country"].isNotNull()), F.lit(0))
    hinted = F.get(F.filter(rest, lambda f: F.lower(f).rlike("|".join(vocab.PLACE_SIGNALS))), F.lit(0))
    first = F.get(fields, F.lit(0))
    bare = F.trim(F.regexp_replace(first, r"(?:\s*\([^)]*\))+\s*$", ""))
    return F.when(F.size(fields) >= 2, F.struct(F.coalesce(F.nullif(bare, F.lit("")), first).alias("company"), F.coalesce(named, hinted).alias("location"), role.alias("role")))
