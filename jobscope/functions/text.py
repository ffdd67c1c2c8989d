"""Texts and times of postings, as column expressions."""

from __future__ import annotations

import html
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Entities that the native path knows, ``&amp;`` last; the full table is in ``normalize_description_full``.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"), ("&rsquo;", "’"), ("&bull;", "•"), ("&amp;", "&")]


#: An entity with its semicolon.
_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def unescape(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def normalize_description(raw: Column) -> Column:
    """Plain text of escaped HTML: unescaped, tags as spaces, unescaped again, white space collapsed and trimmed."""
    bare = unescape(F.regexp_replace(unescape(raw), "<[^>]+>", " "))
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def _unescape_full(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def _unescape_closed(text: pd.Series) -> pd.Series:
    known = lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0]
    return text.map(lambda t: _CLOSED.sub(known, t), na_action="ignore")


def normalize_description_full(raw: Column, closed: bool = False) -> Column:
    """``normalize_description`` with the whole entity table, which only Python has (an Arrow-batched function).

    Old names (``&amp``, ``&copy``) are entities without a semicolon too, as browsers read them, unless only ``closed`` ones are.
    """
    full = _unescape_closed if closed else _unescape_full
    bare = full(F.regexp_replace(full(raw), "<[^>]+>", " "))
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def content_hash(description: Column) -> Column:
    """SHA-256 of the normalized description alone."""
    return F.sha2(description, 256)


def lower(text: Column) -> Column:
    """Lower case of each character by itself, as SQL has it: a dotted capital I is one letter, and a sigma is the same at a word's end."""
    return F.lower(F.replace(F.replace(text, F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ")))


def normalize_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(lower(title), r"(?U)\s+", " "))


def iso_time(value: Column, zone: str = "UTC") -> Column:
    """UTC time of an ISO string; one without an offset is read in ``zone``; what can't be read is null."""
    parsed = F.try_to_timestamp(F.nullif(value, F.lit("")))
    naive = ~value.rlike(r"(?:Z|[+-][0-9]{2}:?[0-9]{2})$")
    return F.when(naive & (F.lit(zone) != "UTC"), F.to_utc_timestamp(parsed, zone)).otherwise(parsed)


def epoch_seconds(value: Column) -> Column:
    return F.timestamp_seconds(value)


def epoch_millis(value: Column) -> Column:
    return F.timestamp_millis(value)


def rfc822_time(value: Column) -> Column:
    """Time of an RFC-822 date, whatever weekday it names."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(value), r"^[A-Za-z]{3},\s*", ""), r"GMT$", "+0000")
    return F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z"))


def posted_ago(posted_at: Column, now: Column) -> Column:
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(posted_at)) / 86400)
    return F.when(posted_at.isNull(), "—").when(days <= 0, "today").otherwise(F.concat(days.cast("string"), F.lit("d ago")))


def local_month(ts: Column, zone: str) -> Column:
    """The month of a UTC time in a zone, ``yyyy-MM``."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM")


def first_non_empty(*values: Column) -> Column:
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def failure_kind(status_code: Column) -> Column:
    """What a failed fetch means: the address is gone, or can't be reached now."""
    return F.when(status_code.isin(404, 410), "gone").otherwise("unreachable")


def split_company_role(title: Column) -> Column:
    """``company`` and ``role`` of "Company: Role"; a title without a company is the role alone."""
    at = F.locate(": ", title)
    return F.struct(F.when(at > 0, F.trim(F.substring(title, F.lit(1), at - 1))).alias("company"), F.when(at > 0, F.trim(F.substring(title, at + 2, F.length(title)))).otherwise(title).alias("role"))


def trusted_iso2(code: Column) -> Column:
    """A two-letter country code as it is given, else null."""
    return F.when(code.rlike("^[A-Za-z]{2}$"), F.upper(code))
