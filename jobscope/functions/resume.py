"""Resumes as text, and profiles as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of resumes that are plain text: fixed values.
TEXT_KINDS = ["text", "txt", "text/plain"]

PROFILE = "struct<skills:array<string>,categories:array<string>,level:string,years:int,target_countries:array<string>>"


def resume_text(data: Column, kind: Column) -> Column:
    """The text of a resume's bytes (UTF-8); null for a kind that can't be read or bytes that aren't UTF-8."""
    return F.when(kind.isin(*TEXT_KINDS), F.try_validate_utf8(data.cast("string")))


def profile_json(profile: Column) -> Column:
    """A profile as JSON with sorted lists; unlike ``to_json``, null years are written."""
    listed = lambda values: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(values), lambda v: F.concat(F.lit('"'), v, F.lit('"'))), ", "), F.lit("]"))
    years = F.coalesce(profile["years"].cast("string"), F.lit("null"))
    return F.concat(F.lit('{"skills": '), listed(profile["skills"]), F.lit(', "categories": '), listed(profile["categories"]), F.lit(', "level": "'), profile["level"], F.lit('", "years": '), years, F.lit(', "target_countries": '), listed(profile["target_countries"]), F.lit("}"))


def read_profile(raw: Column) -> Column:
    """The profile of such a JSON."""
    return F.from_json(raw, PROFILE)
