"""Where a posting is: country code and city, from what its source wrote."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobscope import vocab


def _country(segment: Column) -> Column:
    names = F.create_map(*map(F.lit, chain.from_iterable(vocab.COUNTRY_CODES.items())))
    key = F.lower(segment)
    return F.coalesce(F.try_element_at(names, key), F.try_element_at(names, F.trim(F.substring_index(key, " - ", 1))))


def parse_location(raw: Column) -> Column:
    """A struct of ``country`` and ``city``; both null where nothing certain is said.

    Brackets are dropped. A single part is a country, or a city if it is neither a region nor a
    choice ("x or y"). Of several, the last names the country, or a state of the United States, and
    the first the city unless it names the same country.
    """
    cleaned = F.trim(F.regexp_replace(raw, r"\s*\([^)]*\)", ""))
    parts = F.filter(F.transform(F.split(cleaned, ","), lambda s: F.trim(s)), lambda s: s != "")
    first, last, n = F.get(parts, F.lit(0)), F.try_element_at(parts, F.lit(-1)), F.size(parts)
    of_first, of_last = _country(first), _country(last)
    vague = F.lower(first).isin(vocab.REGIONS) | F.lower(first).contains(" or ")
    state = F.upper(last).isin(vocab.US_STATES)
    country = F.when(n == 1, of_first).when(of_last.isNotNull(), of_last).when((n > 1) & state, "US")
    city = F.when((n == 1) & of_first.isNull() & ~vague, first).when((n > 1) & of_last.isNotNull() & ~of_first.eqNullSafe(of_last), first).when((n > 1) & of_last.isNull() & state, first)
    return F.struct(country.alias("country"), city.alias("city"))
