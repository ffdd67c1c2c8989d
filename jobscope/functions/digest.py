"""Digests of new matches as text messages of bounded size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest_line(title: Column, company: Column, country: Column, tier: Column, url: Column, reason: Column) -> Column:
    return F.concat(F.lit("• "), title, F.lit(" — "), company, F.lit(" · "), F.coalesce(F.nullif(country, F.lit("")), F.lit("—")), F.lit(" · "), tier, F.lit("\n  why: "), reason, F.lit("\n  "), url)


def digest_header(search: Column, n: Column) -> Column:
    return F.concat(F.lit("🔔 "), search, F.lit(" ("), n.cast("string"), F.lit(" new)"))


def health_section(alerts: Column, stale: Column) -> Column:
    """The section on sources: ``alerts`` (company, reason, since) and ``stale`` (registry, fetched_at); null if both are empty."""
    lines = F.concat(
        F.transform(alerts, lambda a: F.concat(F.lit("• "), a["company"], F.lit(" — quarantined ("), a["reason"], F.lit(") · last ok "), a["since"])),
        F.transform(stale, lambda s: F.concat(F.lit("• registry "), s["registry"], F.lit(" snapshot stale (fetched "), s["fetched_at"], F.lit(")"))),
    )
    return F.when(F.size(lines) > 0, F.concat(F.lit("⚠ Source health\n"), F.array_join(lines, "\n")))


def build_messages(units: Column, max_chars: int) -> Column:
    """Pack units, in order, into messages of at most ``max_chars``; only a unit longer than that is cut."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(held: Column, unit: Column) -> Column:
        joined = F.when(held["open"] == "", unit).otherwise(F.concat(held["open"], F.lit("\n\n"), unit))
        full = (held["open"] != "") & (F.length(joined) > max_chars)
        done, current = F.when(full, F.concat(held["done"], F.array(held["open"]))).otherwise(held["done"]), F.when(full, unit).otherwise(joined)
        pieces = F.floor((F.length(current) - 1) / max_chars).cast("int")
        whole = F.when(pieces > 0, F.transform(F.sequence(F.lit(0), F.greatest(pieces - 1, F.lit(0))), lambda i: F.substring(current, i * max_chars + 1, F.lit(max_chars)))).otherwise(F.array().cast("array<string>"))
        rest = F.when(pieces > 0, F.substring(current, pieces * max_chars + 1, F.length(current))).otherwise(current)
        return F.struct(F.concat(done, whole).alias("done"), rest.alias("open"))

    return F.aggregate(units, empty, add, lambda held: F.when(held["open"] == "", held["done"]).otherwise(F.concat(held["done"], F.array(held["open"]))))
