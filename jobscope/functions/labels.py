"""What readers see: labels of codes, summaries of searches, the channel of a message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobscope import vocab


def label(code: Column, labels: dict[str, str]) -> Column:
    """The code's label; a code that has none stands for itself."""
    out = code
    for value, words in labels.items():
        out = F.when(code == value, words).otherwise(out)
    return out


def search_summary(f: Column) -> Column:
    """One line for a search's filters (q, countries, categories, levels, tiers); ``all jobs`` without any."""
    some = lambda field, text: F.when(F.size(f[field]) > 0, text)
    parts = F.array(
        some("categories", F.array_join(F.transform(f["categories"], lambda c: label(c, vocab.CATEGORY_LABELS)), "/")),
        some("countries", F.array_join(f["countries"], "+")),
        some("levels", F.array_join(f["levels"], "/")),
        some("tiers", F.concat(F.lit("tier: "), F.array_join(f["tiers"], ","))),
        F.when(F.coalesce(f["q"], F.lit("")) != "", F.concat(F.lit('"'), f["q"], F.lit('"'))),
    )
    found = F.array_compact(parts)
    return F.when(F.size(found) > 0, F.array_join(found, " · ")).otherwise("all jobs")


def channel(token: Column, chat: Column) -> Column:
    """Where messages go: ``telegram`` with both credentials, else ``stdout``."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(given(token) & given(chat), "telegram").otherwise("stdout")
