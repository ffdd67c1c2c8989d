"""Fit of a posting to a resume, and the words that explain it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobscope import vocab

_NONE = "array<string>"


def _seniority(level: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in vocab.SENIORITY.items():
        out = F.when(level == name, rank).otherwise(out)
    return out


def level_gap(profile_level: Column, job_level: Column) -> Column:
    """Steps from the resume's level up to the posting's; null if either is unspecified."""
    return _seniority(job_level) - _seniority(profile_level)


def level_fit(profile_level: Column, job_level: Column) -> Column:
    gap = level_gap(profile_level, job_level)
    penalty = F.when(gap > 0, F.lit(vocab.STRETCH_PENALTY)).otherwise(F.lit(vocab.OVERQUALIFIED_PENALTY))
    return F.coalesce(F.greatest(F.lit(0.0), F.lit(1.0) - penalty * F.abs(gap)), F.lit(vocab.UNKNOWN_LEVEL_FIT))


def sponsor_fit(targets: Column, country: Column, tier: Column) -> Column:
    base = F.lit(0.0)
    for name, fit in vocab.TIER_FIT.items():
        base = F.when(tier == name, F.lit(fit)).otherwise(base)
    off = (F.size(targets) > 0) & ~F.coalesce(F.array_contains(targets, country), F.lit(False))
    return F.when(off, base * F.lit(vocab.OFF_STRATEGY)).otherwise(base)


def score_match(profile: Column, job: Column) -> Column:
    """``overall``, ``skills_score``, ``level_score``, ``sponsor_score`` (0 to 100) and the sorted skills matched and missing.

    ``profile``: struct of skills, categories, level, target_countries. ``job``: struct of skills,
    categories, level, country, sponsor_tier. Halves are rounded to even.
    """
    matched = F.array_sort(F.array_intersect(job["skills"], profile["skills"]))
    missing = F.array_sort(F.array_except(job["skills"], profile["skills"]))
    skill = F.when(F.size(job["skills"]) > 0, F.size(matched) / F.size(job["skills"])).otherwise(0.0)
    category = F.when(F.size(job["categories"]) == 0, vocab.NO_CATEGORY_FIT).when(F.arrays_overlap(profile["categories"], job["categories"]), 1.0).otherwise(0.0)
    level = level_fit(profile["level"], job["level"])
    sponsor = sponsor_fit(profile["target_countries"], job["country"], job["sponsor_tier"])
    overall = F.lit(vocab.SKILL_WEIGHT) * skill + F.lit(vocab.CATEGORY_WEIGHT) * category + F.lit(vocab.LEVEL_WEIGHT) * level + F.lit(vocab.SPONSOR_WEIGHT) * sponsor
    percent = lambda x: F.rint(F.lit(100) * x).cast("int")
    return F.struct(
        percent(overall).alias("overall"),
        percent(skill).alias("skills_score"),
        percent(level).alias("level_score"),
        percent(sponsor).alias("sponsor_score"),
        matched.alias("matched_skills"),
        missing.alias("missing_skills"),
    )


def _listed(skills: Column) -> Column:
    return F.array_join(F.slice(F.array_sort(skills), 1, vocab.LISTED_SKILLS), ", ")


def _lines(*lines: Column) -> Column:
    return F.array_compact(F.array(*lines))


def _by_tier(tier: Column, words: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, sentence in words.items():
        out = F.when(tier == name, sentence).otherwise(out)
    return out


def rationale(profile: Column, job: Column, score: Column) -> Column:
    """``summary``, ``strengths``, ``gaps``, ``verdict`` and ``sponsor_note`` of a scored pair."""
    n, said = F.size(job["skills"]), F.format_string
    coverage = F.when(n > 0, said(vocab.COVERAGE, F.size(score["matched_skills"]), n)).otherwise(vocab.NO_SKILLS)
    shared = F.array_sort(F.array_intersect(profile["categories"], job["categories"]))
    has_field, in_field = F.size(job["categories"]) > 0, F.size(shared) > 0
    ending = F.when(~has_field, vocab.FIELD_ENDINGS["none"]).when(in_field, vocab.FIELD_ENDINGS["inside"]).otherwise(vocab.FIELD_ENDINGS["outside"])
    gap, tier, country, targets = level_gap(profile["level"], job["level"]), job["sponsor_tier"], job["country"], profile["target_countries"]
    targeted = F.size(targets) > 0
    on_target = F.coalesce(F.array_contains(targets, country), F.lit(False))
    strengths = _lines(
        F.when(F.size(score["matched_skills"]) > 0, said(vocab.MATCHED, _listed(score["matched_skills"]))),
        F.when(in_field, said(vocab.FIELD_MATCHES, F.array_join(shared, ", "))),
        F.when(gap == 0, said(vocab.LEVEL_EXACT, job["level"])).when(gap == 1, said(vocab.LEVEL_STEP, profile["level"])),
        _by_tier(tier, vocab.TIER_STRENGTHS),
        F.when(targeted & on_target, said(vocab.ON_TARGET, country)),
    )
    gaps = _lines(
        F.when(F.size(score["missing_skills"]) > 0, said(vocab.MISSING, _listed(score["missing_skills"]))),
        F.when(has_field & ~in_field, said(vocab.FIELD_OUTSIDE, F.array_join(F.array_sort(job["categories"]), ", "))),
        F.when(gap < 0, said(vocab.LEVEL_BELOW, -gap, job["level"], profile["level"])).when(gap >= 2, said(vocab.LEVEL_ABOVE, gap)),
        _by_tier(tier, vocab.TIER_GAPS),
        F.when(targeted & ~on_target, said(vocab.OFF_TARGET, F.coalesce(country, F.lit(vocab.UNNAMED_PLACE)))),
    )
    verdict = F.lit(vocab.VERDICTS[-1][1])
    for floor, words in reversed(vocab.VERDICTS):
        verdict = F.when(score["overall"] >= floor, words).otherwise(verdict)
    note = _by_tier(tier, vocab.SPONSOR_NOTES)
    place = F.coalesce(country, F.lit(vocab.UNNAMED_PLACE.lower()))
    note = F.when(~targeted, note).when(on_target, F.concat(note, F.lit(" "), said(vocab.ON_TARGET, country))).otherwise(F.concat(note, F.lit(" Note: "), said(vocab.OFF_TARGET, place)))
    return F.struct(F.concat(coverage, ending).alias("summary"), strengths.alias("strengths"), gaps.alias("gaps"), verdict.alias("verdict"), note.alias("sponsor_note"))
