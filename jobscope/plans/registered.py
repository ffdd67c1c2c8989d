"""All queries of the posting engine, with their SQL; and examples of fixed rows, which are tests."""

from __future__ import annotations

from jobscope.plans import boards, cycle, entities, feeds, listing, matching, reference, registers, state, texts

_MODULES = [listing, texts, entities, state, matching, cycle, registers, feeds, boards, reference]

#: What reads none of the given tables: held against its SQL by the tests, not registered.
_FIXED = {
    "parse_location_fixture", "classify_titles", "years_max", "level_resolve", "sponsorship_fixture", "name_keys", "registry_names_bits", "resume_profiles", "country_list",
    "greenhouse_parse", "lever_parse", "ashby_parse", "jobtech_parse", "remoteok_parse", "rss_items", "hn_parse",
}

_ALL = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
QUERIES = {name: q for name, q in _ALL.items() if name not in _FIXED}
ORACLES = {name: sql for name, sql in _SQL.items() if name not in _FIXED}
EXAMPLES = {name: (_ALL[name], _SQL[name]) for name in sorted(_FIXED)}
