"""Expected values of the text functions, as tables of rows."""

import html

import pytest
from pyspark.sql import functions as F

from jobscope import vocab
from jobscope.functions import classify, digest, names, text
from jobscope.functions.location import parse_location
from jobscope.functions.simhash import hamming, simhash_by_blake2b
from jobscope.functions.threads import parse_header
from jobscope.operators.registry import match_entries
from jobscope.sources import boards


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("r")).first().r


def column(spark, values, f):
    """f applied to each value, in order."""
    df = spark.createDataFrame(list(enumerate(values)), "n int, raw string")
    return [r.r for r in df.select("n", f(F.col("raw")).alias("r")).orderBy("n").collect()]


LOCATIONS = [
    ("Stockholm, Sweden", "SE", "Stockholm"),
    ("Singapore", "SG", None),
    ("Remote", None, None),
    ("Remote (EMEA)", None, None),
    ("London or Berlin", None, None),
    ("San Francisco, CA", "US", "San Francisco"),
    ("Boston, ma", "US", "Boston"),
    ("Toronto, CA", "US", "Toronto"),
    ("Dublin", None, "Dublin"),
    ("Singapore, Singapore", "SG", None),
    ("United States - East (Remote)", "US", None),
    ("Paris, Ile-de-France, France", "FR", "Paris"),
    ("", None, None),
    (None, None, None),
    (" , ", None, None),
]


def test_locations(spark):
    assert [(r.country, r.city) for r in column(spark, [x[0] for x in LOCATIONS], parse_location)] == [x[1:] for x in LOCATIONS]


def test_descriptions(spark):
    raw = ["&lt;p&gt;We &amp;amp; you&lt;/p&gt;", "<b>a</b>&nbsp;<i>b</i>", "  x \n\t y ", "", None, "caf&eacute; &#8364;"]
    assert column(spark, raw[:5], text.normalize_description) == ["We & you", "a b", "x y", "", None]
    assert column(spark, raw, text.normalize_description_full) == ["We & you", "a b", "x y", "", None, html.unescape(raw[5])]
    assert column(spark, ["  Senior \t iOS  Engineer "], text.normalize_title) == ["senior ios engineer"]


def test_times(spark):
    iso = column(spark, ["2026-05-19T20:17:51-04:00", "2026-07-01T09:00:00", "", "junk", None], lambda c: text.iso_time(c, "Europe/Stockholm").cast("string"))
    assert iso == ["2026-05-20 00:17:51", "2026-07-01 07:00:00", None, None, None]
    rfc = column(spark, ["Tue, 01 Jul 2026 12:00:00 +0000", "1 Jul 2026 12:00:00 GMT", "nonsense"], lambda c: text.rfc822_time(c).cast("string"))
    assert rfc == ["2026-07-01 12:00:00", "2026-07-01 12:00:00", None]
    now = F.lit("2026-07-03 11:00:00").cast("timestamp")
    assert column(spark, ["2026-07-03 10:00:00", "2026-07-01 12:00:00", "2026-06-30 10:00:00", None], lambda c: text.posted_ago(c.cast("timestamp"), now)) == ["today", "1d ago", "3d ago", "—"]


TIERS = [
    ("Visa sponsorship available for the right candidate.", "explicit_yes"),
    ("We sponsor work visas for exceptional engineers.", "explicit_yes"),
    ("A generous relocation package is offered.", "explicit_yes"),
    ("We provide work permit assistance.", "explicit_yes"),
    ("We are happy to sponsor visas.", "explicit_yes"),
    ("This role is based in Bangkok, Thailand (Relocation Provided).", "explicit_yes"),
    ("World-class relocation and family support are offered.", "explicit_yes"),
    ("We provide complete relocation for you and your family.", "explicit_yes"),
    ("You must have the right to work in the EU.", "explicit_no"),
    ("No visa sponsorship is provided for this role.", "explicit_no"),
    ("US citizens or green card holders only.", "explicit_no"),
    ("EU work authorization required.", "explicit_no"),
    ("We are unable to sponsor visas at this time.", "explicit_no"),
    ("We are not currently able to sponsor visas for fellows.", "explicit_no"),
    ("We do not offer visa sponsorship for this position.", "explicit_no"),
    ("It will require a relocation to Oslo.", None),
    ("", None),
    (None, None),
]


def test_sponsorship(spark):
    df = classify.with_sponsorship(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TIERS)], "n int, raw string"), "raw", "tier")
    assert [r.tier for r in df.orderBy("n").collect()] == [t for _, t in TIERS]


def test_evidence_is_the_sentence_or_a_window(spark):
    long = "Responsibilities include " + "owning initiatives " * 12 + "and you must have work authorization in the US, " + "and other duties " * 12 + "as assigned."
    df = spark.createDataFrame([(1, "We grow.\nVisa sponsorship is available for this role.\nApply."), (2, long)], "n int, raw string")
    a, b = classify.with_sponsorship(df, "raw").orderBy("n").collect()
    assert (a.text_tier, a.evidence) == ("explicit_yes", "Visa sponsorship is available for this role.")
    assert b.text_tier == "explicit_no" and "work authorization in the US" in b.evidence
    assert b.evidence.startswith("… ") and b.evidence.endswith(" …") and len(b.evidence) < 200


def test_classification(spark):
    found = column(spark, ["Senior Staff iOS Engineer", "HTML wizard", "ML Engineer", None], lambda c: classify.classify(c, F.lit("8 years")))
    assert [(r.categories, r.level) for r in found] == [(["ios"], "staff"), ([], "senior"), (["ai_ml"], "senior"), ([], "senior")]
    reply = classify.parse_reply(F.col("t"))
    assert tuple(one(spark, reply, t='Sure: {"categories": ["ios", "nope"], "level": "wizard"} ok')) == (["ios"], "unspecified")
    assert one(spark, reply, t="I refuse") is None
    heuristic = F.struct(F.array().cast("array<string>").alias("categories"), F.lit("senior").alias("level"))
    assert tuple(one(spark, classify.tiered(heuristic, reply), t='{"categories": ["backend"]}')) == (["backend"], "senior")


MATCHES = [
    ("Spotify", "Spotify Limited", 1.0),
    ("Cohere", "Cohere US, Inc.", 0.9),
    ("Cohere", "Cohere Health, Inc.", None),
    ("Stripe", "STRIPE CONSULTING LIMITED", None),
    ("Stripe", "Stripe Payments UK Ltd", 0.9),
    ("Notion", "Notion Capital Managers LLP", None),
    ("Linear", "Maxlinear, Inc.", None),
    ("Grab", "GRAB + GO LTD", None),
    ("Reddit", "Redditch Care Ltd", None),
    ("Bird (MessageBird)", "MessageBird B.V.", 1.0),
    ("OpenAI", "OpenAI OpCo, LLC", 0.9),
    ("Group", "Group Limited", None),
]


@pytest.mark.parametrize(("seed", "entry", "confidence"), MATCHES)
def test_register_matches(spark, seed, entry, confidence):
    entries = spark.createDataFrame([("UK", 0, entry, [], None)], "registry string, pos long, name string, aliases array<string>, evidence string")
    found = match_entries(spark.createDataFrame([(seed,)], "seed string"), entries).first()
    assert (found.confidence if found else None) == confidence


def test_names(spark):
    keys = column(spark, ["Anthropic, PBC", "180 Amsterdam BV", "N.V. Philips", ""], names.name_key)
    assert keys == [["anthropic"], ["180"], ["philips"], []]
    assert column(spark, ["AgileBits UK Ltd trading as 1Password"], names.split_trading_as)[0].asDict() == {"legal": "AgileBits UK Ltd", "aliases": ["1Password"]}


def test_headers(spark):
    rows = ["Acme (YC W22) | Senior Engineer | Berlin, Germany<p>text", "chat only", "<p>Beta | ONSITE Oslo | Chef", "(only) | Dev | remote"]
    found = [None if r is None else tuple(r) for r in column(spark, rows, parse_header)]
    assert found == [("Acme", "Berlin, Germany", "Senior Engineer"), None, ("Beta", "ONSITE Oslo", None), ("(only)", "remote", "Dev")]


def test_messages(spark):
    df = spark.createDataFrame([(["aaaa", "bbbb", "c" * 25, "dd"],), ([],)], "u array<string>")
    packed = [r.m for r in df.select(digest.build_messages(F.col("u"), 10).alias("m")).collect()]
    assert packed[1] == [] and packed[0] == ["aaaa\n\nbbbb", "c" * 10, "c" * 10, "ccccc\n\ndd"]
    section = digest.health_section(F.array(F.struct(F.lit("A").alias("company"), F.lit("gone").alias("reason"), F.lit("never").alias("since"))), F.array().cast("array<struct<registry:string,fetched_at:string>>"))
    assert one(spark, section, x="") == "⚠ Source health\n• A — quarantined (gone) · last ok never"


def test_fingerprints_of_blake2b(spark):
    base = "we build payments with rust and postgres for merchants in europe " * 5
    a, b, c, empty = column(spark, [base, base + " apply today", "sell shoes in a shop by the sea every day", ""], simhash_by_blake2b)
    df = spark.createDataFrame([(a, b, c)], "a long, b long, c long")
    near, far = df.select(hamming(F.col("a"), F.col("b")).alias("x"), hamming(F.col("a"), F.col("c")).alias("y")).first()
    assert near <= 12 < far and empty == 0


def test_known_tokens_are_looked_up_one_by_one():
    """A text costs its own words, however many the worker knows; long tokens aren't kept."""
    import pandas as pd

    from jobscope.functions import simhash

    class Counted(dict):
        looked = 0

        def get(self, key, default=None):
            Counted.looked += 1
            return super().get(key, default)

        def keys(self):
            raise AssertionError("the whole table was walked")

    known, digest = Counted({f"w{k}": b"12345678" for k in range(50_000)}), lambda w: w[:8].ljust(8)
    simhash._fingerprints(pd.Series(["w1 w2 w3 " + "x" * 40] * 100), digest, known)
    assert Counted.looked == 400 and len(known) == 50_000


def test_words_end_where_ascii_letters_do(spark):
    # as in SQL: an accented letter or a foreign digit beside a word is no part of it
    assert column(spark, ["éios", "iosß and _java", "Kotlin²", "xrust", "İOS"], classify.skills) == [["ios"], ["ios"], ["kotlin"], [], ["ios"]]
    assert column(spark, ["Üsenior", "staffé", "1lead"], classify.title_level) == ["senior", "staff", None]
    assert column(spark, ["5 yearsé", "é7 yrs", "8\x0byears"], classify.years_of_experience) == [5, 7, None]


def test_lower_case_of_each_character_alone(spark):
    assert column(spark, ["İios ΑΣ"], text.normalize_title) == ["iios ασ"]


def test_entities_with_a_semicolon_alone(spark):
    raw = ["a &amp b &amp; c &copy &copy; &eacute; &notit; &amp;lt; &#8364;", None]
    assert column(spark, raw, lambda c: text.normalize_description_full(c, closed=True)) == ["a &amp b & c &copy © é &notit; < €", None]
    assert column(spark, raw[:1], text.normalize_description_full) == [html.unescape(html.unescape(raw[0]))]


def test_evidence_and_headers_read_a_text_once(spark):
    clip = str(classify._clip(F.col("t"), vocab.YES_PATTERNS))
    said = spark.createDataFrame([(1, "Firm | SRE | Berlin, Germany<p>x", 0, False, False)], "id long, text string, time long, deleted boolean, dead boolean")
    assert clip.count("regexp_instr(") == len(vocab.YES_PATTERNS)
    assert "Generate explode" in boards.hiring_comments(said)._jdf.queryExecution().optimizedPlan().toString()


def test_patterns_are_tried_where_their_signal_words_stand():
    assert all(classify._signals(p) for p in vocab.NO_PATTERNS + vocab.YES_PATTERNS)
