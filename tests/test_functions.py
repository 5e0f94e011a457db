import random
import re

import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postmine.functions import kwic, links, text
from postmine.functions.expr import constant, lookup
from postmine.operators.normalize import utc_text


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("x")).first().x


LINKS = [
    # text, strict links, strict domains, compat links, compat domains
    ("http://foo.com", ["http://foo.com"], ["foo"], ["http://foo.com"], ["oo"]),
    ("facebook.com", ["facebook.com"], ["facebook"], ["facebook.com"], ["acebook"]),
    ("twitter.com", ["twitter.com"], ["twitter"], ["twitter.com"], ["itter"]),
    ("https://www.example.com/a.html", ["https://www.example.com/a.html"], ["example"],
     ["https://www.example.com/a"], ["example"]),
    ("old.reader.com", ["old.reader.com"], ["reader"], ["old.reader"], ["old"]),
    ("en.wikipedia.org", ["en.wikipedia.org"], ["wikipedia"], [".wikipedia.org"], ["ikipedia"]),
    ("end.my friend", [], [], ["end.my"], ["end"]),
    ("foo.bar", [], [], [], []),
    ("e.g. 3.14", [], [], [], []),
    ("naïve.com", ["naïve.com"], ["naïve"], ["naïve.com"], ["naïve"]),
    ("foo.co.uk x.company", ["foo.co.uk"], ["foo"], ["foo.co", "x.company"], ["oo", "x"]),
    ("", [], [], [], []),
    (None, [], [], [], []),
]


@pytest.mark.parametrize("given_text,strict,domains,compat,compat_domains", LINKS)
def test_links(spark, given_text, strict, domains, compat, compat_domains):
    assert one(spark, links.links(F.col("t")), t=given_text) == strict
    assert one(spark, links.domains(F.col("t")), t=given_text) == domains
    assert one(spark, links.links(F.col("t"), "compat"), t=given_text) == compat
    assert one(spark, links.domains(F.col("t"), "compat"), t=given_text) == compat_domains


# The meaning of both modes, tried at every character.
PLAIN = {
    "strict": r"(?:(?:https?|ftp)://)?(?:[\w-]+\.)*([\w-]+)\.(?:de|com|net|org|nl|ca|co\.uk|co|ly|le|in|es)(?!\w)(?:[/?#]\S*)?",
    "compat": links.CLASS_PATTERN.replace(r"\p{L}\p{N}_", r"\w").replace("++)", "+)"),
}
PIECES = ["http://", "ftp://", "www.", "w.", "h", "t", "x", "é", "co", ".com", ".co.uk", ".", ":", "/", "|", "-", "_", " ", "#", "?"]


def test_links_like_the_plain_patterns(spark):
    dice = random.Random(7)
    texts = ["".join(dice.choices(PIECES, k=dice.randint(1, 14))) for _ in range(20_000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    rows = df.select(
        "t", links.links(t).alias("strict"), links.domains(t).alias("strict_domains"),
        links.links(t, "compat").alias("compat"), links.domains(t, "compat").alias("compat_domains"),
    ).collect()
    for row in rows:
        for mode, plain in PLAIN.items():
            hits = list(re.finditer(plain, row.t))
            assert row[mode] == [m[0] for m in hits], (mode, row.t)
            assert row[f"{mode}_domains"] == [m[1] for m in hits], (mode, row.t)


@pytest.mark.parametrize("mode", ["strict", "compat"])
def test_long_unbroken_text(spark, mode):
    long = "a." * 50_000 + " " + "x" * 500_000 + " " + "a/" * 1_000 + " zip.com " + "b.c-" * 20_000
    assert "zip.com" in one(spark, links.links(F.col("t"), mode), t=long)
    assert "zip" in one(spark, links.domains(F.col("t"), mode), t=long)


def windows_of(text_value, term, width=6):
    """The meaning in a few lines: context on both sides, never across another hit."""
    parts = text_value.split(term)
    return [
        " ".join([" ".join(a.split()[-width:]), term, " ".join(b.split()[:width])]) for a, b in zip(parts, parts[1:])
    ]


@pytest.mark.parametrize("body,term,expected", [
    ("a b c d e f g lies h i j lies k l m n o p q r", "lies", ["b c d e f g lies h i j", "h i j lies k l m n o p"]),
    ("lies at start", "lies", [" lies at start"]),
    ("ends in lies", "lies", ["ends in lies "]),
    ("lies lies", "lies", [" lies ", " lies "]),
    ("believes", "lie", ["be lie ves"]),
    ("x a+b y", "a+b", ["x a+b y"]),
    ("x \\E y \\Q z", "\\E", ["x \\E y \\Q z"]),
    ("nothing", "lies", []),
    ("", "lies", []),
    (None, "lies", None),
])
def test_term_windows(spark, body, term, expected):
    assert one(spark, kwic.term_windows(F.col("b"), F.col("t")), b=body, t=term) == expected


words_of = st.text(alphabet="ab \t\n .", max_size=40)


@settings(max_examples=8, deadline=None, phases=[Phase.generate])
@given(st.lists(st.tuples(words_of, st.text(alphabet="ab.", min_size=1, max_size=2)), min_size=1, max_size=25))
def test_term_windows_like_split(spark, pairs):
    df = spark.createDataFrame(list(enumerate(pairs)), "i int, p struct<b:string,t:string>")
    rows = df.select("i", kwic.term_windows(F.col("p.b"), F.col("p.t"), 2).alias("w")).collect()
    for row in rows:
        assert row.w == windows_of(*pairs[row.i], width=2)


@pytest.mark.parametrize("given_text,tokens", [
    ("Don't STOP", ["don", "t", "stop"]),
    ("a;b x_y (z)\\", ["a", "b", "x", "y", "z"]),
    ('r/Foo_Bar & "q" 50%', ["r/foo", "bar", "&", '"', "q", '"', "50", "%"]),
    (" \t\n ", []),
])
def test_raw_tokens(spark, given_text, tokens):
    assert one(spark, text.raw_tokens(F.col("t")), t=given_text) == tokens


def test_stopwords_then_lemmas_then_the_gate(spark):
    tokens = text.clean_tokens(F.col("t"), ["the", "cat", "ain't"], {"cats": "cat", "dogs": "dog"})
    # A lemma that is a stopword stays, and an entry with an apostrophe never matches.
    assert one(spark, tokens, t="The cats and dogs ain't") == ["cat", "and", "dog", "ain", "t"]
    for words, expected in (("", ""), ("one two", ""), ("one the two", ""), ("one two three", "one two three")):
        assert one(spark, text.clean_text(text.clean_tokens(F.col("t"), ["the"])), t=words) == expected


def test_tidy_and_corpus_line(spark):
    line = text.corpus_line(F.col("a"), F.col("b"))
    compat = text.corpus_line(F.col("a"), F.col("b"), compat=True)
    assert one(spark, line, a=" A<newline>\tb ", b="c\nd   e ") == "A b c\nd e"
    assert one(spark, line, a=None, b=None) == ""
    assert one(spark, compat, a=None, b="x") == "nan x"


def test_strip_takes_all_white_space(spark):
    padded = text.SPACE_CHARS + "x y" + text.SPACE_CHARS
    assert padded.strip() == "x y"
    assert all(re.fullmatch(r"\s", c) for c in text.SPACE_CHARS)
    assert one(spark, text.strip(F.col("t")), t=padded) == "x y"


def test_ngrams(spark):
    grams = text.ngrams(text.ngram_words(F.col("t")))
    assert one(spark, grams, t="aa b cc dd") == ["aa cc dd"]
    assert one(spark, grams, t="aa bb") == []
    assert one(spark, grams, t="aa bb cc dd ee") == [
        "aa bb cc", "bb cc dd", "cc dd ee", "aa bb cc dd", "bb cc dd ee", "aa bb cc dd ee"
    ]


def test_lookup_finds_every_entry(spark):
    table = {f"form{i}": f"lemma{i}" for i in range(500)} | {"é": "e"}
    df = spark.createDataFrame([(k,) for k in [*table, "other", ""]], "k string")
    for row in df.select("k", lookup(F.col("k"), table).alias("x")).collect():
        assert row.x == table.get(row.k, row.k)


def test_constant_is_folded(spark, capsys):
    spark.range(1).select(constant([["a"]], "array<array<string>>").alias("x")).explain()
    assert "from_json" not in capsys.readouterr().out


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_utc_text_does_not_depend_on_the_session(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame([(1700000000.9,), (1710054000.0,), (0.0,)], "e double").select(utc_text(F.col("e")).alias("x"))
        assert [r.x for r in rows.collect()] == ["2023-11-14 22:13:20", "2024-03-10 07:00:00", "1970-01-01 00:00:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
