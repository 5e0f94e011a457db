"""Long term lists: every occurrence is found, and few places are offered where nothing starts."""

import random

import pytest
from pyspark.sql import functions as F

from postmine.functions import bits
from postmine.operators import keywords, terms, windows

LETTERS = ["a", "b", "é", "😀", " ", "\n", "ß"]


def joined(spark, texts, listed):
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "_text_key string, _text string")
    table = spark.createDataFrame(list(enumerate(listed)), "pos int, term string")
    return {(r._text_key, r.pos) for r in terms.joined_hits(rows, table).collect()}


def contained(texts, listed):
    return {(str(i), p) for i, t in enumerate(texts) for p, term in enumerate(listed) if t is not None and term in t}


@pytest.mark.parametrize("full", [False, True])
def test_every_occurrence_is_found(spark, monkeypatch, full):
    if full:
        monkeypatch.setattr(bits, "LEAST_BITS", 64)
        monkeypatch.setattr(bits, "MOST_BITS", 64)
    rng = random.Random(1)
    texts = ["".join(rng.choices(LETTERS, k=rng.randint(0, 400))) for _ in range(40)] + [None, "", "x" * 1000 + "needle", "needle" + "y" * 63]
    listed = [t[i : i + n] for t in texts if t for n in (1, 2, 3, 5, 6, 7, 11, 12, 13, 24, 30, 64, 65, 130, 200) for i in [rng.randrange(len(t))]]
    listed += ["needle", "needl", "xneedle", "e" * 6, "absent from all of them", "".join(rng.choices(LETTERS, k=9)), texts[0]]
    assert joined(spark, texts, listed) == contained(texts, listed)


def test_an_empty_term_and_no_term(spark):
    texts = [None, "", "a"]
    assert joined(spark, texts, ["", "a"]) == contained(texts, ["", "a"])
    assert joined(spark, texts, []) == set()


def test_large_tables_are_laid_out_in_copies(spark, monkeypatch):
    monkeypatch.setattr(terms, "fits", lambda rows, size: False)
    texts, listed = ["needle in hay"] * 30 + ["hay", "no"], ["needle", "hay", "in ha", "zzz"]
    assert joined(spark, texts, listed) == contained(texts, listed)


def test_few_places_are_offered_in_vain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").cast("string").alias("_text_key"), F.col("text").alias("_text"))
    words = F.split("text", " ")
    three = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.array_join(F.slice(words, i, F.lit(3)), " "))
    listed = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(F.explode(three).alias("term")).distinct().withColumn("pos", F.lit(0))
    sized = listed.withColumn("n", terms._classes(F.length("term"))).filter("n >= 12")
    gates = [F.xxhash64(F.expr(f"left(term, {n})")) for n in (6, 12)]
    field = bits.bit_field(sized.select(F.explode(F.array(terms._anchor(F.col("n"), F.expr("left(term, n)")), *gates))).distinct())
    sizes = [r.n for r in sized.select("n").distinct().orderBy("n").collect()]
    longest = sized.agg(F.max(F.length("term"))).first()[0]
    offered = docs.select(F.sum(F.size(terms.offered_anchors(F.col("_text"), sizes, longest, field))), F.sum(F.length("_text"))).first()
    assert offered[0] < 0.03 * offered[1]


def test_lists_and_tables_agree_on_letters(spark, make_posts):
    posts = make_posts([("p1", "s", "", "İstanbul STRASSE ẞ"), ("p2", "s", "", "ὈΔΥΣΣΕΎΣ")])
    listed = ["İSTANBUL", "ẞ", "ὀδυσσεύς", "ΣΕΎΣ"]
    table = spark.createDataFrame([(t, t) for t in listed], "query string, term string")
    found = [
        sorted((r.query, r.post_id) for r in keywords.match_keywords(posts, q, inline_limit=n).collect())
        for q, n in ((keywords.build_queries(listed, "singles"), 100), (table, 100), (table, 0))
    ]
    assert [(q.strip('"'), p) for q, p in found[0]] == found[1] == found[2]
    rows = spark.createDataFrame(list(enumerate(listed)), "pos int, term string")
    both = [sorted(map(str, windows.keyword_windows(posts, t, inline_limit=n).collect())) for t, n in ((listed, 100), (rows, 0))]
    assert both[0] == both[1]
