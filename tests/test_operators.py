from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postmine.operators import corpus, dedupe, features, keywords, normalize, ranking, relations, summary, windows
from postmine.operators.groups import fold_counts
from postmine.schemas import RAW_COMMENT


def pairs(df, *names):
    return sorted(tuple(row) for row in df.select(*names).collect())


def test_normalize_posts(make_posts):
    post = make_posts([("p1", "s", "a;b foo.com", "c;d x.org x.org", "ann", 1700000000.9)]).first()
    assert (post.title, post.body) == ("a;b foo.com", "c:d x.org x.org")
    assert post.external_links == ["foo.com", "x.org", "x.org"]
    assert post.date == "2023-11-14 22:13:20" and post.query == "" and post.link == "/r/s/p1"


def test_normalize_comments(spark):
    rows = [("p", "c1", "a", "[deleted]", True), ("p", "c2", "a", "[removed]", True), ("p", "c3", "a", None, True), ("p", "c4", "a", "x", False)]
    kept = normalize.normalize_comments(spark.createDataFrame(rows, RAW_COMMENT))
    assert pairs(kept, "comment_id") == [("c2",), ("c3",)]
    assert kept.columns == ["post_id", "comment_id", "author", "body"]


@pytest.mark.parametrize("n,sizes", [(0, []), (1, [1]), (25, [25]), (26, [25, 1]), (53, [25, 25, 3])])
def test_bundles(spark, n, sizes):
    terms = [f"t{i}" for i in range(n)]
    queries = keywords.build_queries(terms)
    assert [len(q.terms) for q in queries] == sizes
    table = spark.createDataFrame(list(enumerate(terms)), "pos int, term string")
    assert pairs(keywords.bundle_terms(table), "query") == sorted((q.text,) for q in queries)
    assert [q.text for q in keywords.build_queries(terms, "singles")] == [f'"{t}"' for t in terms]


def test_queries_and_scopes_of_an_argument():
    assert keywords.build_queries("") == keywords.build_queries(" ") == keywords.build_queries(None) == [("", ())]
    assert keywords.build_queries("fake news") == [("fake news", ("fake news",))]
    assert keywords.build_queries(["a", "b"]) == [('"a" OR "b"', ("a", "b"))]
    assert keywords.build_scopes("") == keywords.build_scopes(None) == keywords.build_scopes([]) == ["all"]
    assert keywords.build_scopes("x") == ["x"] and keywords.build_scopes(["x", "y", "x"]) == ["x", "y"]
    with pytest.raises(ValueError):
        keywords.build_queries(["a"], "other")


@pytest.fixture
def small(make_posts):
    return make_posts([
        ("p1", "s", "Fake News here", "none"), ("p2", "s", "x", "lies and FAKE news"), ("p3", "t", "fake", "news"),
        ("p4", "t", None, "lies"), ("p5", "t", "é", None), ("p2", "s", "x", "lies and FAKE news"),
    ])


@pytest.mark.parametrize("limit", [1000, 0])
def test_match_keywords(small, limit):
    queries = keywords.build_queries(["fake news", "lies", "É"], "singles")
    found = keywords.match_keywords(small, queries, ["s", "all"], inline_limit=limit)
    assert pairs(found, "scope", "query", "post_id") == [
        ("all", '"fake news"', "p1"), ("all", '"fake news"', "p2"), ("all", '"fake news"', "p3"), ("all", '"lies"', "p2"),
        ("all", '"lies"', "p4"), ("all", '"É"', "p5"), ("s", '"fake news"', "p1"), ("s", '"fake news"', "p2"), ("s", '"lies"', "p2"),
    ]
    bundle = keywords.match_keywords(small, keywords.build_queries(["fake news", "lies"]), ["t"], inline_limit=limit)
    assert pairs(bundle, "query", "post_id") == [('"fake news" OR "lies"', "p3"), ('"fake news" OR "lies"', "p4")]
    assert keywords.match_keywords(small, keywords.build_queries(""), inline_limit=limit).count() == 5
    assert keywords.match_keywords(small, keywords.build_queries(""), inline_limit=limit, unique_ids=False).count() == 6


def test_scopes_as_a_table(spark, small):
    scopes = ["s", "all", "nowhere"]
    table = spark.createDataFrame([(s,) for s in scopes], "scope string")
    queries = keywords.build_queries(["lies"])
    found = keywords.match_keywords(small, queries, table)
    assert pairs(found, "scope", "post_id") == pairs(keywords.match_keywords(small, queries, scopes), "scope", "post_id")
    assert pairs(keywords.rows_per_scope(found, table), "scope", "n_posts") == [("all", 2), ("nowhere", 0), ("s", 1)]


@pytest.mark.parametrize("limit", [1000, 0])
def test_windows(small, limit):
    found = windows.add_windows(small.dropDuplicates(["post_id"]), ["LIES", "fake", "lies"], inline_limit=limit)
    assert pairs(found, "post_id", "window") == [
        ("p1", []), ("p2", [" lies and fake news", "lies and fake news", " lies and fake news"]), ("p3", []),
        ("p4", [" lies ", " lies "]), ("p5", None),
    ]
    compat = windows.add_windows(small.dropDuplicates(["post_id"]), ["LIES", "fake"], compat=True, inline_limit=limit)
    assert pairs(compat.filter("post_id IN ('p2', 'p4')"), "post_id", "window") == [("p2", ["lies and fake news"]), ("p4", [])]
    one = windows.keyword_windows(small.dropDuplicates(["post_id"]), ["lies"], inline_limit=limit)
    assert pairs(one, "post_id", "term", "hit", "window") == [("p2", "lies", 1, " lies and fake news"), ("p4", "lies", 1, " lies ")]


def test_long_term_lists_give_the_same_windows(spark, make_posts):
    body = "the quick brown fox é jumps 😀 over the lazy dog " * 9
    posts = make_posts([("p1", "s", "", body), ("p2", "s", "", "q"), ("p3", "s", "", ""), ("p4", "s", "", None)])
    terms = ["q", "quick", "k b", "the lazy dog the quick brown", "é", "😀 o", "zzz", "fox é jumps", "dog the", " "]
    short = windows.keyword_windows(posts, terms)
    table = spark.createDataFrame(list(enumerate(terms)), "pos int, term string")
    assert short.count() > 50
    for given in (terms, table):
        long = windows.keyword_windows(posts, given, inline_limit=0)
        assert pairs(long, "post_id", "term", "hit", "window") == pairs(short, "post_id", "term", "hit", "window")


def test_large_word_tables_give_the_same_tokens(spark, small):
    stop, lemmas = ["and", "here"], {"lies": "lie", "news": "new"}
    tables = (
        spark.createDataFrame([(w,) for w in stop], "word string"),
        spark.createDataFrame(list(lemmas.items()), "form string, lemma string"),
    )
    inline = corpus.with_clean_tokens(small, stop, lemmas)
    for given in (tables, (stop, tables[1]), (tables[0], lemmas)):
        joined = corpus.with_clean_tokens(small, *given, inline_limit=0)
        assert pairs(joined, "post_id", "tokens") == pairs(inline, "post_id", "tokens")
    assert ("p2", ["x", "lie", "fake", "new"]) in pairs(inline, "post_id", "tokens")


def test_mentions_and_their_gate(make_posts):
    posts = make_posts([
        ("p1", "s", "r/Foo_Bar r/foo", "/r/x r/y,r/z"), ("p2", "t", "r/a", "the"), ("p3", "t", None, "r/a"), ("p4", None, "r/n", "b c d"),
        ("p5", "u", "r/a", ""), ("p6", "u", "b", ""), ("p7", "u", "", "c"),
    ])
    assert pairs(features.mentions(posts, ["the"]), "subreddit", "mention", "cnt") == [
        ("s", "r/foo", 2), ("s", "r/y", 1), ("s", "r/z", 1), ("u", "r/a", 1)
    ]
    assert pairs(features.raw_mentions(posts), "subreddit", "mention", "cnt") == [
        ("s", "r/Foo_Bar", 1), ("s", "r/foo", 1), ("s", "r/y,r/z", 1), ("t", "r/a", 2), ("u", "r/a", 1)
    ]


def test_ngrams_count_and_group_size(make_posts):
    def group(sub, texts):
        return [(f"{sub}{i}", sub, "", t) for i, t in enumerate(texts)]

    seven = ["aa bb cc " * 3 + "."] * 2
    posts = make_posts(
        group("two", seven + [])
        + group("three", ["aa bb cc"] * 7)
        + group("six", ["aa bb cc"] * 6)
        + group("blank", ["", "", None])
        + group("mixed", ["aa bb cc dd " * 7, "", ""])
    )
    found = features.frequent_ngrams(posts)
    assert pairs(found.filter("subreddit = 'three'"), "ngram", "cnt") == [("aa bb cc", 7)]
    assert {row.subreddit for row in found.collect()} == {"three", "mixed"}
    assert ("aa bb cc dd", 7) in pairs(found.filter("subreddit = 'mixed'"), "ngram", "cnt")
    assert features.frequent_ngrams(posts, lim=6).filter("subreddit = 'six'").count() == 1
    report = [(r.cnt, r.ngram) for r in features.ngram_report(found).filter("subreddit = 'mixed'").collect()]
    assert report == sorted(report, reverse=True)


def test_domain_counts_sum_title_and_body(make_posts):
    posts = make_posts([("p1", "s", "foo.com", "http://foo.com/x bar.org"), ("p2", "s", "", "foo.com"), ("p3", "t", "", None)])
    assert pairs(features.domain_counts(posts), "subreddit", "domain", "cnt") == [("s", "bar", 1), ("s", "foo", 3)]
    assert pairs(features.domain_counts(posts, "post_id"), "post_id", "domain", "cnt") == [("p1", "bar", 1), ("p1", "foo", 2), ("p2", "foo", 1)]


def test_fold_counts_keeps_everything(spark):
    rows = [("big", f"i{i}", i) for i in range(1000)] + [("small", "x", 1)]
    counts = spark.createDataFrame(rows, "subreddit string, item string, cnt bigint")
    folded = fold_counts(counts, "subreddit", "item", max_entries=100)
    opened = folded.select("subreddit", F.explode("counts").alias("item", "cnt"))
    assert pairs(opened, "subreddit", "item", "cnt") == sorted(rows)
    sizes = pairs(folded, "subreddit", F.size("counts"))
    assert len(sizes) == 11 and max(n for _, n in sizes) < 150


def test_corpus_parts_hold_every_line(make_posts):
    posts = make_posts([(f"p{i:03}", "s", f"t{i}", "b" * (i % 50)) for i in range(300)] + [("q", "t", None, "only")])
    parts = corpus.corpus_by_subreddit(posts, max_chars=1000)
    words = sorted(w for row in parts.collect() for w in row.text.split())
    assert words == sorted(w for row in corpus.corpus_lines(posts).collect() for w in row.line.split())
    assert parts.filter("subreddit = 's'").count() > 3
    assert pairs(corpus.corpus_by_subreddit(posts).filter("subreddit = 't'"), "part", "text") == [(0, "only")]


def test_describe_and_total(spark, small):
    desc = spark.createDataFrame([("s",), ("none",)], "subreddit string")
    described = summary.describe(desc, small)
    assert pairs(described, "subreddit", "n_posts", "n_comments") == [("none", 0, 0), ("s", 3, 0)]
    total = summary.add_total(described)
    assert ("all", 3, 0) in pairs(total, "subreddit", "n_posts", "n_comments")
    assert summary.add_total(total).count() == total.count()
    assert pairs(summary.add_total(described.limit(0)), "subreddit", "n_posts") == [("all", 0)]
    with_map = described.withColumn("ngrams", F.create_map(F.lit("a"), F.lit(1)))
    assert summary.add_total(with_map).filter("subreddit = 'all'").first().ngrams is None
    assert summary.describe(described, small).columns == described.columns


def test_comments(spark, small):
    rows = [("p1", "c1", "a", "x"), ("p1", "c1", "a", "x"), ("p2", "c2", None, None), ("zz", "c3", "a", "x")]
    comments = spark.createDataFrame(rows, "post_id string, comment_id string, author string, body string")
    assert pairs(relations.comments_of(small, comments), "comment_id") == [("c1",), ("c2",)]
    assert pairs(relations.comments_per_subreddit(small, comments), "subreddit", "n_comments") == [("s", 2)]
    desc = spark.createDataFrame([("s",), ("t",)], "subreddit string")
    assert pairs(summary.describe(desc, small, comments), "subreddit", "n_comments") == [("s", 2), ("t", 0)]


def test_top_per_group_breaks_ties_and_keeps_small_groups(make_posts):
    posts = make_posts([(f"p{i:02}", "s", "", "", "ann", 1_700_000_000) for i in range(30)] + [("q", "t", "", "", "bob", 1)])
    found = ranking.newest_per_group(posts, ["subreddit"], 7)
    assert pairs(found, "subreddit", "post_id") == [("s", f"p{i:02}") for i in range(7)] + [("t", "q")]
    assert pairs(relations.posts_of(posts, ["ann", "nobody"], 2), "post_id") == [("p00",), ("p01",)]


def test_top_of_year(make_posts):
    times = [datetime(2023, 3, 1), datetime(2023, 2, 28), datetime(2024, 2, 29), datetime(2024, 3, 1)]
    posts = make_posts([(f"p{i}", "s", "", "", "a", (t - datetime(1970, 1, 1)).total_seconds(), i % 3) for i, t in enumerate(times)])
    found = ranking.top_of_year(posts, datetime(2024, 2, 29))
    assert [r.post_id for r in found.collect()] == ["p2", "p1", "p0"]
    assert pairs(ranking.past_year(posts, "2024-02-29 00:00:00"), "post_id") == [("p0",), ("p1",), ("p2",)]


def test_remove_duplicates(make_posts):
    posts = make_posts([("p1", "s", "a b c", "d", "x", 5), ("p1", "s", "a b c", "d", "x", 3), ("p2", "s", "A, b", "c d!", "y", 9)])
    by_id = dedupe.remove_duplicates(posts)
    assert pairs(by_id, "post_id", F.unix_timestamp("created_at")) == [("p1", 3), ("p2", 9)]
    assert pairs(dedupe.remove_duplicates(by_id), "post_id") == pairs(by_id, "post_id")
    assert pairs(dedupe.remove_duplicates(posts, by="content"), "post_id", F.unix_timestamp("created_at")) == [("p1", 3)]
    assert pairs(dedupe.repeat_posts(posts), "post_id", "author") == [("p1", "x"), ("p1", "x")]
    assert pairs(dedupe.repeat_authors(posts), "author", "n_repeated") == [("x", 2)]
    assert dedupe.append_rows(posts, posts.drop("score")).count() == 6


def test_widths_preview_size(small):
    assert dict(pairs(summary.column_widths(small.select("title", "subreddit", F.lit(None).cast("int").alias("no"))), "column", "width")) == {
        "title": 14, "subreddit": 1, "no": 0
    }
    assert summary.dataset_size(small).first().n_rows == 6
    assert [r.post_id for r in ranking.preview(small, ranking.post_order("top"), 2).collect()] == ["p2", "p5"]
