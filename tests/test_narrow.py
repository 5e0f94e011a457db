"""Rankings and duplicates see ids, times and checksums alone; n-grams are counted before they are made."""

import re

import pytest
from pyspark.sql import functions as F

from postmine.operators import dedupe, features, keywords, ranking, relations
from postmine.plans.collect import collect_posts
from suite import views as v
from tests.compare import plan

FOLDER = "/root/testdata/sf0.001"


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def exchanged_by_windows(text):
    """The columns of every exchange right below a sort of a window, out of a formatted plan."""
    return re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", text)


def formatted(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_rankings_hold_no_texts(spark):
    posts = v.posts(spark, FOLDER)
    search = collect_posts(posts, v.SCOPES, v.KEYWORDS, lim=5, query_mode="singles").posts
    for df in (search, collect_posts(posts, v.SCOPES, mode="new", lim=5).posts, relations.posts_of(posts, v.AUTHORS, 5)):
        text = formatted(df)
        tops = [columns for columns in exchanged_by_windows(text) if "_sum" in columns and "created_at" in columns and "_part" in columns]
        assert tops and not any(re.search(r"\b(title|body|external_links)#", columns) for columns in tops)


def test_late_fetch_equals_wide_ranking(spark):
    posts = v.posts(spark, FOLDER)
    doubled = posts.union(posts.filter("score % 3 = 0"))
    queries = keywords.build_queries(v.KEYWORDS, "singles")
    for order in ranking.ORDERS:
        wide = ranking.newest_per_group(keywords.match_keywords(doubled, queries, v.SCOPES), ["scope", "query"], 7, order)
        late = collect_posts(doubled, v.SCOPES, v.KEYWORDS, lim=7, query_mode="singles", post_order=order).posts
        assert late.columns == wide.columns and rows(late, *late.columns) == rows(wide, *late.columns)
    table = spark.createDataFrame([(s,) for s in v.SCOPES], "scope string")
    by_table = collect_posts(doubled, table, v.KEYWORDS, lim=7, query_mode="singles").posts
    assert rows(by_table, "scope", "query", "post_id") == rows(collect_posts(doubled, v.SCOPES, v.KEYWORDS, lim=7, query_mode="singles").posts, "scope", "query", "post_id")
    with pytest.raises(ValueError):
        collect_posts(posts, post_order="old")


def test_ties_and_null_ids(make_posts):
    posts = make_posts([("p1", "s", "t", "one", "ann", 5), ("p1", "s", "t", "two", "ann", 5), (None, "s", "t", "x", "ann", 9), (None, "s", "t", "x", "ann", 9), ("p2", "s", None, None, "ann", 1)])
    found = collect_posts(posts, "s", mode="new", lim=3).posts
    assert [r[0] for r in rows(found, "post_id")].count(None) == 1 and found.count() == 3
    assert rows(found, "body") == rows(collect_posts(posts.repartition(3), "s", mode="new", lim=3).posts, "body")


def test_copies_have_one_key_and_one_scan(spark):
    posts = v.posts(spark, FOLDER, v.RAW_COPIES)
    text = plan(dedupe.remove_duplicates(posts, by="content").select("post_id", "date")).split("== Initial Plan ==")[0]
    assert text.count("FileScan") == 1 and text.count("sha2(") == 1 and text.count("WindowGroupLimit") == 2


def test_repeated_rows_without_words(make_posts):
    posts = make_posts([("p1", "s", "", "???", "ann", 1), ("p2", "s", "", "???", "ann", 1, 7), ("p2", "s", "", "???", "ann", 1, 7), ("p3", "s", "", "a a a", "ann", 1), ("p4", "s", "a", "A a", "ann", 2)])
    assert rows(dedupe.remove_duplicates(posts, by="content"), "post_id") == [("p1",), ("p2",), ("p3",)]
    assert rows(dedupe.repeat_posts(posts), "post_id") == [("p3",), ("p4",)]
    assert rows(dedupe.repeat_authors(posts), "author", "n_repeated") == [("ann", 2)]
    doubled = posts.union(posts)
    assert dedupe.repeat_posts(doubled).count() == 4 and dedupe.repeat_authors(doubled).first().n_repeated == 4


@pytest.mark.parametrize("sizes", [(3, 5), (1, 3), (2, 2)])
@pytest.mark.parametrize("lim", [2, 7])
def test_frequent_ngrams_equal_counting_all(spark, sizes, lim):
    posts = v.posts(spark, FOLDER)
    every = features.feature_counts(posts, ("ngram",), v.STOPWORDS, v.LEMMAS, sizes).filter(F.col("cnt") >= lim)
    found = features.feature_counts(posts, ("ngram",), v.STOPWORDS, v.LEMMAS, sizes, least_ngrams=lim)
    assert rows(found, *found.columns) == rows(every, *found.columns) and found.count() > 0


def test_few_ngrams_are_made(spark):
    posts = v.posts(spark, FOLDER).select("subreddit", "post_id", "title", "body")
    tokens = features.with_clean_tokens(posts, v.STOPWORDS, v.LEMMAS).withColumn("_words", features.ngram_words(features.clean_text(F.col("tokens"))))
    marked = tokens.withColumn("_starts", features.frequent_starts(tokens, 3, 7))
    made = marked.select(F.sum(F.size(features.ngrams(F.col("_words"), starts=F.col("_starts")))), F.sum(F.size(features.ngrams(F.col("_words"))))).first()
    true = features.feature_counts(posts, ("ngram",), v.STOPWORDS, v.LEMMAS, least_ngrams=7).agg(F.sum("cnt")).first()[0]
    assert true <= made[0] < 0.3 * made[1]


def test_matched_posts_move_once_and_not_per_query(spark):
    text = formatted(keywords.match_keywords(v.posts(spark, FOLDER), keywords.build_queries(v.KEYWORDS, "singles"), v.SCOPES))
    wide = [columns for columns in exchanged_by_windows(text) if "_sum" in columns and "body" in columns]
    assert wide and not any(re.search(r"\bquery#", columns) for columns in wide)


def test_versions_of_a_post_count_by_query(spark, make_posts):
    bodies = ("one two", "two three", "one", "three two", "none", "one two")
    posts = make_posts([("p1", "s", "t", body, "ann", 5 + i // 2) for i, body in enumerate(bodies)] + [(None, "s", "t", body, "bob", 9) for body in bodies] + [("p2", "u", None, "TWO", "ann", 1)])
    posts = posts.union(posts)
    queries = keywords.build_queries(["one", "two", "three", "four"], "singles")
    for scopes in (["s"], ["all", "s"], spark.createDataFrame([("all",), ("u",)], "scope string")):
        want = ranking.unique_posts(keywords.match_keywords(posts, queries, scopes, unique_ids=False), ["scope", "query"])
        found = keywords.match_keywords(posts.repartition(3), queries, scopes)
        assert found.columns == want.columns and rows(found, *found.columns) == rows(want, *found.columns)
