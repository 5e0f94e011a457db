"""What the plans look like, and what hot groups do to the results."""

import re

import pytest
from pyspark.sql import functions as F

from postmine.operators import corpus, dedupe, features, keywords, ranking, relations, summary, windows
from suite import queries, views as v
from tests.compare import plan

FOLDER = "/root/testdata/sf0.001"


def test_narrow_operators_do_not_shuffle(spark):
    posts = spark.read.parquet(f"{FOLDER}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("post_id"), F.col("source").alias("subreddit"), F.lit("").alias("title"),
        F.col("text").alias("body"), F.current_timestamp().alias("created_at"),
    )
    queries = keywords.build_queries(v.KEYWORDS)
    for df in (
        corpus.corpus_lines(posts), corpus.with_clean_text(posts, v.STOPWORDS, v.LEMMAS), windows.add_windows(posts, v.KEYWORDS),
        windows.keyword_windows(posts, v.KEYWORDS), keywords.match_keywords(posts, queries, ["src1"], unique_ids=False),
    ):
        assert "Exchange" not in plan(df)


def test_filters_and_columns_reach_the_scan(spark):
    posts = v.posts(spark, FOLDER)
    text = plan(keywords.match_keywords(posts, keywords.build_queries("x"), ["src1"], unique_ids=False).select("post_id"))
    assert "EqualTo(source,src1)" in text
    counted = plan(summary.subreddit_counts(posts))
    assert re.search(r"ReadSchema: struct<(doc_id:bigint,)?source:string>", counted)


def test_append_rows_takes_all_posts_of_an_author(spark, tmp_path):
    folder = str(tmp_path)
    docs = spark.range(1100).select((F.col("id") * 37 + 1).alias("doc_id"), F.lit("a text").alias("text"), F.lit("src1").alias("source"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    n = docs.filter("doc_id % 29 <> 0").count()
    got = {r.query: (r.n_rows, r.n_posts) for r in queries.append_rows(spark, folder).collect()}
    assert n > 1000 and got[""] == (n, n)


def test_top_rows_are_cut_before_the_shuffle(spark):
    posts = v.posts(spark, FOLDER)
    for df in (ranking.newest_per_group(posts, ["subreddit"]), dedupe.remove_duplicates(posts)):
        text = plan(df)
        assert re.search(r"WindowGroupLimit [^\n]*Partial", text), text


def test_mentions_scan_the_text_once(spark):
    df = features.mentions(v.posts(spark, FOLDER), v.STOPWORDS, v.LEMMAS)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert final.count("Generate explode") == 1 and "ReusedExchange" in final


@pytest.fixture(scope="module")
def hot(spark):
    """One community, author and text hold a third of all rows."""
    n = 3000
    is_hot = F.col("id") % 3 == 0
    return spark.range(0, n, 1, 8).select(
        F.lit("").alias("query"),
        F.when(is_hot, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 200)).alias("subreddit"),
        F.when(is_hot, "copy").otherwise(F.col("id").cast("string")).alias("post_id"),
        F.when(is_hot, "ann").otherwise(F.concat(F.lit("u"), F.col("id") % 50)).alias("author"),
        F.lit("aa bb cc").alias("title"),
        F.when(is_hot, "lies r/x foo.com").otherwise(F.concat(F.lit("text lies "), F.col("id"))).alias("body"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("created_at"),
        F.when(is_hot, F.array(F.lit("foo.com"))).otherwise(F.array().cast("array<string>")).alias("external_links"),
        F.col("id").alias("score"),
    )


def test_hot_groups_stay_whole(hot):
    assert summary.subreddit_counts(hot).filter("subreddit = 'hot'").first().n_posts == 1000
    assert features.mentions(hot).first().cnt == 1000
    assert features.domain_counts(hot).first().cnt == 1000
    assert features.frequent_ngrams(hot).filter("subreddit = 'hot' AND ngram = 'aa bb cc'").first().cnt == 1000
    unique = hot.withColumn("post_id", F.col("score").cast("string"))
    newest = ranking.newest_per_group(unique, ["subreddit"], 100)
    assert [r.score for r in newest.filter("subreddit = 'hot'").orderBy("score").collect()] == list(range(2700, 3000, 3))
    assert relations.posts_of(unique, ["ann"]).count() == 1000
    assert dedupe.remove_duplicates(hot).count() == 2001
    assert dedupe.remove_duplicates(hot, by="content").filter("subreddit = 'hot'").count() == 1
    assert dedupe.repeat_posts(hot).count() == 1000
    assert keywords.match_keywords(hot, keywords.build_queries("lies")).count() == 2001


def test_hot_post_joins_as_one_row(hot):
    comments = hot.select("post_id", F.col("score").cast("string").alias("comment_id"), "author", "body")
    counts = relations.comments_per_subreddit(hot, comments).filter("subreddit = 'hot'").first()
    assert counts.n_comments == 1000
    assert relations.comments_of(hot, comments).count() == 3000


@pytest.mark.parametrize("n", [1, 13])
def test_results_do_not_depend_on_partitions(hot, n):
    def rows(df):
        return sorted(map(str, df.collect()))

    other = hot.repartition(n)
    for run in (
        lambda d: corpus.corpus_by_subreddit(d.withColumn("post_id", F.col("score").cast("string")), max_chars=2000),
        features.frequent_ngrams, features.mentions, dedupe.remove_duplicates,
        lambda d: ranking.newest_per_group(d.withColumn("post_id", F.col("score").cast("string")), ["author"], 5),
    ):
        assert rows(run(hot)) == rows(run(other))
