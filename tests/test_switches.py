"""Both sides of every size-based switch give the same rows, and no run leaves stale or merged ones."""

import pytest
from pyspark.sql import functions as F

from postmine.operators import corpus, dedupe, keywords, ranking, relations, windows
from postmine.plans.collect import collect_posts
from postmine.sources import lists, runs
from postmine.streaming.collect import append_new_posts


def rows(df, *names):
    return sorted((tuple(r) for r in (df.select(*names) if names else df).collect()), key=repr)


def test_one_lemma_per_form(spark, make_posts):
    posts = make_posts([("p1", "s", "", "katze sat"), ("p2", "s", None, None)])
    lemmas = spark.createDataFrame([("katze", "katze"), ("katze", "cat"), (None, "x"), ("sat", None)], "form string, lemma string")
    both = [rows(corpus.with_clean_tokens(posts, (), lemmas, inline_limit=n), "post_id", "tokens") for n in (0, 100)]
    assert both[0] == both[1] and both[0][0][1] == ["cat", "sat"]


@pytest.mark.parametrize("unique", [True, False])
def test_queries_from_tables(spark, make_posts, unique):
    posts = make_posts([("p1", "s", "One", "two Three"), ("p2", "s", None, None), ("p3", "s", "ONE", None)])
    queries = spark.createDataFrame([("q", "One"), ("q", "one"), ("q", "three"), ("r", None), ("t", "TWO")], "query string, term string")
    both = [keywords.match_keywords(posts, queries, inline_limit=n, unique_ids=unique) for n in (0, 100)]
    assert both[0].columns == both[1].columns
    assert rows(both[0], "query", "post_id") == rows(both[1], "query", "post_id") == [("q", "p1"), ("q", "p3"), ("t", "p1")]
    twice = [keywords.KeywordQuery("q", ("one",)), keywords.KeywordQuery("q", ("three",))]
    found = keywords.match_keywords(posts, twice, unique_ids=unique)
    assert rows(found, "query", "post_id") == [("q", "p1"), ("q", "p3")]


def test_windows_from_tables(spark, make_posts):
    posts = make_posts([("p1", "s", "", "a Two b two c"), ("p2", "s", "", None)])
    terms = spark.createDataFrame([(0, "two"), (0, "two"), (1, None), (2, "TWO")], "pos int, term string")
    both = [rows(windows.keyword_windows(posts, terms, inline_limit=n)) for n in (0, 100)]
    assert both[0] == both[1] and len(both[0]) == 4
    assert rows(windows.keyword_windows(posts, ["two", None])) == [r for r in both[0]][::2]


def test_parts_joined_are_the_whole_text(make_posts):
    posts = make_posts([(f"p{i:03}", "s", "", f"w{i:03} text") for i in range(50)] + [("p007", "s", "", "again")])
    parts = corpus.corpus_by_subreddit(posts, max_chars=60).orderBy("part").collect()
    whole = corpus.corpus_by_subreddit(posts).collect()
    assert len(whole) == 1 and len(parts) > 5
    assert " ".join(r.text for r in parts) == whole[0].text and max(len(r.text) for r in parts) < 90


@pytest.mark.parametrize("lim", [1000, 1001, None])
def test_limits(spark, make_posts, lim):
    posts = make_posts([(f"p{i:04}", "s", "", "x") for i in range(1200)])
    found = ranking.newest_per_group(posts, ["subreddit"], lim)
    assert found.count() == (lim or 1200)
    if lim:
        assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


def test_repeated_rows_use_up_no_limit(make_posts):
    posts = make_posts([("p1", "s", "", "x", "ann", 5), ("p1", "s", "", "x", "ann", 5), ("p2", "s", "", "y", "ann", 4)])
    assert rows(collect_posts(posts, "s", mode="new", lim=2).posts, "post_id") == [("p1",), ("p2",)]
    assert rows(relations.posts_of(posts, ["ann"], 2), "post_id") == [("p1",), ("p2",)]


def test_posts_without_words_are_no_copies(make_posts):
    posts = make_posts([("p1", "s", None, None), ("p2", "s", "", "???"), ("p3", "s", "", ""), ("p4", "s", "", "a b"), ("p5", "s", "", "a  b")])
    found = rows(dedupe.remove_duplicates(posts, by="content"), "post_id")
    assert ("p1",) in found and ("p3",) in found and ("p4",) in found and ("p5",) not in found


def test_emptied_scope_is_emptied(make_posts, tmp_path):
    out = str(tmp_path / "posts")
    posts = make_posts([("p1", "a b%2", "", "one"), ("p2", "t", "", "one")])
    for some, want in ((posts, [("a b%2", 1), ("t", 1)]), (posts.filter("subreddit = 't'"), [("a b%2", 0), ("t", 1)])):
        found = collect_posts(some, ["a b%2", "t"], ["one"], out=out)
        assert rows(found.description, "subreddit", "n_posts") == want


def test_keyword_folder_and_search(spark, make_posts, tmp_path):
    folder = tmp_path / "words"
    folder.mkdir()
    (folder / "a.txt").write_text("x\nz\n")
    (folder / "b.txt").write_text("y\n")
    terms = lists.read_terms(spark, str(folder))
    assert rows(terms) == [(0, "x"), (1, "z"), (2, "y")]
    posts = make_posts([("p1", "s", "", "x"), ("p2", "s", "", "y"), ("p3", "s", "", "n")])
    assert rows(collect_posts(posts, None, terms).posts, "query", "post_id") == [('"x" OR "z" OR "y"', "p1"), ('"x" OR "z" OR "y"', "p2")]
    assert rows(collect_posts(posts, None, terms, query_mode="singles").posts, "query", "post_id") == [('"x"', "p1"), ('"y"', "p2")]


def test_two_streaming_jobs_side_by_side(spark, tmp_path):
    dump = tmp_path / "dump"
    dump.mkdir()
    (dump / "0.json").write_text('{"id":"1","selftext":"a","created_utc":1}\n')
    for name in ("x", "y"):
        append_new_posts(spark, str(dump), str(tmp_path / name), str(tmp_path / f"progress-{name}")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / name)).count() == 1
    with pytest.raises(TypeError):
        append_new_posts(spark, str(dump), str(tmp_path / "z"))


def test_stored_scopes_keep_their_names(spark, make_posts, tmp_path):
    out = str(tmp_path / "posts")
    posts = make_posts([("p1", "2024", "", "")]).withColumn("scope", F.col("subreddit"))
    runs.save_by_scope(posts, out)
    assert runs.read_by_scope(spark, out, "scope string, post_id string").first().scope == "2024"
