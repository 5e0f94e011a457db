import pytest
from pyspark.sql import functions as F

from postmine.plans.collect import collect_author_posts, collect_posts
from postmine.plans.enrich import description_with_maps, enrich, feature_rows, reload_and_enrich
from postmine.schemas import POST_COLUMNS
from postmine.sources.stored import read_description, write_csv


def pairs(df, *names):
    return sorted(tuple(row) for row in df.select(*names).collect())


@pytest.fixture
def posts(make_posts):
    return make_posts([
        ("p1", "s", "lies one", "x foo.com", "ann", 1_700_000_100, 5), ("p2", "s", "lies two", "r/t foo.com", "bob", 1_700_000_200, 9),
        ("p3", "t", "lies three", None, "ann", 1_700_000_300, 1), ("p4", "t", "truth", "r/s r/s bar.org", None, 1_600_000_000, 7),
    ])


@pytest.mark.parametrize("saved", [False, True])
def test_search(posts, tmp_path, saved):
    out = str(tmp_path / "out") if saved else None
    found = collect_posts(posts, ["s", "all", "none"], ["lies"], lim=2, out=out)
    assert pairs(found.posts, "scope", "query", "post_id") == [
        ("all", '"lies"', "p2"), ("all", '"lies"', "p3"), ("s", '"lies"', "p1"), ("s", '"lies"', "p2")
    ]
    assert pairs(found.description, "subreddit", "n_posts", "n_comments") == [("all", 2, 0), ("none", 0, 0), ("s", 2, 0)]
    assert pairs(found.domains, "subreddit", "domain", "cnt") == [("all", "foo", 1), ("s", "foo", 2)]


def test_other_modes(posts):
    top = collect_posts(posts, "t", mode="top", as_of="2023-12-31")
    assert pairs(top.posts, "post_id", "query") == [("p3", "")]
    assert pairs(collect_posts(posts, "", mode="new", lim=3).posts, "post_id") == [("p1",), ("p2",), ("p3",)]
    best = collect_posts(posts, None, "lies", lim=1, post_order="top")
    assert pairs(best.posts, "scope", "query", "post_id") == [("all", "lies", "p2")]
    for wrong in ({"mode": "hot"}, {"mode": "top"}, {"post_order": "rising"}, {"query_mode": "x"}):
        with pytest.raises(ValueError):
            collect_posts(posts, "s", ["a"], **wrong)


def test_authors(posts):
    found = collect_author_posts(posts, ["ann", "nobody"])
    assert pairs(found.description, "subreddit", "n_posts") == [("ann", 2), ("nobody", 0)]
    assert pairs(found.domains, "subreddit", "domain", "cnt") == [("ann", "foo", 1)]


def test_enrich(spark, posts, tmp_path):
    desc = spark.createDataFrame([("s",), ("none",), ("t",)], "subreddit string")
    comments = spark.createDataFrame([("p3", "c", "a", "x")], "post_id string, comment_id string, author string, body string")
    known = enrich(desc, posts, comments=comments, lim=1, min_posts=2, out=str(tmp_path / "counts"))
    assert pairs(known.description, "subreddit", "n_posts", "n_comments") == [("none", 0, 0), ("s", 2, 0), ("t", 2, 1)]
    assert pairs(known.mentions, "subreddit", "mention", "cnt") == [("s", "r/t", 1), ("t", "r/s", 2)]
    assert pairs(known.domains, "subreddit", "domain", "cnt") == [("s", "foo", 2), ("t", "bar", 1)]
    assert ("s", "lies two foo") in pairs(known.ngrams, "subreddit", "ngram") and known.ngrams.filter("cnt < 1").count() == 0
    rows = feature_rows(known)
    assert pairs(rows.filter("feature = 'n_posts'"), "subreddit", "item", "cnt") == [("none", "", 0), ("s", "", 2), ("t", "", 2)]
    maps = description_with_maps(known, max_entries=1_000)
    assert maps.count() == 3
    one = maps.filter("subreddit = 't'").first()
    assert (one.part, one.n_posts, one.external_links, one.sub_mentions) == (0, 2, {"bar": 1}, {"r/s": 2})
    split = description_with_maps(known, max_entries=2)
    assert split.count() > 3 and split.agg(F.sum("n_posts")).first()[0] == 4
    assert len(pairs(split.select("subreddit", F.explode("ngrams")), "subreddit", "key")) == known.ngrams.count()


def test_reload_keeps_the_parts_of_both_sides(spark, posts, tmp_path):
    paths = [str(tmp_path / x) for x in ("posts", "stored", "out")]
    write_csv(posts.select(*POST_COLUMNS), paths[0])
    stored = spark.sql(
        "SELECT * FROM VALUES ('s', 7L, map('a', 1L), 0L), ('s', 0L, map('b', 2L), 5L), ('t', 8L, map('c', 3L), 0L) AS t(subreddit, n_posts, external_links, part)"
    )
    write_csv(stored, paths[1])
    got = reload_and_enrich(spark, paths[0], paths[1], stored.columns, paths[2], max_entries=1)
    assert pairs(got.filter("part = 0"), "subreddit", "n_posts") == [("s", 7), ("t", 8)] and got.filter("part > 0").agg(F.sum("n_posts")).first()[0] == 0
    assert pairs(got.select("subreddit", F.explode("external_links")), "subreddit", "key", "value") == [("s", "a", 1), ("s", "b", 2), ("t", "c", 3)]
    assert got.groupBy("subreddit", "part").count().filter("count > 1").count() == 0
    assert read_description(spark, paths[2], index_column=False).count() == got.count()
