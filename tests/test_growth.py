"""Growing collections, broken records, and empty texts in files."""

import json

import pytest
from pyspark.sql import functions as F

from postmine.operators import features
from postmine.plans import grow
from postmine.sources import dumps, runs, stored
from suite import views as v

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_dumps_one_after_the_other_equal_all_at_once(spark, tmp_path):
    path, posts = str(tmp_path / "grown"), v.posts(spark, FOLDER)
    kinds = ("post", "gate", "mention", "ngram", "domain")
    assert grow.stored_counts(spark, path).count() == 0
    number = F.col("post_id").cast("long")
    for some in (posts.filter(number % 2 == 0), posts.filter(number % 3 == 0), posts.filter(number % 3 == 0), posts.union(posts), posts.limit(0)):
        grow.add_dump(some, path, v.STOPWORDS, v.LEMMAS, kinds)
    assert rows(grow.stored_counts(spark, path)) == rows(features.feature_counts(posts, kinds, v.STOPWORDS, v.LEMMAS))
    found = grow.grown_features(spark, path).filter("kind = 'ngram'").select("subreddit", F.col("item").alias("ngram"), "cnt")
    assert rows(found) == rows(features.frequent_ngrams(posts, v.STOPWORDS, v.LEMMAS))


def test_a_post_counts_as_first_seen_and_once(spark, make_posts, tmp_path, monkeypatch):
    path = str(tmp_path / "grown")
    grow.add_dump(make_posts([("p1", "s", "", "foo.com"), (None, "s", "", "bar.com")]), path)
    later = make_posts([("p1", "t", "", "other.org"), ("p2", "s", "", "foo.com"), (None, "s", "", "bar.com")])
    with monkeypatch.context() as m:
        m.setattr(grow, "list_run", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            grow.add_dump(later, path)
    for _ in range(2):
        grow.add_dump(later.filter("post_id IS NOT NULL"), path)
    found = {(r.subreddit, r.kind, r.item): r.cnt for r in grow.stored_counts(spark, path).collect()}
    assert found[("s", "post", "")] == 3 and found[("s", "domain", "foo")] == 2 and not any(k[0] == "t" for k in found)
    assert len(runs.committed_runs(spark, path)) == 3


def test_broken_records_are_set_aside(spark, tmp_path):
    dump, aside = tmp_path / "dump", str(tmp_path / "aside")
    dump.mkdir()
    good = [{"id": "1", "title": "é;x", "created_utc": 1, "unknown": [1]}, {"id": "2", "over_18": True}, {}]
    bad = ['{"id":"3"', "no object", '{"id":"4","score":"many"}', '[1, 2]', "7"]
    (dump / "a.json").write_text("\n".join([json.dumps(good[0]), bad[0], "", "  ", json.dumps(good[1]), bad[1]]) + "\n")
    (dump / "b.json").write_text("\n".join([*bad[2:], json.dumps(good[2])]))
    posts = dumps.read_raw_posts(spark, str(dump), quarantine=aside)
    assert sorted((r.id or "", r.title) for r in posts.collect()) == [("", None), ("1", "é;x"), ("2", None)] and posts.count() == 3
    lost = spark.read.schema("file string, value string").json(aside).collect()
    assert sorted(r.value for r in lost) == sorted(bad) and {r.file.rsplit("/", 1)[1] for r in lost} == {"a.json", "b.json"}
    assert dumps.read_raw_posts(spark, str(dump)).count() == 3
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        dumps.read_raw_posts(spark, str(dump), bad="fail").collect()
    with pytest.raises(ValueError):
        dumps.read_raw_posts(spark, str(dump), bad="keep")


def test_empty_texts_and_nulls_survive_in_files(spark, make_posts, tmp_path):
    posts = make_posts([("p1", "s", "", None), ("p2", "s", None, ""), ("p3", "s", ' " ', "a;b\n\"c\" \\N null")])
    stored.write_csv(posts.select(*stored.POSTS.fieldNames()), str(tmp_path / "csv"))
    back = stored.read_posts(spark, str(tmp_path / "csv"), index_column=False)
    assert rows(back.select("post_id", "title", "body", "query")) == rows(posts.select("post_id", "title", "body", "query"))
    other = tmp_path / "other.csv"
    other.write_text("post_id;comment_id;author;body\n1;2;;\n1;3;\"\";x\n")
    assert rows(stored.read_comments(spark, str(other), index_column=False)) == [("1", "2", None, None), ("1", "3", "", "x")]
