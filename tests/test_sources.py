from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postmine.schemas import POST_COLUMNS
from postmine.session import scratch_dir
from postmine.sources import dumps, lists, runs, stored
from postmine.streaming.collect import append_new_posts


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_lists(spark, tmp_path):
    words = write(tmp_path / "words.txt", "﻿fake news\r\n\n  FUD \nlies", "utf-8")
    assert [tuple(r) for r in lists.read_terms(spark, words).orderBy("pos").collect()] == [(0, "fake news"), (1, "FUD"), (2, "lies")]
    assert [r.term for r in lists.read_terms(spark, words, by="word").orderBy("pos").collect()] == ["fake", "news", "FUD", "lies"]
    with pytest.raises(ValueError):
        lists.read_terms(spark, words, by="page")
    assert {r.word for r in lists.read_stopwords(spark, write(tmp_path / "stop.txt", "a\nwould\nwould\nain't\n")).collect()} == {"a", "would", "ain't"}
    assert {r.scope for r in lists.read_scopes(spark, write(tmp_path / "subs.txt", "x\ny\n")).collect()} == {"x", "y"}
    assert {r.author for r in lists.read_authors(spark, write(tmp_path / "seed.csv", "n,authors\n1,ann\n2,bob\n2,bob\n")).collect()} == {"ann", "bob"}
    lemmas = lists.read_lemmas(spark, write(tmp_path / "lemmas.tsv", "cats\tcat\nmice\tmouse\n"))
    assert dict(tuple(r) for r in lemmas.collect()) == {"cats": "cat", "mice": "mouse"}
    assert lists.scopes_table(spark, "x").first().scope == "x"
    assert [r.term for r in lists.terms_table(spark, ["a", "b"]).collect()] == ["a", "b"]


def test_raw_dumps(spark, tmp_path):
    path = write(tmp_path / "dump.json", '{"id":"1","title":"t","created_utc":5,"num_comments":2,"extra":1}\n')
    row = dumps.read_raw_posts(spark, path).first()
    assert (row.id, row.created_utc, row.num_comments, row.author) == ("1", 5.0, 2, None)
    path = write(tmp_path / "comments.json", '{"post_id":"1","id":"c","body":"b","parent_is_post":true}\n')
    assert dumps.read_raw_comments(spark, path).first().parent_is_post is True


def test_posts_written_by_a_data_frame_tool(spark, tmp_path):
    header = ";" + ";".join(POST_COLUMNS)
    body = 'two\nlines; ""quoted"" \\ naïve'
    row = f'''0;q;s;p1;/l;2023-11-14 22:13:20;;t;"{body}";3.0;0.5;;True;"['a.com', ""it's.de"", 'x\\xa0y']"'''
    path = write(tmp_path / "old.csv", f"﻿{header}\n{row}\n")
    post = stored.read_posts(spark, path).first()
    assert post.body == 'two\nlines; "quoted" \\ naïve' and post.author is None
    assert post.external_links == ["a.com", "it's.de", "x\xa0y"]
    assert (post.n_comments, post.up_ratio, post.is_nsfw) == (3, 0.5, True)
    assert post.created_at == datetime(2023, 11, 14, 22, 13, 20)


def test_description_written_by_a_data_frame_tool(spark, tmp_path):
    path = write(tmp_path / "d.csv", "﻿;subreddit;n_posts;n_comments;external_links\n0;s;2.0;0;\"{'foo': 2, 'b': 1}\"\n1;t;0.0;0;{}\n")
    columns = ["subreddit", "n_posts", "n_comments", "external_links"]
    rows = {r.subreddit: r for r in stored.read_description(spark, path, columns).collect()}
    assert rows["s"].external_links == {"foo": 2, "b": 1} and rows["t"].external_links == {}
    assert rows["s"].n_posts == 2


def test_write_tables(spark, make_posts, tmp_path):
    posts = make_posts([("p1", "s", " padded ", 'a\n"b" \t', "ann"), ("p2", "s", None, "é foo.com", "")])
    comments = spark.createDataFrame([("p1", "c", None, " x ")], "post_id string, comment_id string, author string, body string")
    desc = spark.sql("SELECT 's' AS subreddit, 2L AS n_posts, 0L AS n_comments, map('a', 1L) AS external_links")
    now = datetime(2024, 1, 2, 3, 4, 5)
    paths = stored.write_tables(str(tmp_path), "proj", now, "csv", posts, desc, comments)
    assert paths["posts"].endswith("/proj_posts_2024-01-02_03_04_05.csv") and "/proj_subreddits_" in paths["description"]
    back = {r.post_id: r for r in stored.read_posts(spark, paths["posts"], index_column=False).collect()}
    assert back["p1"].title == " padded " and back["p1"].body == 'a\n"b" \t'
    assert back["p2"].external_links == ["foo.com"] and back["p2"].title is None
    assert stored.read_comments(spark, paths["comments"], index_column=False).first().body == " x "
    columns = desc.columns
    assert stored.read_description(spark, paths["description"], columns, index_column=False).first().external_links == {"a": 1}
    with pytest.raises(Exception, match="(?i)exist"):
        stored.write_tables(str(tmp_path), "proj", now, "csv", posts)
    parquet = stored.write_tables(str(tmp_path), "proj", now, posts=posts)["posts"]
    assert spark.read.parquet(parquet).select(*posts.columns).exceptAll(posts).count() == 0
    titles = spark.read.parquet(parquet).select(stored.title_from_path(F.lit(parquet)).alias("t")).first()
    assert titles.t == "proj"


def test_save_by_scope_replaces_only_its_scopes(spark, make_posts, tmp_path):
    out = str(tmp_path / "posts")
    posts = make_posts([("p1", "a", "", ""), ("p2", "b", "", "")]).withColumn("scope", F.col("subreddit"))
    runs.save_by_scope(posts, out)
    runs.save_by_scope(posts.filter("scope = 'a'").withColumn("post_id", F.lit("p9")), out)
    rows = runs.read_by_scope(spark, out, posts.schema).select("scope", "post_id").collect()
    assert sorted(map(tuple, rows)) == [("a", "p9"), ("b", "p2")]


def test_incremental_collection(spark, tmp_path):
    dump, out, progress = (tmp_path / n for n in ("dump", "out", "progress"))
    dump.mkdir()
    for i in range(2):
        write(dump / f"{i}.json", f'{{"id":"{i}","selftext":"a;b foo.com","created_utc":{i}}}\n')
        append_new_posts(spark, str(dump), str(out), str(progress)).awaitTermination()
        rows = spark.read.parquet(str(out)).orderBy("post_id").collect()
        assert [r.post_id for r in rows] == [str(k) for k in range(i + 1)]
    assert rows[0].body == "a:b foo.com" and rows[0].external_links == ["foo.com"]


class FakeSession:
    """A session on a cluster, as far as scratch_dir looks at it."""

    def __init__(self, **conf):
        self.conf = conf
        self.sparkContext = self
        self.master = "yarn"

    def getConf(self):
        return self.conf


def test_scratch_dir_is_the_shared_folder():
    session = FakeSession()
    with pytest.raises(ValueError):
        scratch_dir(session)
    session.conf["spark.checkpoint.dir"] = "hdfs:///shared/x/"
    assert scratch_dir(session) == "hdfs:///shared/x"
