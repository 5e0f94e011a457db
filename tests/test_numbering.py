"""Running totals by ranges: the same as one task would give, and no task sees a whole hot group."""

import pytest
from pyspark.sql import functions as F

from postmine.operators import corpus, features
from postmine.operators.numbering import in_ranges, total_before
from postmine.sources import lists


@pytest.fixture
def hot(spark):
    """A group with a third of all rows, whose ids begin alike."""
    group = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("s"), F.col("id") % 9))
    return spark.range(3000).select(group.alias("g"), F.format_string("the same twenty character beginning %06d", F.col("id")).alias("k"), (F.col("id") % 11).alias("v"))


def test_totals_equal_those_of_one_task(hot):
    for by in ([], ["g"]):
        found = total_before(hot, [F.desc("k")], F.col("v"), by).collect()
        sums = {}
        for r in sorted(found, key=lambda r: r.k, reverse=True):
            group = r.g if by else 0
            assert r.before == sums.get(group, 0)
            sums[group] = r.before + r.v
        assert len(found) == 3000
    assert total_before(hot.limit(0), [F.col("k")]).count() == 0


def test_a_hot_group_lies_in_many_ranges(hot):
    sizes = in_ranges(hot, [F.col("g"), F.col("k")], 12).filter("g = 'hot'").groupBy("_range").count().collect()
    assert len(sizes) >= 4 and max(r["count"] for r in sizes) < 500


def test_lines_of_large_files_are_numbered_by_many_tasks(spark, tmp_path):
    lines = [f"term {i}" if i % 10 else " " for i in range(20_000)]
    (tmp_path / "a.txt").write_bytes(("\ufeff" + "\r\n".join(lines[:15_000]) + "\r\n").encode())
    (tmp_path / "b.txt").write_text("\n".join(lines[15_000:]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        terms = lists.read_terms(spark, str(tmp_path)).orderBy("pos").collect()
        words = lists.read_terms(spark, str(tmp_path), by="word").orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [x for x in lines if x.strip()]
    assert [tuple(r) for r in terms] == list(enumerate(want))
    assert [r.term for r in words] == [w for x in want for w in x.split()] and words[-1].pos == len(words) - 1
    assert "SinglePartition" not in lists.read_terms(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().split("Window")[0]


def test_report_of_a_hot_community(hot):
    ngrams = hot.filter("g IS NOT NULL").select(F.col("g").alias("subreddit"), F.col("k").alias("ngram"), F.col("v").alias("cnt"))
    found = features.ngram_report(ngrams).collect()
    want = sorted((tuple(r) for r in ngrams.collect()), key=lambda r: (-r[2], [-ord(c) for c in r[1]]))
    for name in ("hot", "s1"):
        assert [(r.ngram, r["rank"]) for r in found if r.subreddit == name] == [(r[1], i) for i, r in enumerate((r for r in want if r[0] == name), 1)]


def test_text_of_a_community_with_one_beginning(hot):
    posts = hot.filter("g = 'hot'").select(F.col("g").alias("subreddit"), F.col("k").alias("post_id"), F.col("k").alias("title"), F.lit(None).cast("string").alias("body"))
    parts = corpus.corpus_by_subreddit(posts, max_chars=1000).orderBy("part").collect()
    assert len(parts) > 30 and " ".join(r.text for r in parts) == " ".join(sorted(r.post_id for r in posts.collect()))
