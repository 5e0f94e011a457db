"""Relations between posts, comments and authors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmine.operators.ranking import GROUP_LIMIT, first_per_key, newest_unique

INLINE_AUTHORS = 20_000


def unique_comments(comments: DataFrame) -> DataFrame:
    """One row per comment id."""
    return first_per_key(comments, ["comment_id"], [F.asc("post_id"), F.asc("author"), F.asc("body")])


def comments_of(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Comments of the given posts, each once."""
    return unique_comments(comments.join(posts.select("post_id"), "post_id", "left_semi"))


def comments_per_subreddit(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Rows ``(subreddit, n_comments)``.

    A repeated comment counts once. Comments are counted per post first, so a post with very many of
    them joins as one row.
    """
    per_post = unique_comments(comments).groupBy("post_id").agg(F.count("*").alias("n"))
    places = posts.filter(F.col("subreddit").isNotNull()).select("post_id", "subreddit").distinct()
    return per_post.join(places, "post_id").groupBy("subreddit").agg(F.sum("n").alias("n_comments"))


def posts_of(posts: DataFrame, authors: DataFrame | Sequence[str], lim: int | None = GROUP_LIMIT) -> DataFrame:
    """The ``lim`` newest posts of each given author (a list, or a table with ``author``), or all of them.

    A post that is there more than once counts once.
    """
    if not isinstance(authors, DataFrame) and len(authors) <= INLINE_AUTHORS:
        listed = list(dict.fromkeys(authors))
        return newest_unique(posts, lambda p: p.filter(F.col("author").isin(listed)), ["author"], lim, n_groups=len(listed))
    if not isinstance(authors, DataFrame):
        authors = posts.sparkSession.createDataFrame([(a,) for a in authors], "author string")
    asked = authors.select("author")
    return newest_unique(posts, lambda p: p.join(asked, "author", "left_semi").select(*p.columns), ["author"], lim)


def rows_per_author(found: DataFrame, authors: DataFrame) -> DataFrame:
    """Collected posts of every author; authors without posts get 0."""
    counts = found.groupBy("author").agg(F.count("*").alias("n_posts"))
    return authors.select("author").join(counts, "author", "left").fillna(0, ["n_posts"])
