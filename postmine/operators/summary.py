"""Counts and descriptions of a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmine.operators.relations import comments_per_subreddit

# Fixed value: the name of the grand-total row.
TOTAL = "all"


def subreddit_counts(posts: DataFrame) -> DataFrame:
    """Posts per community; posts without one are left out."""
    known = posts.filter(F.col("subreddit").isNotNull())
    return known.groupBy("subreddit").agg(F.count("*").alias("n_posts"))


def describe(desc: DataFrame, posts: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """``desc`` with ``n_posts`` and ``n_comments``, 0 where nothing was collected.

    Columns that are there already are left as they are; without comments the count is 0.
    """
    out = desc
    if "n_posts" not in out.columns:
        out = out.join(subreddit_counts(posts), "subreddit", "left").fillna(0, ["n_posts"])
    if "n_comments" not in out.columns:
        if comments is None:
            out = out.withColumn("n_comments", F.lit(0).cast("long"))
        else:
            counts = comments_per_subreddit(posts, comments)
            out = out.join(counts, "subreddit", "left").fillna(0, ["n_comments"])
    return out


def add_total(desc: DataFrame) -> DataFrame:
    """``desc`` and a grand-total row, unless it has one already.

    Other columns are null in that row.
    """
    total = desc.agg(
        F.coalesce(F.sum("n_posts"), F.lit(0)).cast("long").alias("n_posts"),
        F.coalesce(F.max(F.col("subreddit") == TOTAL), F.lit(False)).alias("_has_total"),
    ).filter(~F.col("_has_total"))
    row = total.select(F.lit(TOTAL).alias("subreddit"), "n_posts", F.lit(0).cast("long").alias("n_comments"))
    keep = [name for name in row.columns if name in desc.columns]
    return desc.unionByName(row.select(*keep), allowMissingColumns=True)


def dataset_size(posts: DataFrame) -> DataFrame:
    return posts.agg(F.count("*").alias("n_rows"))


def column_widths(df: DataFrame) -> DataFrame:
    """Rows ``(column, width)``: the longest printed value of each column, null counting 0."""
    widths = df.agg(
        *(F.coalesce(F.max(F.length(F.col(name).cast("string"))), F.lit(0)).cast("long").alias(name) for name in df.columns)
    )
    return widths.unpivot([], df.columns, "column", "width")
