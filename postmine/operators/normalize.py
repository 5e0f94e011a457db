"""Raw dump rows to stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmine.functions.links import links

# Fixed values.
DELETED = "[deleted]"


def utc_text(epoch: Column) -> Column:
    """Epoch seconds as ``yyyy-MM-dd HH:mm:ss`` in UTC, whatever the session time zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (start + F.make_dt_interval(secs=F.floor(epoch))).cast("string")


def normalize_posts(raw: DataFrame, link_mode: str = "strict") -> DataFrame:
    """The stored columns of a post, plus ``created_at`` and ``score`` for ranking."""
    body = F.replace("selftext", F.lit(";"), F.lit(":"))
    return raw.select(
        F.lit("").alias("query"),
        F.col("subreddit"),
        F.col("id").alias("post_id"),
        F.col("permalink").alias("link"),
        utc_text(F.col("created_utc")).alias("date"),
        F.col("author"),
        F.col("title"),
        body.alias("body"),
        F.col("num_comments").cast("long").alias("n_comments"),
        F.col("upvote_ratio").cast("double").alias("up_ratio"),
        F.col("distinguished"),
        F.col("over_18").alias("is_nsfw"),
        F.concat(links(F.col("title"), link_mode), links(body, link_mode)).alias("external_links"),
        F.timestamp_seconds("created_utc").alias("created_at"),
        F.col("score"),
    )


def normalize_comments(raw: DataFrame) -> DataFrame:
    """Top-level comments that were not deleted; a missing body is kept."""
    kept = F.col("parent_is_post") & ~F.col("body").eqNullSafe(DELETED)
    return raw.filter(kept).select("post_id", F.col("id").alias("comment_id"), "author", "body")
