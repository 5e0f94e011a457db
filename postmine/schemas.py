"""Table schemas. Reads always give one of these; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_POST = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("selftext", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("over_18", T.BooleanType()),
    T.StructField("num_comments", T.LongType()),
    T.StructField("upvote_ratio", T.DoubleType()),
    T.StructField("distinguished", T.StringType()),
    T.StructField("created_utc", T.DoubleType()),
    T.StructField("permalink", T.StringType()),
    T.StructField("score", T.LongType()),
])

RAW_COMMENT = T.StructType([
    T.StructField("post_id", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("parent_is_post", T.BooleanType()),
])

# Names and order of the columns of stored tables.
POSTS = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("post_id", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("n_comments", T.LongType()),
    T.StructField("up_ratio", T.DoubleType()),
    T.StructField("distinguished", T.StringType()),
    T.StructField("is_nsfw", T.BooleanType()),
    T.StructField("external_links", T.ArrayType(T.StringType())),
])

COMMENTS = T.StructType([
    T.StructField("post_id", T.StringType()),
    T.StructField("comment_id", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("body", T.StringType()),
])

COUNTS = T.MapType(T.StringType(), T.LongType())

DESCRIPTION = T.StructType([
    T.StructField("subreddit", T.StringType()),
    T.StructField("n_posts", T.LongType()),
    T.StructField("n_comments", T.LongType()),
    T.StructField("external_links", COUNTS),
    T.StructField("sub_mentions", COUNTS),
    T.StructField("ngrams", COUNTS),
    # Further rows of a large community; files of other tools have none.
    T.StructField("part", T.LongType()),
])

POST_COLUMNS = POSTS.fieldNames()
