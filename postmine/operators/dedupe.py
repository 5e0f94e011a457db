"""Repeated posts."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmine.functions.expr import let
from postmine.functions.text import MIN_CLEAN_TOKENS, clean_tokens, corpus_line
from postmine.operators.ranking import first_per_key, row_sum
from postmine.session import written

MIN_REPEATS = 2
#: The checksum of no tokens.
BLANK = hashlib.sha256(b"").hexdigest()


def append_rows(*tables: DataFrame) -> DataFrame:
    """All rows of all tables, repeats kept; columns a table lacks are null."""
    first, *rest = tables
    for table in rest:
        first = first.unionByName(table, allowMissingColumns=True)
    return first


def content_key(stopwords: Sequence[str] = ()) -> Column:
    """Checksum of the cleaned title and body."""
    tokens = clean_tokens(corpus_line(F.col("title"), F.col("body")), stopwords)
    return F.sha2(F.array_join(tokens, " "), 256)


def remove_duplicates(posts: DataFrame, by: str = "id") -> DataFrame:
    """The earliest row of every post id, or with ``by="content"`` of every cleaned text.

    Posts whose text has no token left are no copies of each other: all of them stay, but a row that is there twice, equal
    in every column, is one post. Of rows equal in time, id, query and community the least checksum counts.
    """
    if by not in ("id", "content"):
        raise ValueError('by must be "id" or "content"')
    marked = posts.withColumn("_sum", row_sum(posts))
    if by == "id":
        return first_per_key(marked, ["post_id"], [F.asc(c) for c in ("created_at", "query", "subreddit", "_sum")]).drop("_sum")
    own = F.concat_ws(" ", F.lit("row"), "post_id", F.col("_sum").cast("string"))
    keyed = marked.withColumn("_content", let(content_key(), lambda key: F.when(key == BLANK, own).otherwise(key)))
    order = [F.asc(c) for c in ("created_at", "post_id", "query", "subreddit", "_sum")]
    return first_per_key(keyed, ["_content"], order).drop("_content", "_sum")


def _texts_of_authors(posts: DataFrame) -> DataFrame:
    """Rows ``(author, _content, _size, _id, _sum)``: what each author wrote, by checksum, and which row it is."""
    content = let(
        clean_tokens(corpus_line(F.col("title"), F.col("body"))),
        lambda tokens: F.struct(F.sha2(F.array_join(tokens, " "), 256).alias("key"), F.size(tokens).alias("n_tokens")),
    )
    found = posts.filter(F.col("author").isNotNull()).select("author", F.col("post_id").alias("_id"), row_sum(posts).alias("_sum"), content.alias("_text"))
    return found.select("author", F.col("_text.key").alias("_content"), F.col("_text.n_tokens").alias("_size"), "_id", "_sum")


def _repeated(texts: DataFrame, min_repeats: int) -> DataFrame:
    # The size is tested after counting: tested before, the text would be cleaned twice.
    counted = texts.groupBy("author", "_content").agg(F.count("*").alias("_n"), F.max("_size").alias("_most"))
    return counted.filter((F.col("_n") >= min_repeats) & (F.col("_most") >= MIN_CLEAN_TOKENS))


def repeat_posts(posts: DataFrame, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """Posts whose author wrote the same cleaned text ``min_repeats`` times or more.

    This is our own meaning of an automated poster; blank texts do not count. Texts are cleaned once, and the checksums
    written; the posts themselves are fetched by author, id and checksum of the row.
    """
    texts = written(_texts_of_authors(posts), "contents")
    rows = texts.join(_repeated(texts, min_repeats), ["author", "_content"], "left_semi").select(F.col("author").alias("_author"), "_id", F.col("_sum").alias("_total"))
    marked = posts.withColumn("_sum", row_sum(posts))
    same = (F.col("author") == F.col("_author")) & F.col("post_id").eqNullSafe(F.col("_id")) & (F.col("_sum") == F.col("_total"))
    return marked.join(rows, same, "left_semi").select(*posts.columns)


def repeat_authors(posts: DataFrame, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """Rows ``(author, n_repeated)`` of the authors of :func:`repeat_posts`, from the counts alone."""
    repeated = _repeated(_texts_of_authors(posts), min_repeats)
    return repeated.groupBy("author").agg(F.sum("_n").alias("n_repeated"))
