"""Collecting posts by keyword, rank or author, and comments of the posts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmine.operators.features import domain_counts
from postmine.operators.keywords import build_queries, build_scopes, in_scopes, match_keywords, queries_table, rows_per_scope
from postmine.operators.ranking import GROUP_LIMIT, newest_unique, past_year
from postmine.operators.relations import comments_of, posts_of, rows_per_author
from postmine.sources.lists import scopes_table, terms_table
from postmine.sources.runs import read_by_scope, save_by_scope

MODES = ("search", "top", "new")


class Collection(NamedTuple):
    """Collected posts, the description of what was asked for, its domains in long form, and comments if asked for."""

    posts: DataFrame
    description: DataFrame
    domains: DataFrame
    comments: DataFrame | None = None


def _saved(posts: DataFrame, asked: DataFrame, out: str | None) -> DataFrame:
    """Everything that follows reads the saved table instead of collecting again."""
    if out is None:
        return posts
    save_by_scope(posts, out, asked=asked)
    saved = read_by_scope(posts.sparkSession, out, posts.schema)
    return saved.join(asked, "scope", "left_semi").select(*posts.columns)


def _description(found: DataFrame, scopes: DataFrame, link_mode: str) -> Collection:
    description = rows_per_scope(found, scopes).select(
        F.col("scope").alias("subreddit"), "n_posts", F.lit(0).cast("long").alias("n_comments")
    )
    domains = domain_counts(found, "scope", link_mode).withColumnRenamed("scope", "subreddit")
    return Collection(found, description, domains)


def collect_posts(
    posts: DataFrame,
    subs: str | Sequence[str] | DataFrame | None = None,
    keywords: str | Sequence[str] | DataFrame | None = None,
    mode: str = "search",
    lim: int | None = GROUP_LIMIT,
    query_mode: str = "bundled",
    post_order: str = "new",
    as_of: datetime | str | None = None,
    link_mode: str = "strict",
    out: str | None = None,
    comments: DataFrame | None = None,
) -> Collection:
    """Posts of every scope: those matching the keywords, the top of the past year, or the newest.

    ``posts`` are normalised posts. ``search`` gives up to ``lim`` posts per scope and query,
    ``new`` up to ``lim`` per scope, ``top`` all posts of the year up to ``as_of``. The last two
    ignore the keywords. Keywords are a string, a list, a table ``(query, term)``, or a table
    ``(pos, term)`` as a keyword file gives it. With ``out`` the posts are saved there by scope.
    Of ``comments`` those of the collected posts are collected too, each once.
    """
    spark = posts.sparkSession
    scopes = subs if isinstance(subs, DataFrame) else build_scopes(subs)
    if mode == "search":
        if not isinstance(keywords, DataFrame):
            queries = build_queries(keywords, query_mode)
        else:
            queries = keywords if "query" in keywords.columns else queries_table(keywords, query_mode)
        # Tables of scopes or queries are of any length; lists bound the number of groups.
        n_groups = None if isinstance(scopes, DataFrame) or isinstance(queries, DataFrame) else len(scopes) * len(queries)
        found = newest_unique(posts, lambda p: match_keywords(p, queries, scopes, unique_ids=False), ["scope", "query"], lim, post_order, n_groups, again=False)
    elif mode == "new":
        n_groups = None if isinstance(scopes, DataFrame) else len(scopes)
        found = newest_unique(posts, lambda p: in_scopes(p, scopes), ["scope"], lim, "new", n_groups)
    elif mode == "top":
        if as_of is None:
            raise ValueError("mode top needs as_of, the end of the year")
        found = in_scopes(past_year(posts, as_of), scopes)
    else:
        raise ValueError(f"mode must be one of {MODES}")
    asked = scopes.select("scope").distinct() if isinstance(scopes, DataFrame) else scopes_table(spark, scopes)
    collected = _description(_saved(found, asked, out), asked, link_mode)
    return collected if comments is None else collected._replace(comments=comments_of(collected.posts, comments))


def collect_author_posts(
    posts: DataFrame, authors: Sequence[str] | DataFrame, lim: int = GROUP_LIMIT, link_mode: str = "strict"
) -> Collection:
    """The newest posts of each author; the description has one row per author."""
    if isinstance(authors, DataFrame):
        asked = authors.select("author").distinct()
    else:
        asked = terms_table(posts.sparkSession, dict.fromkeys(authors)).select(F.col("term").alias("author"))
    found = posts_of(posts, authors, lim)
    description = rows_per_author(found, asked).select(
        F.col("author").alias("subreddit"), "n_posts", F.lit(0).cast("long").alias("n_comments")
    )
    domains = domain_counts(found, "author", link_mode).withColumnRenamed("author", "subreddit")
    return Collection(found, description, domains)
