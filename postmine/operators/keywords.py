"""Keyword queries: building them and matching posts against them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmine.functions.expr import constant, let
from postmine.operators.ranking import first_per_key, row_sum, unique_posts
from postmine.operators.terms import INLINE_TERMS, joined_hits, lowered

# Fixed values.
BUNDLE = 25
BUNDLE_GLUE = " OR "
EVERYWHERE = "all"
QUERY_MODES = ("bundled", "singles")


class KeywordQuery(NamedTuple):
    """A query as shown to the user, and its terms; without terms it matches every post."""

    text: str
    terms: tuple[str, ...] = ()


def phrase(term: Column) -> Column:
    """A term in double quotes."""
    return F.concat(F.lit('"'), term, F.lit('"'))


def bundle_terms(terms: DataFrame, size: int = BUNDLE, mode: str = "bundled") -> DataFrame:
    """Rows ``(query_no, query, n_terms)`` from rows ``(pos, term)``, positions counted from 0.

    ``bundled`` joins ``size`` terms at a time, ``singles`` makes one query per term.
    """
    if mode not in QUERY_MODES:
        raise ValueError(f"mode must be one of {QUERY_MODES}")
    per_query = size if mode == "bundled" else 1
    quoted = terms.select(
        F.floor(F.col("pos") / per_query).cast("long").alias("query_no"), "pos", phrase(F.col("term")).alias("term")
    )
    ordered = F.sort_array(F.collect_list(F.struct("pos", "term")))
    return quoted.groupBy("query_no").agg(
        F.array_join(ordered["term"], BUNDLE_GLUE).alias("query"), F.count("*").alias("n_terms")
    )


def build_queries(keywords: str | Sequence[str] | None, mode: str = "bundled", size: int = BUNDLE) -> list[KeywordQuery]:
    """Queries of a keyword argument.

    Nothing, or a blank string, gives the query that matches everything; one string is taken as
    it is; the members of a list are quoted as phrases and bundled, or kept single.
    """
    if mode not in QUERY_MODES:
        raise ValueError(f"mode must be one of {QUERY_MODES}")
    if keywords is None or isinstance(keywords, str):
        word = (keywords or "").strip()
        return [KeywordQuery(word, (word,) if word else ())]
    step = size if mode == "bundled" else 1
    groups = [tuple(keywords[i : i + step]) for i in range(0, len(keywords), step)]
    return [KeywordQuery(BUNDLE_GLUE.join(f'"{term}"' for term in group), group) for group in groups]


def queries_table(terms: DataFrame, mode: str = "bundled", size: int = BUNDLE) -> DataFrame:
    """Rows ``(query, term)`` from rows ``(pos, term)``, as a keyword file gives them: bundled queries and their terms."""
    known = terms.select("pos", "term").filter("term IS NOT NULL")
    step = size if mode == "bundled" else 1
    queries = bundle_terms(known, size, mode).select("query_no", "query")
    return known.withColumn("query_no", F.floor(F.col("pos") / step).cast("long")).join(queries, "query_no").select("query", "term")


def build_scopes(subs: str | Sequence[str] | None) -> list[str]:
    """Scopes of a community argument; nothing means everywhere."""
    if not subs:
        return [EVERYWHERE]
    return [subs] if isinstance(subs, str) else list(dict.fromkeys(subs))


def search_text() -> Column:
    """What a search looks at: title and body, in lower case."""
    return F.lower(F.concat_ws(" ", "title", "body"))


def in_scopes(posts: DataFrame, scopes: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """One row per (scope, post) with ``scope`` set; the scope ``all`` holds every post.

    ``scopes`` is a list, or a table with a column ``scope`` for more than fit in a plan.
    """
    if isinstance(scopes, DataFrame):
        named = scopes.select("scope").filter(F.col("scope") != EVERYWHERE).distinct()
        whole = scopes.filter(F.col("scope") == EVERYWHERE).limit(1).collect()
        found = posts.join(named, posts["subreddit"] == named["scope"])
        return found.unionByName(posts.withColumn("scope", F.lit(EVERYWHERE))) if whole else found
    scopes = build_scopes(scopes)
    named = [s for s in scopes if s != EVERYWHERE]
    if len(named) == len(scopes):
        return posts.filter(F.col("subreddit").isin(named)).withColumn("scope", F.col("subreddit"))
    if not named:
        return posts.withColumn("scope", F.lit(EVERYWHERE))
    own = F.when(F.col("subreddit").isin(named), F.col("subreddit"))
    return posts.withColumn("scope", F.explode(F.array_compact(F.array(own, F.lit(EVERYWHERE)))))


def match_keywords(
    posts: DataFrame,
    queries: Sequence[KeywordQuery] | DataFrame,
    scopes: Sequence[str] | DataFrame | None = None,
    inline_limit: int = INLINE_TERMS,
    unique_ids: bool = True,
) -> DataFrame:
    """One row per (scope, query, post) where the post holds any term of the query.

    Terms are found anywhere in title or body, in any case; null terms are left out. ``queries`` is a list, or a table
    ``(query, term)`` for long lists. ``unique_ids`` drops repeated posts within a query.
    """
    scoped = in_scopes(posts, scopes)
    if isinstance(queries, DataFrame):
        found = _match_table(scoped, queries, inline_limit)
    elif sum(len(q.terms) for q in queries) <= inline_limit:
        return _unique_hits(scoped, _hits(posts.sparkSession, queries)) if unique_ids else _match_list(scoped, queries)
    else:
        rows = [(q.text, term) for q in queries for term in q.terms or ("",)]
        found = _match_table(scoped, posts.sparkSession.createDataFrame(rows, "query string, term string"), inline_limit)
    if not unique_ids:
        return found
    return unique_posts(found, ["scope", "query"])


def _hits(spark: SparkSession, queries: Sequence[KeywordQuery]) -> Column:
    """The distinct queries that a post answers, in the order of the list."""
    # A query that is listed more than once has the terms of all its places.
    low = lowered(spark, [term for q in queries for term in q.terms or ("",)])
    grouped: dict[str, list[str]] = {}
    for q in queries:
        grouped.setdefault(q.text, []).extend(low[term] for term in q.terms or ("",) if term is not None)
    table = [{"text": text, "terms": list(dict.fromkeys(terms))} for text, terms in grouped.items() if terms]
    values = constant(table, "array<struct<text:string,terms:array<string>>>")
    hits = let(
        search_text(),
        lambda text: F.filter(values, lambda q: F.exists(q["terms"], lambda term: F.contains(text, term))),
    )
    return hits["text"]


def _match_list(posts: DataFrame, queries: Sequence[KeywordQuery]) -> DataFrame:
    return posts.drop("query").select("*", F.explode(_hits(posts.sparkSession, queries)).alias("query"))


def _unique_hits(posts: DataFrame, hits: Column) -> DataFrame:
    """What `unique_posts` makes of the rows of `_match_list` by scope and query.

    A post stays one row, with the list of its queries, until its last shuffle: its text moves once and not per query, and
    the rows made of it then stand side by side, where compression sees the repeats. Rows of one id that answer the same
    queries are cut before the first shuffle; what is left of an id are rows with different lists.
    """
    keys, newest = ["scope", "post_id"], [F.desc("created_at"), F.asc("_sum")]
    posts = posts.drop("query")
    names = posts.columns
    some = F.explode(F.filter(F.array(hits), lambda found: F.size(found) > 0)).alias("_hits")
    marked = posts.select("*", row_sum(posts, ["scope"]).alias("_sum"), some)
    versions = first_per_key(marked, [*keys, "_hits"], newest)
    # A query counts for the newest row of an id that answers it.
    newer = F.flatten(F.collect_list("_hits").over(Window.partitionBy(*keys).orderBy(*newest).rowsBetween(Window.unboundedPreceding, -1)))
    left = versions.withColumn("_left", F.array_except("_hits", newer))
    return left.select(*(F.col(f"`{name}`") for name in names), F.explode("_left").alias("query"))


def _match_table(posts: DataFrame, queries: DataFrame, inline_limit: int) -> DataFrame:
    queries = queries.select("query", F.lower("term").alias("term")).filter("term IS NOT NULL").distinct()
    rows = queries.limit(inline_limit + 1).collect()
    if len(rows) <= inline_limit:
        grouped: dict[str, list[str]] = {}
        for row in rows:
            grouped.setdefault(row["query"], []).append(row["term"])
        return _match_list(posts, [KeywordQuery(text, tuple(terms)) for text, terms in grouped.items()])
    terms = queries.select("term").distinct().withColumn("pos", F.lit(0))
    # The search text is never null, which the checksum does not show by itself.
    keyed = posts.drop("query").withColumn("_text_key", F.coalesce(F.sha2(search_text(), 256), F.lit("")))
    hits = joined_hits(keyed.select("_text_key", search_text().alias("_text")), terms)
    # Several terms of one query may be found in a text; the query counts once.
    found = hits.join(queries, "term").select("_text_key", "query").distinct()
    return keyed.join(found, "_text_key").select(*(c for c in keyed.columns if c != "_text_key"), "query")


def rows_per_scope(found: DataFrame, scopes: DataFrame) -> DataFrame:
    """Collected rows of every scope, over all its queries; scopes without a hit get 0."""
    counts = found.groupBy("scope").agg(F.count("*").alias("n_posts"))
    return scopes.select("scope").join(counts, "scope", "left").fillna(0, ["n_posts"])
