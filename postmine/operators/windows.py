"""Keyword windows over the bodies of posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmine.functions.expr import let
from postmine.functions.kwic import WIDTH, term_windows
from postmine.operators.terms import INLINE_TERMS, lowered, terms_in_text


def _with_hits(posts: DataFrame, terms: DataFrame | Sequence[str], compat: bool, inline_limit: int) -> DataFrame:
    """``posts`` with ``terms``, the listed terms found in the lower-cased body."""
    if not compat:
        # With compat, terms keep their case and so a term with capitals is never found.
        if isinstance(terms, DataFrame):
            terms = terms.withColumn("term", F.lower("term"))
        else:
            low = lowered(posts.sparkSession, terms)
            terms = [low[term] for term in terms if term is not None]
    return terms_in_text(posts, F.lower("body"), terms, inline_limit)


def add_windows(
    posts: DataFrame,
    terms: DataFrame | Sequence[str],
    width: int = WIDTH,
    compat: bool = False,
    inline_limit: int = INLINE_TERMS,
) -> DataFrame:
    """``posts`` with ``window``: the contexts of all hits, by term, then by place.

    A body without hits gets an empty list, a missing or empty body gets null.
    """
    hits = _with_hits(posts.drop("window"), terms, compat, inline_limit)
    found = let(
        F.lower("body"),
        lambda text: F.flatten(F.transform("terms", lambda term: term_windows(text, term, width))),
    )
    return hits.withColumn("window", F.when(F.length("body") > 0, found)).drop("terms")


def keyword_windows(
    posts: DataFrame,
    terms: DataFrame | Sequence[str],
    width: int = WIDTH,
    compat: bool = False,
    inline_limit: int = INLINE_TERMS,
) -> DataFrame:
    """Rows ``(post_id, term, hit, window)``, hits counted from 1 within post and term."""
    hits = _with_hits(posts, terms, compat, inline_limit)
    one = hits.select("post_id", F.lower("body").alias("_text"), F.explode("terms").alias("term"))
    placed = F.posexplode(term_windows(F.col("_text"), F.col("term"), width)).alias("_at", "window")
    return one.select("post_id", "term", placed).select(
        "post_id", "term", (F.col("_at") + 1).cast("long").alias("hit"), "window"
    )
