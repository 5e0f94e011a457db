"""Keyword in context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmine.functions.expr import let
from postmine.functions.text import words

# Fixed value: words kept on each side of a hit.
WIDTH = 6


def quoted(term: Column) -> Column:
    """A regular expression that matches ``term`` literally."""
    return F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def term_windows(text: Column, term: Column, width: int = WIDTH) -> Column:
    """One window per hit of ``term``; the context never reaches across another hit."""

    def edges(segment: Column) -> Column:
        return let(
            words(segment),
            lambda w: F.struct(
                F.array_join(F.slice(w, 1, width), " ").alias("first"),
                F.array_join(
                    F.slice(w, F.greatest(F.size(w) - F.lit(width - 1), F.lit(1)), F.lit(width)), " "
                ).alias("last"),
            ),
        )

    segments = F.transform(F.split(text, quoted(term), -1), edges)
    return let(
        segments,
        lambda s: F.zip_with(
            F.slice(s, F.lit(1), F.size(s) - 1),
            F.slice(s, F.lit(2), F.size(s)),
            lambda before, after: F.concat_ws(" ", before["last"], term, after["first"]),
        ),
    )
