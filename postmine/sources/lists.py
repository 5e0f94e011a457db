"""Word and name lists kept in small files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmine.functions.text import strip
from postmine.operators.corpus import one_lemma
from postmine.operators.numbering import total_before


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines that are not blank, in no order."""
    rows = spark.read.text(path).select(strip(F.regexp_replace("value", "^\ufeff", "")).alias("value"))
    return rows.filter(F.col("value") != "")


def read_terms(spark: SparkSession, path: str, by: str = "line") -> DataFrame:
    """A keyword file as ``(pos, term)``, counted from 0: one term per line, or with ``by="word"`` per word.

    Large files are read by many tasks: a line is known by its file, the split it begins in and its place there, and
    lines are numbered by ranges of that. Of several files in a folder, positions run on from one to the next, in order
    of their paths. Lines end with a line feed, a carriage return, or both.
    """
    if by not in ("line", "word"):
        raise ValueError('by must be "line" or "word"')
    place = ("_metadata.file_path", "_metadata.file_block_start")
    rows = spark.read.text(path).select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(place)), F.monotonically_increasing_id().alias("_line"), "value")
    text = F.regexp_replace("value", "^\ufeff", "")
    parts = F.array(text) if by == "line" else F.split(text, r"\s+")
    pieces = F.filter(F.transform(parts, strip), lambda piece: piece != "")
    found = rows.select("_0", "_1", "_line", F.posexplode(pieces).alias("_at", "term"))
    order = [F.col(c) for c in ("_0", "_1", "_line", "_at")]
    return total_before(found, order, name="pos").select("pos", "term")


def read_scopes(spark: SparkSession, path: str) -> DataFrame:
    """A file of community names as ``scope``."""
    return _lines(spark, path).select(F.col("value").alias("scope")).distinct()


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """A stopword file as ``word``."""
    return _lines(spark, path).select(F.col("value").alias("word")).distinct()


def read_lemmas(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A file of ``form<sep>lemma`` lines; of several lemmas of a form the first in order counts."""
    return one_lemma(spark.read.schema("form string, lemma string").option("sep", sep).csv(path))


def read_authors(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a column ``authors`` as ``author``."""
    table = spark.read.option("header", True).csv(path)
    return table.select(F.col("authors").alias("author")).filter(F.col("author").isNotNull()).distinct()


def terms_table(spark: SparkSession, terms: str | Iterable[str]) -> DataFrame:
    """A string or list as ``(pos, term)``."""
    listed = [terms] if isinstance(terms, str) else list(terms)
    return spark.createDataFrame(list(enumerate(listed)), "pos int, term string")


def scopes_table(spark: SparkSession, scopes: str | Iterable[str]) -> DataFrame:
    """A string or list as ``scope``."""
    listed = [scopes] if isinstance(scopes, str) else list(scopes)
    return spark.createDataFrame([(name,) for name in listed], "scope string")
