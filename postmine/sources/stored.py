"""Stored collections: semicolon-separated CSV for exchange, Parquet for work."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmine.schemas import COMMENTS, DESCRIPTION, POSTS

# Fixed values.
SEPARATOR = ";"
STAMP_FORMAT = "%Y-%m-%d_%H_%M_%S"
NAMES = {"posts": "posts", "description": "subreddits", "comments": "comments"}

#: A text that no cell holds: two characters of private use.
NULL_MARK = "\ue0a5\uf8d3"
CSV_OPTIONS = {
    "sep": SEPARATOR, "header": "true", "quote": '"', "escape": '"',
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def run_stamp(now: datetime) -> str:
    """The part of a file name that tells runs apart."""
    return now.strftime(STAMP_FORMAT)


def title_from_path(path: Column) -> Column:
    """The collection title: the base name up to its first underscore."""
    return F.split(F.element_at(F.split(path, "/"), -1), "_")[0]


def stamp_from_path(path: Column) -> Column:
    """The run stamp at the end of the base name, without an ending."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\d{4}-\d{2}-\d{2}_\d{2}_\d{2}_\d{2})(?:\.\w+)?$", 1)


def _nested_text(text: Column, kind: T.DataType) -> Column:
    """A list or dict in JSON or in Python notation."""
    # Python writes characters it does not print as \\xNN, JSON knows \\u00NN only.
    json_text = F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)\\x([0-9a-f]{2})", r"$1\\u00$2")
    return F.from_json(json_text, kind, {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"})


def _typed(name: str, kind: T.DataType) -> Column:
    text = F.col(name)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return _nested_text(text, kind).alias(name)
    if isinstance(kind, T.LongType):
        # A count that went through a float column reads 3.0.
        return text.try_cast("double").cast("long").alias(name)
    return text.try_cast(kind).alias(name)


def _read(spark: SparkSession, path: str, schema: T.StructType, index_column: bool, extra: tuple[str, ...] = ()) -> DataFrame:
    names = [*(["_idx"] if index_column else []), *schema.fieldNames(), *extra]
    text = T.StructType([T.StructField(name, T.StringType()) for name in names])
    # Bodies hold line breaks, so a file is one split: keep large collections in many files.
    # A blank cell is null, an empty text in quotes stays one: reading takes this mark for null, and blanks for the mark.
    rows = spark.read.schema(text).options(**CSV_OPTIONS).option("multiLine", True).option("nullValue", NULL_MARK).csv(path)
    return rows.select(*(_typed(f.name, f.dataType) for f in schema), *(F.col(name) for name in extra))


def read_posts(spark: SparkSession, path: str, index_column: bool = True) -> DataFrame:
    """Stored posts, with ``created_at`` restored from ``date``.

    ``index_column`` says whether the file starts with a column of row numbers, as files
    written by data frame tools do; ours have none.
    """
    return with_created_at(_read(spark, path, POSTS, index_column))


def read_description(spark: SparkSession, path: str, columns: list[str] | None = None, index_column: bool = True) -> DataFrame:
    """The stored description; ``columns`` names those the file holds, by default all of them.

    A row without ``part``, which older files do not hold, is part 0.
    """
    fields = [f for f in DESCRIPTION if columns is None or f.name in columns]
    desc = _read(spark, path, T.StructType(fields), index_column)
    return desc.fillna(0, ["part"]) if "part" in desc.columns else desc


def read_comments(spark: SparkSession, path: str, index_column: bool = True) -> DataFrame:
    return _read(spark, path, COMMENTS, index_column)


def with_created_at(posts: DataFrame) -> DataFrame:
    """``posts`` with ``created_at``, taking ``date`` as UTC whatever the session time zone."""
    return posts.withColumn("created_at", F.to_timestamp(F.concat("date", F.lit(" UTC")), "yyyy-MM-dd HH:mm:ss VV"))


def _flat(df: DataFrame) -> DataFrame:
    """CSV holds no lists and maps, so these are written as JSON."""
    nested = {f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))}
    return df.select(*(F.to_json(name).alias(name) if name in nested else F.col(name) for name in df.columns))


def write_csv(df: DataFrame, path: str) -> None:
    """``df`` as a folder of CSV files; an existing folder is never overwritten."""
    _flat(df).write.mode("errorifexists").options(**CSV_OPTIONS).csv(path)


def write_tables(
    folder: str,
    title: str,
    now: datetime,
    fmt: str = "parquet",
    posts: DataFrame | None = None,
    description: DataFrame | None = None,
    comments: DataFrame | None = None,
) -> dict[str, str]:
    """Save a collection as ``{title}_{table}_{time}`` below ``folder``; gives the paths."""
    paths = {}
    for name, df in (("posts", posts), ("description", description), ("comments", comments)):
        if df is None:
            continue
        paths[name] = f"{folder}/{title}_{NAMES[name]}_{run_stamp(now)}"
        if fmt == "csv":
            stored = {"posts": POSTS, "comments": COMMENTS}.get(name)
            write_csv(df.select(*stored.fieldNames()) if stored else df, paths[name] + ".csv")
            paths[name] += ".csv"
        else:
            df.write.mode("errorifexists").format(fmt).save(paths[name])
    return paths
