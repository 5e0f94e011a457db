"""Best rows per group, and report orders."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from postmine.operators.sizes import fits

# Fixed values.
GROUP_LIMIT = 1000
ORDERS = {"new": "created_at", "top": "score", "comments": "n_comments"}

SPREAD = 256
#: What a winner of a ranking takes when broadcast, at most: its group, id and checksum.
WINNER_BYTES = 1000


def _ranked(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= k).drop("_rank")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key.

    Each map task keeps one row per key before the shuffle, so a key with very
    many copies sends at most one row per task.
    """
    return _ranked(df, keys, order, 1)


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: int, spread_by: str, spread: int = SPREAD
) -> DataFrame:
    """The first ``k`` rows of every group; ``order`` must be a total order.

    Every group is first cut into ``spread`` parts by hash, so that a group holding a large
    share of all rows is ranked by many tasks; the second ranking sees ``k * spread`` rows.
    """
    part = F.pmod(F.xxhash64(spread_by), F.lit(spread))
    parts = _ranked(df.withColumn("_part", part), [*keys, "_part"], order, k).drop("_part")
    return _ranked(parts, keys, order, k)


def post_order(order: str = "new") -> list[Column]:
    """Sort keys of a result order, ties broken by post id."""
    if order not in ORDERS:
        raise ValueError(f"order must be one of {sorted(ORDERS)}")
    return [F.desc(ORDERS[order]), F.asc("post_id")]


def row_sum(posts: DataFrame, without: Sequence[str] = ()) -> Column:
    """A checksum of the plain columns of a row but those named: it stands for title and body where rows are ranked.

    Lists and maps, such as links, are made of the others and would have to be made for every row.
    """
    nested = (ArrayType, MapType, StructType)
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in posts.schema if f.name not in without and not isinstance(f.dataType, nested)))


def unique_posts(posts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per post id in every group of ``keys``, so that repeated rows do not use up a limit.

    The newest row counts, of equally new ones that with the least `row_sum`.
    """
    marked = posts.withColumn("_sum", row_sum(posts, keys))
    return first_per_key(marked, [*keys, "post_id"], [F.desc("created_at"), F.asc("_sum")]).drop("_sum")


def newest_per_group(posts: DataFrame, keys: list[str], lim: int | None = GROUP_LIMIT, order: str = "new") -> DataFrame:
    """The ``lim`` newest (or top) posts of every group of ``keys``; all of them without a limit."""
    if lim is None:
        return posts
    return top_per_group(posts, keys, post_order(order), lim, spread_by="post_id")


def newest_unique(
    posts: DataFrame, found_in: Callable[[DataFrame], DataFrame], keys: list[str], lim: int | None = GROUP_LIMIT, order: str = "new",
    n_groups: int | None = None, again: bool = True,
) -> DataFrame:
    """The ``lim`` newest (or top) posts of every group of ``keys``, one row per post id.

    ``found_in`` gives the rows of ``posts`` with their groups, all columns kept. Rows are ranked by key, time, score and
    checksum alone; title, body and the rest are fetched for the winners: from ``found_in``, if that costs no more than a
    scan, or with ``again`` false from all posts. ``n_groups``, if known, bounds the winners, which are then broadcast.
    """
    if lim is None:
        return unique_posts(found_in(posts), keys)
    if order not in ORDERS:
        raise ValueError(f"order must be one of {sorted(ORDERS)}")
    marked = posts.withColumn("_sum", row_sum(posts, keys))
    found = found_in(marked)
    narrow = found.select(*keys, "post_id", "created_at", *sorted({ORDERS[order]} - {"created_at"}), "_sum")
    unique = first_per_key(narrow, [*keys, "post_id"], [F.desc("created_at"), F.asc("_sum")])
    winners = newest_per_group(unique, keys, lim, order).select(*keys, F.col("post_id").alias("_id"), F.col("_sum").alias("_total"))
    if n_groups is not None and fits(n_groups * lim, n_groups * lim * WINNER_BYTES):
        winners = F.broadcast(winners)
    rest = found_in(posts) if again else posts.drop(*keys)
    winners = winners.select(*(F.col(k).alias(f"_key_{k}") for k in keys), "_id", "_total")
    same = rest["post_id"].eqNullSafe(F.col("_id"))
    for k in keys if again else ():
        same &= rest[k].eqNullSafe(F.col(f"_key_{k}"))
    # Only rows that have the id of a winner are given a checksum.
    whole = rest.join(winners, same & (row_sum(posts, keys).bitwiseXOR(F.col("_total")) == 0))
    whole = whole.drop(*keys).withColumnsRenamed({f"_key_{k}": k for k in keys})
    # Rows that are equal in everything are one post.
    return whole.dropDuplicates([*keys, "post_id"]).select(*(c for c in found.columns if c != "_sum"))


def past_year(posts: DataFrame, as_of: datetime | str) -> DataFrame:
    """Posts of the year up to ``as_of``, which is taken as UTC if it names no zone."""
    end = datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    end = end if end.tzinfo else end.replace(tzinfo=timezone.utc)
    leap = end.month == 2 and end.day == 29
    start = end.replace(year=end.year - 1, day=28 if leap else end.day)
    return posts.filter(F.col("created_at").between(F.lit(start), F.lit(end)))


def top_of_year(posts: DataFrame, as_of: datetime | str) -> DataFrame:
    """All posts of the past year, highest score first."""
    return past_year(posts, as_of).orderBy(*post_order("top"))


def preview(df: DataFrame, order: list[Column], n: int = 5) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return df.orderBy(*order).limit(n)
