"""Broadcasting of measured tables, and joins that spread hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 << 20
#: A joined table too large to broadcast is laid out so many times, and hot keys of the other side are dealt over the copies.
COPIES = 16


def fits(rows: int, size: int) -> bool:
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def broadcast_if_small(words: DataFrame) -> DataFrame:
    """A table of strings, marked for broadcast if its measured size allows it.

    Larger tables come back unmarked and are joined by shuffle, hot keys being split at run time.
    """
    size = sum(F.coalesce(F.octet_length(name), F.lit(0)) for name in words.columns)
    found = words.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("size")).first()
    return F.broadcast(words) if fits(found.n, found.size) else words


def spread_join(big: DataFrame, small: DataFrame, key: str, deal: str, is_small: bool, on: Column | None = None) -> DataFrame:
    """Inner join on ``key``, of which ``big`` may hold any number of rows.

    ``small`` is broadcast if ``is_small``, as measured by the caller, else laid out `COPIES` times. Rows of ``big`` go to
    the copy that their column ``deal`` names, the same one in every attempt. ``on`` is a further condition.
    """
    if is_small:
        joined = big.join(F.broadcast(small), key)
    else:
        dealt = big.withColumn("_copy", F.pmod(F.xxhash64(deal), F.lit(COPIES)).cast("int"))
        copies = small.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
        joined = dealt.join(copies, [key, "_copy"]).drop("_copy")
    return joined if on is None else joined.filter(on)
