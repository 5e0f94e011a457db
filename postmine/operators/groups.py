"""Folding groups of any size into rows of a bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ENTRIES = 50_000
MAX_CHARS = 8_000_000


def with_part(df: DataFrame, key: str, item: Column, weight: Column, limit: int) -> DataFrame:
    """``df`` with ``part``: every group of ``key`` is cut so that a part weighs about ``limit``.

    The number of parts follows from the group's total; a row's part from a hash of ``item``,
    so that it does not depend on how the input is partitioned. Nothing is left out.
    """
    totals = df.groupBy(key).agg(F.ceil(F.sum(weight) / F.lit(limit)).alias("_parts"))
    parts = F.greatest(F.col("_parts"), F.lit(1))
    code = F.conv(F.substring(F.md5(F.encode(item, "UTF-8")), 1, 8), 16, 10).cast("long")
    return df.join(totals, key).withColumn("part", F.pmod(code, parts).cast("long")).drop("_parts")


def fold_counts(counts: DataFrame, key: str, item: str, cnt: str = "cnt", max_entries: int = MAX_ENTRIES) -> DataFrame:
    """Rows ``(key, part, counts map)`` from long-form counts.

    A group with up to ``max_entries`` items is one row, part 0; larger ones take more rows.
    """
    cut = with_part(counts, key, F.col(item), F.lit(1), max_entries)
    entries = F.collect_list(F.struct(F.col(item), F.col(cnt)))
    return cut.groupBy(key, "part").agg(F.map_from_entries(entries).alias("counts"))
