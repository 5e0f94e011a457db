"""Running totals over one order, without one task that sees a whole group.

Rows are dealt to tasks by ranges of the order, totals of the ranges are added up, and every row adds what came
before it in its own range. The ranges come from a sample of the rows, so a group of any share of all rows is cut into
as many ranges as its size asks for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmine.session import written

_EARLIER = (Window.unboundedPreceding, -1)


def in_ranges(df: DataFrame, order: Sequence[Column], ranges: int | None = None) -> DataFrame:
    """``df`` with ``_range``, which ascends with ``order``: written once, so that every reader sees the same cuts.

    ``ranges`` is their number, by default that of the session's shuffle partitions.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def total_before(
    df: DataFrame, order: Sequence[Column], value: Column | None = None, by: Sequence[str] = (), name: str = "before", ranges: int | None = None
) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` (rows, if none is given) over all earlier rows of the group ``by``.

    ``order`` must tell any two rows of a group apart for a stated result; equal ones come in any order. The first row
    of a group has 0.
    """
    value = F.lit(1) if value is None else value
    cut = in_ranges(df.withColumn("_value", value.cast("long")), [*map(F.col, by), *order], ranges)
    # A row per group and range: as many as groups, and one more for each cut.
    sums = cut.groupBy(*by, "_range").agg(F.sum("_value").alias("_sum"))
    over = Window.partitionBy(*by).orderBy("_range").rowsBetween(*_EARLIER)
    known = sums.select(*by, "_range", F.sum("_sum").over(over).alias("_sums"))
    if not by:
        # One row per range, which the writers made: as many as tasks.
        known = known.hint("broadcast")
    within = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(*_EARLIER)
    inside = cut.withColumn("_inside", F.sum("_value").over(within))
    joined = inside.alias("a").join(
        known.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "_range")], "left"
    )
    total = F.coalesce("b._sums", F.lit(0)) + F.coalesce("a._inside", F.lit(0))
    return joined.select(*(F.col(f"a.`{c}`") for c in df.columns), total.cast("long").alias(name))
