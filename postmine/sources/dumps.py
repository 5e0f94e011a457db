"""Raw post and comment dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from postmine.schemas import RAW_COMMENT, RAW_POST

BAD = ("skip", "fail")
_BROKEN = "_broken"


def _read(spark: SparkSession, path: str, schema: StructType, fmt: str, bad: str, quarantine: str | None) -> DataFrame:
    if bad not in BAD:
        raise ValueError(f"bad must be one of {BAD}")
    if fmt != "json":
        return spark.read.schema(schema).format(fmt).load(path)
    lines = spark.read.text(path).filter(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    if bad == "fail":
        return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")
    marked = StructType([*schema, StructField(_BROKEN, StringType())])
    rows = lines.select("value", "file", F.from_json("value", marked, {"columnNameOfCorruptRecord": _BROKEN}).alias("row"))
    # What is no object at all gives no mark, but no row either.
    broken = F.col(f"row.{_BROKEN}").isNotNull() | F.col("row").isNull()
    if quarantine is not None:
        rows.filter(broken).select("file", "value").write.mode("append").json(quarantine)
    return rows.filter(~broken).select(*(f"row.{name}" for name in schema.fieldNames()))


def read_raw_posts(spark: SparkSession, path: str, fmt: str = "json", bad: str = "skip", quarantine: str | None = None) -> DataFrame:
    """Raw posts, one object per line, or any columnar format with the same columns.

    A line that is no object, or has a value of another type than its column, is broken: it is left out, and with
    ``quarantine`` written there with the file it came from; ``bad="fail"`` stops the job instead. Blank lines are none.
    """
    return _read(spark, path, RAW_POST, fmt, bad, quarantine)


def read_raw_comments(spark: SparkSession, path: str, fmt: str = "json", bad: str = "skip", quarantine: str | None = None) -> DataFrame:
    """Raw comments; as `read_raw_posts`."""
    return _read(spark, path, RAW_COMMENT, fmt, bad, quarantine)
