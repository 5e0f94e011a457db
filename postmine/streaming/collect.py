"""Collecting new dump files as they arrive, with saved progress."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from postmine.operators.normalize import normalize_posts
from postmine.schemas import RAW_POST


def append_new_posts(
    spark: SparkSession,
    dump: str,
    out: str,
    progress: str,
    link_mode: str = "strict",
    files_per_batch: int = 10_000,
) -> StreamingQuery:
    """Normalise dump files not seen before and append them to ``out``, then stop.

    A run that breaks off goes on from its last finished batch. ``progress`` is a folder of this job
    alone, on storage that all executors share: it remembers which files of ``dump`` are in ``out``.
    """
    raw = spark.readStream.schema(RAW_POST).option("maxFilesPerTrigger", files_per_batch).json(dump)
    return (
        normalize_posts(raw, link_mode)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
