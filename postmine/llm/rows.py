"""Reading tables, passing Arrow batches through Python, and cutting lineage in the shared folder."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from postmine.session import scratch_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that a lost executor costs no recomputation."""
    path = f"{scratch_dir(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    """Into how many tasks Spark would cut ``df`` now; it follows the size of the input."""
    return max(1, df.rdd.getNumPartitions())


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_slices(batches: Iterable[pa.RecordBatch], at_once: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows."""
    return (b.slice(i, at_once or b.num_rows) for b in batches for i in range(0, b.num_rows, at_once or b.num_rows or 1))


def give_back() -> None:
    """Memory that a worker's allocators keep for later goes back to the system: workers outlive their task and stage."""
    pa.default_memory_pool().release_unused()
    # Only the C library of Linux has this.
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_batches(
    df: DataFrame, each: Callable[[pa.RecordBatch], dict[str, list] | None], schema: str, at_once: int | None = None
) -> DataFrame:
    """``each`` turns a batch into columns of ``schema``; at most one batch is in memory at a time.

    ``at_once`` hands it at most so many rows, where one row in makes many out.
    """
    target = pa.schema(_arrow(df.sparkSession, schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        batch = columns = None
        for batch in in_slices(batches, at_once):
            if columns := each(batch):
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip((columns[f.name] for f in target), target)],
                    schema=target,
                )
        del batch, columns
        give_back()

    return df.mapInArrow(run, schema)


def _arrow(spark: SparkSession, schema: str) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return [pa.field(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema)]
