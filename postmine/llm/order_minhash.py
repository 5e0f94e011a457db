"""Fingerprints that follow edit distance: order MinHash.

Every k-mer of a text gets the number of its occurrence. In each bucket of a hash the least such k-mers are chosen and
kept in the order in which they stand in the text; the hash of that tuple is one place of the fingerprint. Moved text
changes tuples even where the set of k-mers stays the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmine.llm.rows import partitions, shuffles

KMER = 8
BUCKETS = 128
CHOSEN = 2

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _occurrences(kmers: np.ndarray) -> np.ndarray:
    """0 for the first occurrence of a k-mer, 1 for the second, and so on."""
    out = np.zeros(len(kmers), _U)
    ordered = np.sort(kmers)
    repeated = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(repeated):
        at = np.minimum(np.searchsorted(repeated, kmers), len(repeated) - 1)
        some = np.flatnonzero(repeated[at] == kmers)
        order = some[np.argsort(at[some], kind="stable")]
        group = at[order]
        start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        out[order] = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return out


def fingerprint(text: str | None) -> np.ndarray:
    """BUCKETS places of 16 bits; 0 where a bucket has no k-mer. Equal texts have equal fingerprints."""
    data = (text or "").encode()
    places = np.zeros(BUCKETS, np.uint16)
    if not data:
        return places
    data = data.ljust(KMER, b"\0")
    kmers = np.ndarray((len(data) - KMER + 1,), "<u8", buffer=data, strides=(1,))
    hashed = _mix(kmers * _U(0x9E3779B97F4A7C15) + _occurrences(kmers) * _U(0xC2B2AE3D27D4EB4F) + _U(1))
    # Few of a long text's hashes can be among the least of a bucket.
    share = 16 * BUCKETS / len(hashed)
    for limit in ([int(share * 2**64)] if share < 1 else []) + [None]:
        at = np.flatnonzero(hashed < _U(limit)) if limit else np.arange(len(hashed))
        bucket = (hashed[at] & _U(BUCKETS - 1)).astype(np.int64)
        if limit is None or np.bincount(bucket, minlength=BUCKETS).min() >= CHOSEN:
            break
    order = np.lexsort((hashed[at], bucket))
    at, bucket = at[order], bucket[order]
    start = np.searchsorted(bucket, np.arange(BUCKETS))
    chosen = np.flatnonzero(np.arange(len(at)) - start[bucket] < CHOSEN)
    at, bucket = at[chosen], bucket[chosen]
    order = np.lexsort((at, bucket))
    at, bucket = at[order], bucket[order]
    start = np.searchsorted(bucket, np.arange(BUCKETS))
    within = (np.arange(len(at)) - start[bucket]).astype(_U)
    tuples = np.zeros(BUCKETS, _U)
    np.add.at(tuples, bucket, _mix(hashed[at] + (within + _U(1)) * _U(0x9E3779B97F4A7C15)))
    filled = np.unique(bucket)
    places[filled] = (_mix(tuples[filled]) >> _U(48)) | _U(1)
    return places


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal places among those that either text fills; 1 for two empty texts."""
    filled = (a != 0) | (b != 0)
    return float((a == b)[filled].mean()) if filled.any() else 1.0


def edited(text: str, following: str) -> str:
    """``text`` with its last half of characters replaced by as many of the start of ``following``, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _neighbours(docs: DataFrame) -> DataFrame:
    """The rows in ascending buckets of descending doc_id, and for each bucket a copy of the first row of the next."""
    n = max(partitions(docs), shuffles(docs.sparkSession))
    ids = docs.select("doc_id")
    edges = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0]
    edges = np.array(sorted(set(edges or [])), np.int64)
    last = len(edges) + 1

    @F.pandas_udf(T.IntegerType())
    def bucket(doc_id):
        # Nulls come after all others.
        at = last - 1 - np.searchsorted(edges, doc_id.fillna(0).astype("int64"), side="left")
        return pd.Series(np.where(doc_id.isna(), last, at).astype("int32"))

    rows = docs.withColumn("bucket", bucket("doc_id"))
    # One row per bucket comes to the driver: as many as there are tasks.
    first = F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "text_hash")).alias("first")
    heads = sorted((r.bucket, r["first"].doc_id, r["first"].text_hash) for r in rows.groupBy("bucket").agg(first).collect())
    wanted = [(a[0], b[1], b[2]) for a, b in zip(heads, heads[1:] + heads[:1])]
    wanted = F.broadcast(docs.sparkSession.createDataFrame(wanted, "bucket int, wanted_id long, wanted_hash long"))
    same = F.col("doc_id").eqNullSafe(F.col("wanted_id")) & F.col("text_hash").eqNullSafe(F.col("wanted_hash"))
    copies = docs.join(wanted, same).select(*docs.columns, "bucket").dropDuplicates(["bucket"])
    rows = rows.withColumn("copy", F.lit(0)).unionByName(copies.withColumn("copy", F.lit(1)))
    return rows.repartition(n, "bucket").sortWithinPartitions(
        "bucket", "copy", F.col("doc_id").desc_nulls_last(), F.col("text_hash").desc_nulls_last()
    )


def order_fingerprints(docs: DataFrame) -> DataFrame:
    """Per row its fingerprint, that of its edited text, and the likeness to that and to the next document.

    The next document is the one with the next smaller doc_id (of equal ids, the next smaller hash of the text; null
    ids come last); after the last comes the first. Null texts are empty. Columns but doc_id and text are not read.
    """
    schema = pa.schema([
        (name, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[kind])
        for name, kind in (x.split() for x in SCHEMA.split(", "))
    ])
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for bucket, copy, doc, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "copy", "doc_id", "text"))):
                text = text or ""
                own = fingerprint(text)
                if held and held[0] == bucket:
                    _, before, before_id, before_text = held
                    new = edited(before_text, text)
                    other = fingerprint(new)
                    out.append((
                        before_id, len(before_text), hashlib.sha256(new.encode()).hexdigest(), before.astype(">u2").tobytes().hex(),
                        other.astype(">u2").tobytes().hex(), likeness(before, other), likeness(before, own),
                    ))
                held = None if copy else (bucket, own, doc, text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return _neighbours(docs).mapInArrow(run, SCHEMA)
