"""What each filter of a chain removes, in every order the filters can take: min-plus removal ranks.

A document is a row of the mask matrix: 0 under a filter that it fails, infinity under one that it passes. An order is
a column of the position matrix, the inverse of its permutation: at which step each filter stands. Their min-plus
product is the step at which the document goes. As the product depends on the mask alone, Spark counts documents per
(part, mask, labels) and the product is taken over masks, weighted by these counts: the number of orders never meets
the number of documents.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmine.llm.rows import map_batches, settle

FILTERS = "ABCDE"
#: Bits of the mask, by filter.
SHORT, REPETITIVE, UPPER, SYMBOLS, COPY = (1 << i for i in range(5))
LEAST_WORDS = 200
SYMBOL_BYTES = b"#$%&*|"
NEVER = 99
#: Parts whose rows are made in one go: 600 rows each.
PARTS_AT_ONCE = 200

_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(SYMBOL_BYTES)] = 1
#: All bytes but those that continue a code point.
_FIRST = np.ones(256, np.int64)
_FIRST[128:192] = 0


def text_mask(data: bytes) -> int:
    """The filters that a text in UTF-8 fails by itself: all but that for copies."""
    # Splitting bytes parts them at the blanks of the word pattern, and at nothing else.
    words = data.split()
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    mask = SHORT * (len(words) < LEAST_WORDS)
    mask |= REPETITIVE * (100 * len(set(words)) < 50 * len(words))
    mask |= UPPER * bool(100 * (seen @ _UPPER) > 2 * (seen @ _FIRST))
    return mask | SYMBOLS * bool(seen @ _SYMBOL)


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows ``(part, mask, good, toxic, n)``: how many documents of a part fail just the filters of ``mask``.

    A null source is the part ``''``, a null text is empty. A document counts as good or toxic if any label row of its
    id says so; one without a label is neither. Repeated rows count each. A text is a copy if a smaller id holds the
    same text anywhere in the table (SHA-256 of its bytes); rows of one id are no copies of each other, and a null
    id is neither a copy nor copied.
    """
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))

    def each(batch: pa.RecordBatch) -> dict:
        texts = (t.as_buffer().to_pybytes() for t in batch.column("text").cast(pa.binary()))
        found = [(text_mask(t), hashlib.sha256(t).digest()) for t in texts]
        return {"doc_id": batch.column("doc_id"), "part": batch.column("part"), "mask": [m for m, _ in found], "digest": [d for _, d in found]}

    schema = "doc_id long, part string, mask int, digest binary"
    # Told apart before the texts are read, so that each is read once.
    with_id, without = (map_batches(rows.filter(f"doc_id IS {x} NULL"), each, schema) for x in ("NOT", ""))
    flags = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    # Repeated rows are counted before anything is joined, and rows without an id need neither join.
    counted = with_id.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    named = settle(counted.join(flags, "doc_id", "left").fillna(False, ["good", "toxic"]), "filter-masks")
    nameless = without.groupBy("part", "mask").agg(F.count("*").alias("n"))
    # A text has one first id, so that id and text together are no hot key, however many copies there are.
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    known = named.join(first, ["digest", "doc_id"], "left")
    mask = F.col("mask") + F.when(F.col("is_first"), F.lit(0)).otherwise(F.lit(COPY))
    both = known.select("part", mask.alias("mask"), "good", "toxic", "n").union(
        nameless.select("part", "mask", F.lit(False), F.lit(False), "n")
    )
    return both.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def orders(names: str) -> list[str]:
    return ["".join(p) for p in itertools.permutations(names)]


def removal_ranks(masks: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The min-plus product: at ``[mask, order]`` the step that removes the document, ``NEVER`` if none does."""
    return np.minimum((masks[:, None, :] + positions[None, :, :]).min(-1), NEVER)


def audit(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """One row per part, order and step, zeros included, from rows ``(part, mask, good, toxic, n)`` of `document_masks`.

    A part without documents has no rows. Bit ``i`` of a mask stands for letter ``i`` of ``names``.
    """
    size, listed = len(names), orders(names)
    n_masks = 1 << size
    fails = (np.arange(n_masks)[:, None] >> np.arange(size)) & 1
    # place[order, step] is the filter at a step, positions[order, filter] its inverse.
    place = np.array([[names.index(c) for c in order] for order in listed])
    positions = np.argsort(place, axis=1)
    rank = removal_ranks(np.where(fails == 1, 0, NEVER), positions)
    removed_at = rank[:, :, None] == np.arange(size)
    fails_at = fails[:, place] == 1
    alone_at = fails_at & (fails.sum(1) == 1)[:, None, None]
    removed, redundant, alone = (x.reshape(n_masks, -1).astype(np.int64) for x in (removed_at, fails_at & ~removed_at, alone_at))

    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))

    def each(batch: pa.RecordBatch) -> dict:
        # A part has at most one cell per mask and pair of labels.
        weights = np.zeros((batch.num_rows, 3, n_masks), np.int64)
        for row, listing in enumerate(batch.column("cells").to_pylist()):
            for cell in listing:
                weights[row, 0, cell["mask"]] += cell["n"]
                weights[row, 1, cell["mask"]] += cell["n"] * cell["good"]
                weights[row, 2, cell["mask"]] += cell["n"] * cell["toxic"]
        gone = (weights @ removed).reshape(batch.num_rows, 3, len(listed), size)
        kept = weights[:, 0].sum(-1)[:, None, None] - gone[:, 0].cumsum(-1)
        shares = np.zeros((batch.num_rows, size), np.int64)
        for letter in range(size):
            shares[:, letter] = gone[:, 0][:, place == letter].sum(-1)
        each_row = len(listed) * size
        return {
            "part": np.repeat(np.array(batch.column("part").to_pylist(), object), each_row),
            "filter_order": np.tile(np.repeat(np.array(listed, object), size), batch.num_rows),
            "step": np.tile(np.arange(1, size + 1, dtype=np.int32), batch.num_rows * len(listed)),
            "kept": kept.ravel(),
            "removed": gone[:, 0].ravel(),
            "redundant": (weights[:, 0] @ redundant).ravel(),
            "unique_fails": (weights[:, 0] @ alone).ravel(),
            "good_lost": gone[:, 1].ravel(),
            "toxic_lost": gone[:, 2].ravel(),
            "shapley": shares[:, place].ravel(),
        }

    numbers = "kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return map_batches(cells, each, f"part string, filter_order string, step int, {numbers}", at_once=PARTS_AT_ONCE)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interaction of the five filters on every part of ``docs``, under all orders; see `document_masks` and `audit`.

    Empty tables give no rows. Other columns of ``docs`` and ``labels`` are not read, whatever their names.
    """
    return audit(document_masks(docs, labels))
