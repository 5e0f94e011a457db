"""Token shards in a grammar-compressed file format with random access.

A shard holds the ids of consecutive documents as a Re-Pair grammar: a sequence of symbols and one rule per
nonterminal. Format of a shard, little-endian: eight unsigned 64-bit numbers (documents, ids, first nonterminal, rules,
symbols, bytes per symbol, 0, 0), then doc_ids (64-bit), null marks of doc_ids (8-bit), the end of each document in
ids (64-bit), the two sides of each rule, the sequence, and the expansion length of each rule (32-bit). Symbols below
the first nonterminal are ids; rule ``k`` has the symbol first nonterminal + ``k`` and uses earlier symbols only.
Shards stand as rows in Parquet files, in ascending order of doc_id by (part, shard).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postmine.llm.pieces import word_ids
from postmine.llm.rows import map_batches, partitions, settle, shuffles

#: Ids after which a shard is closed; a document is never cut.
SHARD_IDS = 1_000_000
#: In one turn, all pairs that are at least this share as frequent as the most frequent one are replaced.
TIER = 0.005
LEAST_COUNT = 16
CELLS = 1 << 18


def _cell(pair: np.ndarray) -> np.ndarray:
    return ((pair * 40503 ^ pair >> 32) * 2654435761 >> 20) & (CELLS - 1)


def grammar(ids: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Rules (n, 2) and sequence of a Re-Pair grammar of ``ids``, all below ``first``.

    Turn by turn the most frequent pairs are replaced by nonterminals, from the left where occurrences overlap, until no
    pair occurs LEAST_COUNT times: the rule of a rarer one would save next to nothing.
    """
    sequence = ids.astype(np.int64)
    rules = np.zeros((0, 2), np.int64)
    # Every turn replaces at least one occurrence, so the sequence gets shorter until the loop ends.
    while len(sequence) > LEAST_COUNT:
        pair = (sequence[:-1] << 32) | sequence[1:]
        ordered = np.sort(pair)
        begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        count = np.diff(np.append(begin, len(ordered)))
        most = int(count.max())
        if most < LEAST_COUNT:
            break
        chosen = ordered[begin[count >= max(LEAST_COUNT, most * TIER)]]
        # Pairs are looked up by hash; of those that fall together all but one wait for a later turn.
        cells = np.zeros(CELLS, np.int32)
        cells[_cell(chosen)] = np.arange(len(chosen))
        at = cells[_cell(pair)]
        hit = np.flatnonzero(chosen[at] == pair)
        # In a run of overlapping occurrences every second one is taken.
        run = np.flatnonzero(np.append(True, hit[1:] > hit[:-1] + 1))
        within = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
        hit = hit[within % 2 == 0]
        used, symbol = np.unique(at[hit], return_inverse=True)
        sequence = sequence.copy()
        sequence[hit] = first + len(rules) + symbol
        keep = np.ones(len(sequence), bool)
        keep[hit + 1] = False
        sequence = sequence[keep]
        rules = np.concatenate([rules, np.column_stack([chosen[used] >> 32, chosen[used] & 0xFFFFFFFF])])
    return rules, sequence


@dataclass
class Shard:
    doc_ids: list[int | None]
    ends: np.ndarray
    first: int
    rules: np.ndarray
    sequence: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, doc_ids: list[int | None], documents: list[np.ndarray], first: int) -> Shard:
        rules, sequence = grammar(np.concatenate(documents), first)
        lengths = np.ones(len(rules), np.int64)
        for k, (a, b) in enumerate(rules.tolist()):
            lengths[k] = (lengths[a - first] if a >= first else 1) + (lengths[b - first] if b >= first else 1)
        return cls(doc_ids, np.cumsum([len(x) for x in documents]), first, rules, sequence, lengths)

    def to_bytes(self) -> bytes:
        kind = "<u2" if self.first + len(self.rules) <= 65536 else "<u4"
        head = np.array([len(self.doc_ids), self.ends[-1], self.first, len(self.rules), len(self.sequence), int(kind[2]), 0, 0], "<u8")
        return b"".join((
            head.tobytes(), np.array([x or 0 for x in self.doc_ids], "<i8").tobytes(), bytes(x is None for x in self.doc_ids),
            self.ends.astype("<i8").tobytes(), self.rules.astype(kind).tobytes(), self.sequence.astype(kind).tobytes(),
            self.lengths.astype("<u4").tobytes(),
        ))

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        docs, _, first, rules, symbols, width = np.frombuffer(data, "<u8", 6).tolist()
        kind, at, parts = f"<u{width}", 64, []
        for n, t in ((docs, "<i8"), (docs, "u1"), (docs, "<i8"), (2 * rules, kind), (symbols, kind), (rules, "<u4")):
            parts.append(np.frombuffer(data, t, n, at))
            at += parts[-1].nbytes
        ids = [None if null else i for i, null in zip(parts[0].tolist(), parts[1].tolist())]
        return cls(ids, parts[2], first, parts[3].reshape(-1, 2).astype(np.int64), parts[4].astype(np.int64), parts[5].astype(np.int64))

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        while len(at := np.flatnonzero(symbols >= self.first)):
            width = np.ones(len(symbols), np.int64)
            width[at] = 2
            place = np.cumsum(width) - width
            out = np.empty(int(width.sum()), np.int64)
            out[place] = symbols
            sides = self.rules[symbols[at] - self.first]
            out[place[at]], out[place[at] + 1] = sides[:, 0], sides[:, 1]
            symbols = out
        return symbols

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` to ``end``, expanding only the symbols that cover them."""
        nonterminal = self.sequence >= self.first
        length = np.ones(len(self.sequence), np.int64)
        length[nonterminal] = self.lengths[self.sequence[nonterminal] - self.first]
        stops = np.cumsum(length)
        a, b = np.searchsorted(stops, start, side="right"), np.searchsorted(stops, end, side="left") + 1
        skip = start - (int(stops[a - 1]) if a else 0)
        return self._expand(self.sequence[a:b])[skip : skip + end - start]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))

    def documents(self) -> list[np.ndarray]:
        return np.split(self._expand(self.sequence), self.ends[:-1])


def token_rows(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, packed ids of whole texts, ``end_id`` last, and a part that ascends with doc_id; a null text is empty.

    The edges of the parts come from the ids alone, so no text is read or encoded for them.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = max(partitions(docs), shuffles(docs.sparkSession))
    edges = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0]
    edges = np.array(sorted(set(edges or [])), np.int64)
    kind = "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 65536 else "<u4"

    def each(batch: pa.RecordBatch) -> dict:
        end = np.array([end_id], kind).tobytes()
        ids = [np.frombuffer(x, "<u4").astype(kind).tobytes() + end for x in word_ids(path, batch.column("text"))]
        part = 1 + np.searchsorted(edges, np.asarray(batch.column("doc_id").fill_null(0)).astype(np.int64), side="left")
        part[np.asarray(batch.column("doc_id").is_null())] = 0
        return {"part": part.tolist(), "doc_id": batch.column("doc_id"), "ids": ids, "width": [int(kind[2])] * len(ids)}

    return map_batches(docs, each, "part int, doc_id long, ids binary, width int")


def write_shards(rows: DataFrame, first: int, shard_ids: int = SHARD_IDS) -> DataFrame:
    """The written table of shards: part, shard, before (ids of earlier shards of the part), n_ids and data.

    ``rows`` has part, doc_id, ids and width. Null doc_ids come first; rows of one doc_id stand in order of their ids.
    """
    tasks = max(partitions(rows), shuffles(rows.sparkSession))
    ordered = rows.repartition(tasks, "part").sortWithinPartitions("part", "doc_id", "ids")
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, before = -1, 0, 0
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            data = Shard.of(doc_ids, held, first).to_bytes()
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, shard, before, size, data), schema)], schema=schema)

        for batch in batches:
            for of, doc, ids, width in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids", "width"))):
                if of != part:
                    if held:
                        yield close()
                    part, shard, before, size, doc_ids, held = of, 0, 0, 0, [], []
                doc_ids.append(doc)
                held.append(np.frombuffer(ids, f"<u{width}"))
                size += len(held[-1])
                if size >= shard_ids:
                    yield close()
                    shard, before, size, doc_ids, held = shard + 1, before + size, 0, [], []
        if held:
            yield close()

    return settle(ordered.mapInArrow(run, "part int, shard int, before long, n_ids long, data binary"), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document, decoded from the shards."""
    totals = {r.part: r.n for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    starts, at = {}, 0
    for part in sorted(totals):
        starts[part], at = at, at + totals[part]

    def each(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32")}
        for part, before, data in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "data"))):
            shard = Shard.from_bytes(data)
            begin = starts[part] + before
            for doc, ids, end in zip(shard.doc_ids, shard.documents(), shard.ends.tolist()):
                for k, v in zip(out, (doc, begin + end - len(ids), len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                    out[k].append(v)
        return out

    return map_batches(shards.select("part", "before", "data"), each, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_to_shards(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Tokens of all documents in grammar-compressed shards, in ascending order of doc_id."""
    return write_shards(token_rows(docs, path, end_id), Tokenizer.from_file(path).get_vocab_size())
