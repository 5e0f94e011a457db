"""Best-fit packing of token pieces into sequences by linear grouping.

The plan is made from the counts of the piece lengths alone, so its size depends on the capacity and not on the
corpus; the rows are then ranked within their length and look up their place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmine.llm.pieces import byte_level_ids
from postmine.llm.rows import map_batches, settle

CAPACITY = 2048
END_ID = 0
#: Pieces of at least this share of a sequence are large; they fall into so many groups of equal cardinality.
LARGE_SHARE = 1 / 8
GROUPS = 160
#: Rows ranked by one sort; hot lengths are spread over as many sorts as they need.
RANKED_ROWS = 4096


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece: the ids of the whole text, then ``end_id``.

    Only documents longer than ``capacity`` are cut, into full pieces; the first one takes the rest. A null or
    empty text is one piece with the end id alone. Repeated rows are packed as often as they come.
    """

    def each(batch: pa.RecordBatch) -> dict:
        end = np.array([end_id], "<u4").tobytes()
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), byte_level_ids(path, batch.column("text"))):
            ids += end
            n = len(ids) // 4
            starts = [0, *range(n % capacity or capacity, n, capacity)]
            for piece, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                for k, v in zip(out, (doc_id, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b]))):
                    out[k].append(v)
        return out

    return map_batches(docs.select("doc_id", "text"), each, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Plan:
    """Places: pieces of ``length`` with ranks from ``rank`` on, ``count`` of them, go to sequences from ``sequence`` on,
    ``per`` to each, the first at ``offset``."""

    capacity: int
    rows: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def put(self, length: int, rank: int, count: int, sequence: int, per: int, offset: int) -> None:
        if count:
            self.rows.append((length, rank, count, sequence, per, offset))


def best_configuration(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How many of each size fill ``capacity`` best, the largest size that is left being one of them."""
    first = next(i for i in range(len(sizes)) if left[i])
    use = [0] * len(sizes)
    use[first] = 1
    room = capacity - sizes[first]
    some = [i for i in range(first, len(sizes)) if left[i] > use[i] and sizes[i] <= room]
    # reach[j]: the sums that j further pieces make.
    reach = [np.zeros(room + 1, bool)]
    reach[0][0] = True
    while some and len(reach) <= capacity * LARGE_SHARE:
        now = np.zeros(room + 1, bool)
        for i in some:
            now[sizes[i] :] |= reach[-1][: room + 1 - sizes[i]]
        if not now.any():
            break
        reach.append(now)
    sums = sorted(((int(np.flatnonzero(r)[-1]), -j) for j, r in enumerate(reach)), reverse=True)
    for total, j in sums:
        chosen, at, used = [], total, dict.fromkeys(some, 0)
        for k in range(-j, 0, -1):
            fits = [i for i in some if sizes[i] <= at and reach[k - 1][at - sizes[i]] and left[i] - use[i] > used[i]]
            if not fits:
                break
            i = max(fits, key=lambda i: (left[i] - use[i] - used[i], -i))
            used[i] += 1
            chosen.append(i)
            at -= sizes[i]
        else:
            for i in chosen:
                use[i] += 1
            break
    return use


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> Plan:
    """Places for ``counts[length]`` pieces of each length, ranked from 0 within their length.

    Large lengths are rounded up to the longest of their group, configurations of the few rounded sizes are filled
    as often as pieces last, the actual pieces take their slots, and small ones follow by best fit, longest first.
    """
    plan = Plan(capacity)
    lengths = sorted((x for x in counts if counts[x]), reverse=True)
    bound = capacity * LARGE_SHARE
    large, small = [x for x in lengths if x > bound], [x for x in lengths if x <= bound]
    n = sum(counts[x] for x in large)
    groups = max(1, min(groups, n))
    # Ranks over all large pieces, longest first: each length has a stretch, and each group has one.
    begins = np.cumsum([0, *(counts[x] for x in large)]).tolist()
    edges = [n * g // groups for g in range(groups + 1)]
    rounded = [large[int(np.searchsorted(begins, edges[g], side="right")) - 1] for g in range(groups)] if n else []
    cursor, left = edges[:-1], [b - a for a, b in zip(edges, edges[1:])]
    bins: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []

    def keep(first: int, count: int, room: int) -> None:
        if count and room:
            if room not in bins:
                bins[room] = []
                insort(rooms, room)
            bins[room].append((first, count))

    while n and any(left):
        use = best_configuration(rounded, left, capacity)
        times = min(left[i] // u for i, u in enumerate(use) if u)
        slots = []
        for i, u in enumerate(use):
            for _ in range(u):
                slots.append(cursor[i])
                cursor[i] += times
                left[i] -= times
        # Cut the run of sequences wherever a slot comes to another actual length.
        cuts = sorted({0, times, *(b - s for s in slots for b in begins if 0 < b - s < times)})
        first = plan.open(times)
        for a, b in zip(cuts, cuts[1:]):
            offset = 0
            for s in slots:
                at = int(np.searchsorted(begins, s + a, side="right")) - 1
                plan.put(large[at], s + a - begins[at], b - a, first + a, 1, offset)
                offset += large[at]
            keep(first + a, b - a, capacity - offset)
    for size in small:
        rank, todo = 0, counts[size]
        while todo:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                keep(plan.open(m := -(-todo // (capacity // size))), m, capacity)
                continue
            room = rooms[at]
            first, m = bins[room].pop()
            if not bins[room]:
                del bins[room], rooms[at]
            per = room // size
            full = min(m, todo // per)
            plan.put(size, rank, full * per, first, per, capacity - room)
            keep(first, full, room - per * size)
            rank, todo = rank + full * per, todo - full * per
            rest = todo if full < m else 0
            if rest:
                plan.put(size, rank, rest, first + full, rest, capacity - room)
                keep(first + full, 1, room - rest * size)
                rank, todo = rank + rest, 0
            keep(first + full + bool(rest), m - full - bool(rest), room)
    return plan


def ranked(rows: DataFrame, n_rows: int) -> DataFrame:
    """Adds ``rank``, from 0 within the rows of one length, without a sort of all of them in one task."""
    parts = 1 + n_rows // RANKED_ROWS
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(parts)).cast("int"))
    sizes = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = sizes.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    return (
        rows.withColumn("at", F.row_number().over(within) - 1)
        .join(before, ["length", "part"])
        .withColumn("rank", F.col("before") + F.col("at"))
        .drop("part", "at", "before")
    )


def best_fit(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with doc_id, piece, start, length (1 to capacity) and ids_crc32.

    ``pieces`` is read twice and should be settled. No rows give no rows.
    """
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_packing(counts, capacity)
    places = np.array(sorted(plan.rows) or [(0, 0, 0, 0, 1, 0)], np.int64)
    # 44 bits of rank under the length.
    keys = (places[:, 0] << 44) + places[:, 1]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def each(batch: pa.RecordBatch) -> dict:
        length, rank = (np.asarray(batch.column(x)).astype(np.int64) for x in ("length", "rank"))
        row = places[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
        at = rank - row[:, 1]
        return {name: batch.column(name) for name in names} | {
            "sequence_id": pa.array(row[:, 3] + at // row[:, 4]),
            "offset": pa.array(row[:, 5] + at % row[:, 4] * length),
        }

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return map_batches(ranked(pieces.select(*names), sum(counts.values())), each, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """All documents as pieces in sequences of at most ``capacity`` tokens. Nulls in doc_id stay null."""
    return best_fit(settle(pieces_of(docs, path, capacity), "pieces"), capacity)
