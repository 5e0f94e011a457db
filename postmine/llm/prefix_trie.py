"""The trie of conversation prefixes by truncation peeling.

A prefix is known by the exclusive or of one checksum per turn, seeded by the place of the turn, so that stripping the
last turn of a prefix is one exclusive or as well and no row carries a text or a path. `_peel` descends from the
greatest depth: conversations that end at a depth are merged with the nodes that survived from below, nodes are given
out, and each is stripped of its last turn and regrouped with its siblings. It does so for blocks of rows of any size,
also where a conversation is longer than a block: what is left of it goes on in the next block. The nodes of all
blocks are merged by their key, so a prefix that a third of all conversations share is merged where it is found.

The first peel finds nodes, members and least members. Sums over subtrees count every node once, wherever its
members are, so a second peel takes them along the path of each node's least member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmine.llm.rows import settle

KEY = ["depth", "key1", "key2"]
#: Turns taken from another conversation, and how many conversations share such a beginning.
BORROWED, FAMILY = 4, 20
#: Children of one node are dealt to so many groups, ids that end at one node to groups of so many ids.
CHILD_GROUPS, END_BITS = 64, 12
WORDS = r"[^\x20\x09-\x0D]+"


def turns(conversations: DataFrame) -> DataFrame:
    """Rows ``(conv_id, place, digest, words)``: the turns of each conversation, counted from 1.

    Turns go by number, nulls first; those of one number by a checksum of role and text. Null role or text is empty.
    Rows without a conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("place"), "digest", "words")


def rebuild(said: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns ``(conv_id, depth, digest, words)`` of every conversation with a borrowed beginning, and its length.

    Conversation c takes the first h turns of c - c % 20 (fewer if that has fewer), h = crc32(c) % 4, and then its own
    after the first h.
    """
    sizes = said.groupBy("conv_id").agg(F.max("place").alias("size"))
    heads = sizes.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED
    known = sizes.select("*", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")).join(heads, "base", "left")
    lengths = settle(
        known.select(
            "conv_id", "base", "h", F.least("h", F.coalesce("base_size", F.lit(0))).alias("taken"),
            F.greatest(F.col("size") - F.col("h"), F.lit(0)).alias("own"),
        ).withColumn("length", F.col("taken") + F.col("own")),
        "trie-lengths",
    )
    first = said.filter((F.col("place") < BORROWED) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    borrowed = lengths.filter("taken > 0").select("conv_id", "base", "taken").join(first, "base").filter("place <= taken")
    own = said.join(lengths.filter("own > 0").select("conv_id", "h", "taken"), "conv_id").filter("place > h")
    rows = borrowed.select("conv_id", F.col("place").alias("depth"), "digest", "words").union(
        own.select("conv_id", F.col("place") - F.col("h") + F.col("taken"), "digest", "words")
    )
    return rows, lengths.select("conv_id", "length")


def paths(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """Rows ``(conv_id, depth, key1, key2, up1, up2, words, ended)``: the prefixes of every conversation and what is above them.

    The root is not listed, but for conversations without a turn.
    """
    way = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for i in (1, 2):
        rows = rows.withColumn(f"turn{i}", F.xxhash64(F.lit(i), "digest", "depth"))
    keyed = rows.select("conv_id", "depth", "words", "turn1", "turn2", *(F.bit_xor(f"turn{i}").over(way).alias(f"key{i}") for i in (1, 2)))
    up = (F.col(f"key{i}").bitwiseXOR(F.col(f"turn{i}")).alias(f"up{i}") for i in (1, 2))
    below = keyed.select("conv_id", *KEY, *up, "words").join(lengths, "conv_id")
    zero = F.lit(0).cast("long")
    bare = lengths.filter("length = 0").select("conv_id", *(zero.alias(c) for c in (*KEY, "up1", "up2", "words")), F.lit(1).cast("long").alias("ended"))
    return below.select("conv_id", *KEY, "up1", "up2", "words", (F.col("depth") == F.col("length")).cast("long").alias("ended")).union(bare)


def _numbered(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of ``columns``, in order: the number of each row's, and the first row of each."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def peel_block(rows: dict[str, np.ndarray], sums: list[str]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The nodes of a block of rows with their sums and least conv_id, and what must go on in the next block.

    ``rows`` holds KEY, up1, up2, words, conv_id, known (1, or 0 for what came from the block before, whose upper end is
    not known yet) and ``sums``. A node that lies above the rows is no node of this block; the root is.
    """
    n = len(rows["depth"])
    above = [rows["depth"] - 1, rows["up1"], rows["up2"]]
    has_above = (rows["depth"] > 0) & (rows["known"] == 1)
    keys = [np.concatenate([rows[k], a[has_above]]) for k, a in zip(KEY, above)]
    number, first = _numbered(keys)
    depth = keys[0][first]
    # Of a node's rows, one whose upper end is known speaks for it.
    speaker = np.full(len(first), -1)
    speaker[number[:n][rows["known"] == 0]] = -2
    speaker[number[:n][rows["known"] == 1]] = np.flatnonzero(rows["known"] == 1)
    up = np.full(len(first), -1)
    up[number[:n][has_above]] = number[n:]
    totals = {s: np.zeros(len(first), np.int64) for s in sums}
    least = np.full(len(first), np.iinfo(np.int64).max)
    for s in sums:
        np.add.at(totals[s], number[:n], rows[s])
    np.minimum.at(least, number[:n], rows["conv_id"])
    # Nodes are in order of depth: from the greatest on, merge with what came up, strip the last turn, regroup.
    starts = np.searchsorted(depth, np.arange(depth.max() + 2)) if len(depth) else [0]
    for d in range(len(starts) - 2, 0, -1):
        here = np.arange(starts[d], starts[d + 1])
        here = here[up[here] >= 0]
        for s in sums:
            np.add.at(totals[s], up[here], totals[s][here])
        np.minimum.at(least, up[here], least[here])
    out = {k: c[first] for k, c in zip(KEY, keys)} | totals | {"conv_id": least}
    at = np.maximum(speaker, 0)
    for c in ("up1", "up2", "words"):
        out[c] = np.where(speaker >= 0, rows[c][at] if n else 0, 0)
    whole = (speaker >= 0) | (depth == 0)
    left = {k: v[~whole] for k, v in out.items()}
    return {k: v[whole] for k, v in out.items()}, left | {"known": np.zeros(int((~whole).sum()), np.int64)}


def _peel(rows: DataFrame, sums: list[str]) -> DataFrame:
    """Nodes ``(depth, key1, key2, up1, up2, words, conv_id, *sums)``, each as often as blocks hold it.

    ``rows`` hold all prefixes of their conversations, so that a block lacks only what the next one brings.
    """
    names = ["conv_id", *KEY, "up1", "up2", "words", *sums]
    whole = rows.select(*names).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("depth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: dict[str, np.ndarray] | None = None
        for batch in batches:
            block = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            block["known"] = np.ones(batch.num_rows, np.int64)
            if left is not None:
                block = {c: np.concatenate([left[c], block[c]]) for c in block}
            nodes, left = peel_block(block, sums)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[c], pa.int64()) for c in names], names)

    return whole.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def end_hashes(ends: DataFrame) -> DataFrame:
    """``ends_sha256`` per KEY from rows ``(KEY, conv_id)``: SHA-256 of the ids in order, joined by commas.

    Ids are joined in groups of neighbours first; the groups of a node then pass one after another, never all at once.
    """
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    groups = ends.withColumn("part", F.shiftright("conv_id", END_BITS)).groupBy(*KEY, "part").agg(joined.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * 4
            done.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], [*KEY, "ends_sha256"])

        for batch in batches:
            for *at, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
                if at == key:
                    state.update(b"," + ids.encode())
                else:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = at, hashlib.sha256(ids.encode())
            yield flush()
        if key is not None:
            done.append((*key, state.hexdigest()))
        yield flush()

    return groups.repartition(*KEY).sortWithinPartitions(*KEY, "part").select(*KEY, "ids").mapInArrow(
        run, "depth long, key1 long, key2 long, ends_sha256 string"
    )


def _child_group() -> Column:
    return F.pmod(F.col("key1"), F.lit(CHILD_GROUPS)).alias("child_group")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations; see `turns` and `rebuild` for what they hold.

    Columns: conv_id (least member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Repeated rows are turns of their own. A conversation without turns left is a member of the
    root. An empty table has no nodes, not even a root. Other columns are not read, whatever their names.
    """
    said = settle(turns(conversations), "trie-turns")
    way = settle(paths(*rebuild(said)), "trie-paths")
    found = _peel(way, ["ended"]).groupBy(*KEY)
    nodes = settle(
        found.agg(*(F.max(c).alias(c) for c in ("up1", "up2", "words")), F.min("conv_id").alias("conv_id"), F.sum("ended").alias("n_convs")),
        "trie-nodes",
    )
    # Children of one node are counted in groups, so a node with most of the children is no single group to join.
    above = [(F.col("depth") - 1).alias("depth"), F.col("up1").alias("key1"), F.col("up2").alias("key2")]
    children = nodes.filter("depth > 0").select(*above, _child_group()).groupBy(*KEY, "child_group").agg(F.count("*").alias("n_children"))
    children = settle(children, "trie-children")
    per_node = children.groupBy(*KEY).agg(F.sum("n_children").alias("n_children"))
    nodes = settle(nodes.join(per_node, KEY, "left").fillna(0, ["n_children"]), "trie-known")

    own = nodes.select(
        "conv_id", *KEY, "up1", "up2", "words", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    nothing = F.lit(0).cast("long")
    steps = way.select("conv_id", *KEY, "up1", "up2", "words", nothing.alias("n_leaves"), nothing.alias("saved_tokens")).filter("depth > 0")
    below = _peel(own.union(steps), ["n_leaves", "saved_tokens"]).groupBy(*KEY).agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
    )
    ends = end_hashes(way.filter("ended = 1").select(*KEY, "conv_id"))
    parents = children.select(*KEY, "child_group").join(nodes.select(*KEY, F.col("conv_id").alias("parent_conv_id")), KEY).select(
        (F.col("depth") + 1).alias("depth"), F.col("key1").alias("up1"), F.col("key2").alias("up2"), "child_group", "parent_conv_id"
    )
    of_parent = nodes.filter("depth > 0").select(*KEY, "up1", "up2", _child_group()).join(parents, ["depth", "up1", "up2", "child_group"])
    whole = nodes.join(below, KEY).join(ends, KEY, "left").join(of_parent.select(*KEY, "parent_conv_id"), KEY, "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )
