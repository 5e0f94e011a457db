"""Benchmark passages in documents, by a prefix-filtered set join of word shingles. DataFrame functions only.

The records of the join are windows: all runs of ten words of the items, the whole item if it is shorter. A window is
found where all its shingles stand at their places, so its shingles are ordered by rarity in the corpus and the rarest
alone, the necessary prefix, is joined. What the prefix offers must lie within a run of known shingles that is long
enough and reaches far enough to both sides (length and positional bounds); then the words are compared.

Documents are read once. A bit per shingle of the items, small enough to travel in the plan, decides in the row which
runs of words may hold a window; only those runs are written, and shingles are counted and joined from there. Two
shingles on one bit, or a full bit field, let more runs through and change no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmine.functions.expr import let
from postmine.llm.rows import settle
from postmine.operators.sizes import fits

WINDOW_WORDS, SHINGLE_WORDS = 10, 5
#: Bits per shingle of the items, and the bounds of their number: a mebibyte in the plan at most.
BITS_PER_SHINGLE, LEAST_BITS, MOST_BITS = 16, 1 << 10, 1 << 23
#: A joined table too large to broadcast is laid out so many times, and hot keys of the other side are dealt over the copies.
COPIES = 32
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case; null has none."""
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), BETWEEN_WORDS), "")


def _shingle(hashes: Column, at: Column, length: int) -> Column:
    return F.xxhash64(*(F.get(hashes, at + i) for i in range(length)))


def _places(size: Column) -> Column:
    """0 to ``size`` - 1; none for 0 and below."""
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))


def shingles(words: Column, length: Column, lengths: list[int]) -> Column:
    """``array<struct<place, shingle>>`` of ``words``; ``length``, one of ``lengths``, is how many words make a shingle."""

    def of(hashes: Column, n: int) -> Column:
        return F.transform(_places(F.size(hashes) - (n - 1)), lambda i: F.struct(i.alias("place"), _shingle(hashes, i, n).alias("shingle")))

    def each(hashes: Column) -> Column:
        out = of(hashes, lengths[0])
        for n in lengths[1:]:
            out = F.when(length == n, of(hashes, n)).otherwise(out)
        return out

    return let(F.transform(words, lambda w: F.xxhash64(w)), each)


def item_windows(benchmark: DataFrame, size: int = WINDOW_WORDS) -> tuple[DataFrame, DataFrame]:
    """The distinct windows ``(window_id, text, words, length)`` and whose they are, ``(window_id, item)``.

    ``length`` is the number of words in a shingle of the window. Rows of one item_id are one item; an item without an
    id has windows and no name; one without words has none.
    """
    one = F.transform(_places(F.greatest(F.size("words") - (size - 1), F.lit(1))), lambda i: F.array_join(F.slice("words", i + 1, size), " "))
    named = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    owners = settle(named.select("item", F.explode(one).alias("text")).distinct(), "benchmark-owners")
    texts = owners.select("text").distinct().select(F.monotonically_increasing_id().alias("window_id"), "text", F.split("text", " ").alias("words"))
    windows = settle(texts.withColumn("length", F.least(F.size("words"), F.lit(SHINGLE_WORDS))), "benchmark-windows")
    return windows, owners.filter("item IS NOT NULL").join(windows.select("window_id", "text"), "text").select("window_id", "item")


def shingle_bits(known: DataFrame) -> tuple[Column, int]:
    """A field of bits as ``array<bigint>``, set for every ``shingle`` of ``known``, and its number of cells, which is bounded."""
    n = known.agg(F.count("*")).first()[0]
    bits = LEAST_BITS
    while bits < min(BITS_PER_SHINGLE * n, MOST_BITS):
        bits *= 2
    at = F.col("shingle").bitwiseAND(F.lit(bits - 1))
    cells = known.select(F.shiftright(at, 6).alias("cell"), F.expr("shiftleft(1L, CAST(shingle & 63 AS INT))").alias("bit"))
    field = [0] * (bits // 64)
    for row in cells.groupBy("cell").agg(F.bit_or("bit").alias("bit")).collect():
        field[row.cell] = row.bit
    return F.split(F.lit(",".join(map(str, field))), ",").cast("array<bigint>"), len(field)


def _is_set(field: Column, cells: int, shingle: Column) -> Column:
    cell = F.get(field, F.shiftright(shingle, 6).bitwiseAND(F.lit(cells - 1)).cast("int"))
    return F.getbit(cell, shingle.bitwiseAND(F.lit(63)).cast("int")) == 1


def known_runs(words: Column, hashes: Column, length: int, least: int, field: Column, cells: int) -> Column:
    """``array<struct<length, first, words>>``: the longest runs of at least ``least`` places whose shingles have their bit set."""

    def runs(at: Column) -> Column:
        starts = F.filter(at, lambda p, j: (j == 0) | (F.get(at, j - 1) != p - 1))
        ends = F.filter(at, lambda p, j: (j == F.size(at) - 1) | (F.get(at, j + 1) != p + 1))
        pairs = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        long = F.filter(pairs, lambda r: r["b"] - r["a"] + 1 >= least)
        return F.transform(
            long, lambda r: F.struct(F.lit(length).alias("length"), r["a"].alias("first"), F.slice(words, r["a"] + 1, r["b"] - r["a"] + length).alias("words"))
        )

    places = _places(F.size(hashes) - (length - 1))
    return let(F.filter(places, lambda i: _is_set(field, cells, _shingle(hashes, i, length))), runs)


def spread_join(big: DataFrame, small: DataFrame, key: str, deal: str, row_bytes: int = 200) -> DataFrame:
    """Inner join on ``key``, of which ``big`` may hold any number of rows: ``small`` is broadcast if it is small, else copied.

    Rows of ``big`` go to the copy that their column ``deal`` names, the same one in every attempt. ``small`` must be
    written: it is counted first.
    """
    rows = small.count()
    if fits(rows, rows * row_bytes):
        return big.join(F.broadcast(small), key)
    dealt = big.withColumn("__copy", F.pmod(F.xxhash64(deal), F.lit(COPIES)).cast("int"))
    copies = small.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    return dealt.join(copies, [key, "__copy"]).drop("__copy")


def rarest_shingles(windows: DataFrame, offered: DataFrame, lengths: list[int]) -> DataFrame:
    """Rows ``(shingle, window_id, offset, size, text)``: the rarest shingle of each window that has all of its shingles in the corpus.

    ``offered`` has a row for every place of a shingle. Of equally rare ones the least checksum, then the first, counts.
    """
    counts = settle(offered.groupBy("shingle").agg(F.count("*").alias("n")), "benchmark-rarity")
    parts = windows.select("window_id", F.explode(shingles(F.col("words"), F.col("length"), lengths)).alias("s")).select("window_id", "s.*")
    rank = F.struct("n", "shingle", "place")
    first = spread_join(parts, counts, "shingle", "window_id", 16).groupBy("window_id").agg(F.min(rank).alias("least"), F.count("*").alias("found"))
    whole = windows.join(first, "window_id").filter(F.col("found") == F.size("words") - F.col("length") + 1)
    return whole.select(F.col("least.shingle").alias("shingle"), "window_id", F.col("least.place").alias("offset"), F.size("words").alias("size"), "text")


def find_windows(runs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """Rows ``(row, start, size, window_id)``: every place in a document where a window stands.

    ``runs`` are rows ``(row, length, first, words)``.
    """
    offered = runs.select("row", "length", "first", "words", F.explode(shingles(F.col("words"), F.col("length"), lengths)).alias("s"))
    anchors = settle(rarest_shingles(windows, offered.select("s.shingle"), lengths), "benchmark-anchors")
    # A place brings the words that a window around it can cover, not its whole run.
    reach = F.when(F.col("length") == SHINGLE_WORDS, F.lit(WINDOW_WORDS - SHINGLE_WORDS)).otherwise(F.lit(0))
    low = F.greatest(F.col("s.place") - reach, F.lit(0))
    around = F.slice("words", low + 1, F.col("s.place") + F.col("length") + reach - low)
    places = offered.select(
        "row", F.col("s.shingle").alias("shingle"), (F.col("first") + F.col("s.place")).alias("place"), (F.col("first") + low).alias("low"), around.alias("around")
    )
    start = F.col("place") - F.col("offset")
    found = spread_join(places, anchors, "shingle", "row").withColumn("start", start)
    inside = (F.col("start") >= F.col("low")) & (F.col("start") + F.col("size") <= F.col("low") + F.size("around"))
    same = F.array_join(F.slice("around", F.greatest(F.col("start") - F.col("low"), F.lit(0)) + 1, F.col("size")), " ") == F.col("text")
    return found.filter(inside & same).select("row", "start", "size", "window_id")


def _words_hit(hits: DataFrame) -> DataFrame:
    """Rows ``(row, n_hit)``: words under any window, each counted once. A group is one document."""
    before = Window.partitionBy("row").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    covered = F.coalesce(F.max(end).over(before), F.lit(0))
    new = F.greatest(end - F.greatest("start", covered), F.lit(0))
    return hits.select("row", new.alias("new")).groupBy("row").agg(F.sum("new").alias("n_hit"))


def _items_hit(hits: DataFrame, owners: DataFrame) -> DataFrame:
    """Rows ``(row, n_items, items_sha256)``; documents with the same windows, such as copies, share one listing."""
    mine = hits.groupBy("row").agg(F.array_sort(F.collect_set("window_id")).alias("windows"))
    mine = settle(mine.withColumn("listing", F.sha2(F.array_join(F.transform("windows", lambda w: w.cast("string")), ","), 256)), "benchmark-listings")
    parts = mine.groupBy("listing").agg(F.any_value("windows").alias("windows")).select("listing", F.explode("windows").alias("window_id"))
    names = F.sort_array(F.collect_set("item"))
    listed = parts.join(owners, "window_id").groupBy("listing").agg(names.alias("items"))
    listed = settle(
        listed.select("listing", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "benchmark-listed"
    )
    return spread_join(mine.select("row", "listing"), listed, "listing", "row", 150).drop("listing")


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every document, one row per row.

    Null and empty texts have no words and no hits; repeated ids keep a row each; a null id stays null. An empty
    benchmark, or one without words, hits nothing. Items without an id mark words and are not listed. Other columns of
    both tables are not read, whatever their names.
    """
    windows, owners = item_windows(benchmark)
    shapes = windows.groupBy("length").agg(F.min(F.size("words") - F.col("length") + 1).alias("least")).collect()
    least = {r.length: r.least for r in shapes}
    lengths = sorted(least)
    texts = docs.select("doc_id", "text")
    if lengths:
        known = windows.select(F.explode(shingles(F.col("words"), F.col("length"), lengths)["shingle"]).alias("shingle")).distinct()
        field, cells = shingle_bits(known)

    def scan(words: Column) -> Column:
        def of(hashes: Column) -> Column:
            each = [known_runs(words, hashes, n, least[n], field, cells) for n in lengths]
            return F.concat(*each) if each else F.array().cast("array<struct<length:int,first:int,words:array<string>>>")

        return F.struct(F.size(words).cast("long").alias("n_words"), let(F.transform(words, lambda w: F.xxhash64(w)), of).alias("runs"))

    read = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", let(words_of(F.col("text")), scan).alias("found"))
    read = settle(read.select("row", "doc_id", "found.n_words", "found.runs", F.size("found.runs").alias("n_runs")), "benchmark-runs")
    nothing = [F.lit(0).cast("long"), F.lit(0).cast("long"), F.sha2(F.lit(b""), 256)]
    names = ["n_hit", "n_items", "items_sha256"]
    clean = read.filter("n_runs = 0").select("doc_id", "n_words", *(x.alias(c) for x, c in zip(nothing, names)))
    if lengths:
        runs = read.filter("n_runs > 0").select("row", F.explode("runs").alias("run")).select("row", "run.*")
        hits = settle(find_windows(runs, windows, lengths), "benchmark-hits")
        near = read.filter("n_runs > 0").select("row", "doc_id", "n_words")
        told = near.join(_words_hit(hits), "row", "left").join(_items_hit(hits, owners), "row", "left")
        clean = clean.union(told.select("doc_id", "n_words", *(F.coalesce(F.col(c), x) for x, c in zip(nothing, names))))
    return clean.withColumn("contaminated", F.col("n_hit") > 0)
