"""Which terms of a list occur in which texts.

Short lists travel inside the plan and are tested where the text is, without a join.
Longer ones are joined on the first characters of the term, after a test in the row that lets few places through.
Both ways give the same result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmine.functions.bits import BitField, bit_field
from postmine.functions.expr import let
from postmine.operators.sizes import fits, spread_join

INLINE_TERMS = 1000
GATE = 6
BLOCK = 64
#: Places of a text that are listed at once.
STEP = 4096


def short_list(terms: DataFrame | Sequence[str], limit: int = INLINE_TERMS) -> list[str] | None:
    """The terms in order of ``pos`` if there are at most ``limit``, else None."""
    if not isinstance(terms, DataFrame):
        listed = [term for term in terms if term is not None]
        return listed if len(listed) <= limit else None
    rows = as_rows(terms).limit(limit + 1).collect()
    return [row.term for row in sorted(rows)] if len(rows) <= limit else None


def as_rows(terms: DataFrame) -> DataFrame:
    """Distinct rows ``(pos, term)`` without null terms, which both ways start from."""
    return terms.select("pos", "term").filter("term IS NOT NULL").distinct()


def lowered(spark: SparkSession, terms: Sequence[str | None]) -> dict[str, str]:
    """Every term that is not null and its lower case as Spark has it, so that lists and tables agree on every letter."""
    known = list(dict.fromkeys(term for term in terms if term is not None))
    return dict(zip(known, spark.range(1).select(F.transform(F.lit(known), F.lower)).first()[0])) if known else {}


def as_table(df: DataFrame, terms: DataFrame | Sequence[str]) -> DataFrame:
    """``terms`` as rows ``(pos, term)``."""
    if isinstance(terms, DataFrame):
        return as_rows(terms)
    return df.sparkSession.createDataFrame([(i, term) for i, term in enumerate(terms) if term is not None], "pos int, term string")


def terms_in_text(
    df: DataFrame, text: Column, terms: DataFrame | Sequence[str], inline_limit: int = INLINE_TERMS
) -> DataFrame:
    """``df`` with ``terms``: those that occur in ``text``, in list order.

    Terms listed at several places are reported for each; a null term is none. Null text gives null.
    """
    listed = short_list(terms, inline_limit)
    if listed is not None:
        values = F.lit(listed) if listed else F.array().cast("array<string>")
        hits = let(text, lambda one: F.filter(values, lambda term: F.contains(one, term)))
        return df.withColumn("terms", F.when(text.isNotNull(), hits))
    keyed = df.withColumn("_text_key", F.sha2(text, 256))
    hits = joined_hits(keyed.select("_text_key", text.alias("_text")), as_table(df, terms))
    # One group per text, no larger than the terms found in it.
    hits = hits.groupBy("_text_key").agg(F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("_hits"))
    found = F.coalesce(F.col("_hits.term"), F.array().cast("array<string>"))
    tagged = keyed.join(hits, "_text_key", "left")
    return tagged.withColumn("terms", F.when(F.col("_text_key").isNotNull(), found)).drop("_hits", "_text_key")


def _classes(n: Column) -> Column:
    """How many first characters of a term of ``n`` characters stand for it: all below `GATE`, else the largest doubling of it."""
    doubled = F.lit(GATE) * F.pow(F.lit(2), F.floor(F.log2(n / GATE)))
    return F.when(n < GATE, n).otherwise(doubled.cast("int"))


def _anchor(size: Column, text: Column) -> Column:
    return F.xxhash64(size, text)


def offered_anchors(text: Column, sizes: list[int], longest: int, field: BitField) -> Column:
    """``array<struct<anchor, stretch>>``: the places of ``text`` where the first characters of some term stand.

    ``sizes`` are the classes of the terms, ``longest`` the length of the longest term. A text is cut into blocks, as
    finding the nth character of a text takes n steps. A place first passes the gate, its next `GATE` characters, and a second one of twice that; only then
    its longer beginnings are tested, and what a term of their class can cover is taken along.
    """
    short = [n for n in sizes if n < GATE]
    long = [n for n in sizes if n >= GATE]
    around = 1 + -(-longest // BLOCK)

    def block(blocks: Column, one: Column, j: Column) -> Column:
        def places(near: Column) -> Column:
            def tested(gates: Column) -> Column:
                def may_start(at: Column) -> Column:
                    later = [_anchor(F.lit(GATE), F.substring(near, at, F.lit(GATE)))] if GATE in sizes else []
                    later += [F.xxhash64(F.substring(near, at, F.lit(2 * GATE)))] if max(long, default=0) > GATE else []
                    passed = [field.has(F.get(gates, at - 1)) & reduce(Column.__or__, map(field.has, later))] if long else []
                    passed += [field.has(_anchor(F.lit(n), F.substring(near, at, F.lit(n)))) for n in short]
                    return reduce(Column.__or__, passed)

                return F.filter(F.sequence(F.lit(1), F.length(one)), may_start)

            return let(F.transform(F.sequence(F.lit(1), F.length(one)), lambda at: F.xxhash64(F.substring(near, at, F.lit(GATE)))), tested)

        def tried(at: Column) -> Column:
            def classes(stretch: Column) -> Column:
                def stands(n: Column) -> Column:
                    return (F.length(stretch) >= n) & field.has(_anchor(n, F.substring(stretch, F.lit(1), n)))

                return F.transform(
                    F.filter(F.array(*map(F.lit, sizes)), stands),
                    lambda n: F.struct(F.substring(stretch, F.lit(1), n).alias("anchor"), F.substring(stretch, F.lit(1), 2 * n).alias("stretch")),
                )

            return let(F.substring(F.array_join(F.slice(blocks, j + 1, F.lit(around)), ""), at, F.lit(longest)), classes)

        near = F.concat(one, F.coalesce(F.substring(F.get(blocks, j + 1), 1, 2 * GATE - 1), F.lit("")))
        return F.flatten(F.transform(let(near, places), tried))

    if not sizes:
        return F.array().cast("array<struct<anchor:string,stretch:string>>")
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return let(cut, lambda blocks: F.flatten(F.transform(blocks, lambda one, j: block(blocks, one, j))))


def gates(term: Column, size: Column) -> Column:
    """The checksums that let a place of a text pass to :func:`offered_rows` for a term of class ``size``."""
    first = [F.when(size >= n, F.xxhash64(F.substring(term.cast("binary"), 1, n))) for n in (GATE, 2 * GATE)]
    return F.array_compact(F.array(*first))


def offered_rows(texts: DataFrame, sizes: list[int], longest: int, field: BitField) -> DataFrame:
    """Rows ``(_text_key, _anchor, _stretch)`` from texts ``(_text_key, _text)``: the places where some term may start.

    ``longest`` is the number of bytes of the longest term. Places are rows of compiled code, and are bytes, which are
    found without counting characters: a place passes the first `GATE` bytes, then twice that, and only then beginnings
    in characters. A place within a character is the start of no term.
    """
    short, long = [n for n in sizes if n < GATE], [n for n in sizes if n >= GATE]
    at, rest = F.col("_at"), F.col("_rest")
    held = texts.select("_text_key", F.col("_text").cast("binary").alias("_bytes"), F.octet_length("_text").alias("_n")).filter("_n > 0")
    steps = held.select("_text_key", "_bytes", "_n", F.explode(F.sequence(F.lit(1), F.col("_n"), F.lit(STEP))).alias("_from"))
    until = F.least(F.col("_n"), F.col("_from") + (STEP - 1))
    places = steps.select("_text_key", "_bytes", F.explode(F.sequence(F.col("_from"), until)).alias("_at"))

    def begins(n: int) -> Column:
        """The first ``n`` characters, of four bytes at most."""
        return F.substring(F.substring("_bytes", at, F.lit(4 * n)).cast("string"), 1, n)

    passed = [field.has(_anchor(F.lit(n), begins(n))) for n in short]
    if long:
        later = [field.has(_anchor(F.lit(GATE), begins(GATE)))] if GATE in sizes else []
        later += [field.has(F.xxhash64(F.substring("_bytes", at, F.lit(2 * GATE))))] if max(long) > GATE else []
        passed.append(field.has(F.xxhash64(F.substring("_bytes", at, F.lit(GATE)))) & reduce(Column.__or__, later))
    offered = places.filter(reduce(Column.__or__, passed))
    tried = offered.select("_text_key", F.substring("_bytes", at, F.lit(longest)).cast("string").alias("_rest"))

    def stands(n: int) -> Column:
        known = (F.length(rest) >= n) & field.has(_anchor(F.lit(n), F.substring(rest, 1, n)))
        return F.when(known, F.struct(F.substring(rest, 1, n).alias("anchor"), F.substring(rest, 1, 2 * n).alias("stretch")))

    found = tried.select("_text_key", F.explode(F.array(*map(stands, sizes))).alias("_hit")).filter("_hit IS NOT NULL")
    return found.select("_text_key", F.col("_hit.anchor").alias("_anchor"), F.col("_hit.stretch").alias("_stretch"))


def joined_hits(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows ``(_text_key, pos, term)`` for the terms that occur in texts ``(_text_key, _text)``.

    A term is known by its anchor, its first characters. Which anchors the list has travels in the plan as a field of
    bits, so a text offers few places where no term starts; these are joined by anchor and the match is tested on the
    spot. An empty term is found in every text that is not null.
    """
    terms = terms.withColumn("_size", _classes(F.length("term"))).withColumn("_anchor", F.expr("left(term, _size)"))
    # A row per class, of which there are few, whatever the number of terms.
    found = terms.groupBy("_size").agg(
        F.max(F.octet_length("term")).alias("longest"), F.count("*").alias("rows"), F.sum(F.octet_length("term")).alias("size")
    ).collect()
    sizes = sorted(row["_size"] for row in found)
    longest = max((row["longest"] for row in found), default=0)
    sums = F.concat(F.array(_anchor(F.col("_size"), F.col("_anchor"))), gates(F.col("term"), F.col("_size")))
    field = bit_field(terms.select(F.explode(sums).alias("checksum")).distinct())
    known = texts.filter(F.col("_text").isNotNull())
    some = [n for n in sizes if n]
    # An empty term stands in every text. Copies of a text, and repeats within one, offer the same.
    nowhere = known.select("_text_key", F.lit("").alias("_anchor"), F.lit("").alias("_stretch"))
    offered = offered_rows(known, some, longest, field) if some else nowhere.limit(0)
    offered = offered.union(nowhere) if 0 in sizes else offered
    small = fits(sum(row["rows"] for row in found), sum(row["size"] for row in found))
    hits = spread_join(offered, terms.drop("_size"), "_anchor", "_text_key", small, F.startswith("_stretch", "term"))
    return hits.select("_text_key", "pos", "term").distinct()
