"""A set of checksums as a field of bits that travels in the plan: no member is missed, a few others pass.

It is tested in the row, before anything is exploded or joined. Its size is bounded, so a set that is too large for it
lets more rows through, and changes no result of a join that follows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmine.session import written

#: Bits per member, and the bounds of their number: a mebibyte at most.
BITS_PER_MEMBER, LEAST_BITS, MOST_BITS = 16, 1 << 10, 1 << 23


class BitField(NamedTuple):
    words: Column
    size: int

    def has(self, checksum: Column) -> Column:
        """Whether ``checksum``, a bigint, may be a member."""
        word = F.get(self.words, F.shiftright(checksum, 6).bitwiseAND(F.lit(self.size - 1)).cast("int"))
        return F.getbit(word, checksum.bitwiseAND(F.lit(63)).cast("int")) == 1


def bit_field(members: DataFrame) -> BitField:
    """The field of the bigints in the first column of ``members``; at most `MOST_BITS` bits come to the driver."""
    name = members.columns[0]
    # Read twice, made once.
    members = written(members.select(name), "members")
    n = members.agg(F.count("*")).first()[0]
    bits = LEAST_BITS
    while bits < min(BITS_PER_MEMBER * n, MOST_BITS):
        bits *= 2
    at = F.col(name).bitwiseAND(F.lit(bits - 1))
    cells = members.select(F.shiftright(at, 6).alias("cell"), F.expr(f"shiftleft(1L, CAST(`{name}` & 63 AS INT))").alias("bit"))
    words = [0] * (bits // 64)
    for row in cells.groupBy("cell").agg(F.bit_or("bit").alias("bit")).collect():
        words[row.cell] = row.bit
    # One text, which the optimizer turns into a literal.
    return BitField(F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>"), len(words))
