"""A Bloom filter over an id column, built by aggregates.

The filter's bits come from one grouped bitmap aggregate (32,768 bits a row) and
travel as one binary literal of at most ``MAX_BITS`` (16 MB), about ten bits an
id; a fuller filter only lets more strangers through.  ``might_contain`` is a
column of built-in functions, so Spark evaluates it where the other side is
scanned, before any shuffle; an exact join has to follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_BITS, MAX_BITS = 1 << 15, 1 << 27
BITS_PER_ID, HASHES = 10, 4


class BloomFilter:
    """Null ids are not in it and are never found."""

    def __init__(self, ids: DataFrame, col: str):
        n = ids.count()
        self.bits = MIN_BITS
        while self.bits < min(BITS_PER_ID * n, MAX_BITS):
            self.bits *= 2
        at = ids.where(F.col(col).isNotNull()).select(F.explode(F.array(*self._places(F.col(col)))).alias("p"))
        rows = at.groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("bucket")) \
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("bits")).collect()
        flags = bytearray(self.bits // 8)
        for r in rows:
            flags[(r.bucket - 1) * 4096:r.bucket * 4096] = r.bits
        self.flags = bytes(flags)

    def _places(self, ids: Column) -> list[Column]:
        """Two hashes combined into ``HASHES`` places from 0."""
        one = F.xxhash64(F.lit("bloom"), ids)
        two = F.xxhash64(ids, F.lit("bloom"))
        return [F.pmod(one.bitwiseXOR(F.shiftleft(two, k) if k else two), F.lit(self.bits)) for k in range(HASHES)]

    def might_contain(self, ids: Column) -> Column:
        found = ids.isNotNull()
        table = F.lit(self.flags)
        for p in self._places(ids):
            byte = F.conv(F.hex(F.substring(table, (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            found = found & (F.getbit(byte, p.bitwiseAND(F.lit(7)).cast("int")) == 1)
        return found
