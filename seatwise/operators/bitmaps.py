"""A bitmap of key hashes that thins the large side of a semi-join before its shuffle.

The bitmap has ``BITS_PER_KEY`` or more bits a key, sized by the measured number of keys, and is
built in the JVM by many tasks (``bitmap_construct_agg`` by bucket number).  Rows whose bit is
not set have no key in the list; the others, about one in ``BITS_PER_KEY`` by chance, go on to
the exact join.  So the result is the join's own.  Above ``MAX_BYTES`` of bits the rows go
to the join unthinned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
BLOCK_BITS = 1 << 15           # bits of one bitmap of ``bitmap_construct_agg``
MAX_BYTES = 64 << 20


def _place(col: str, bits: int) -> Column:
    """Hash of a key, from 1 to ``bits`` (a power of two)."""
    return F.pmod(F.xxhash64(F.col(f"`{col}`")), F.lit(bits)) + 1


def bits_for(n_keys: int) -> int:
    return max(BLOCK_BITS, 1 << max(0, n_keys * BITS_PER_KEY - 1).bit_length())


def possible_members(df: DataFrame, on: str, keys: DataFrame, n_keys: int) -> DataFrame:
    """Rows of ``df`` whose ``on`` may be among the ``n_keys`` keys of ``keys`` (column ``on``):
    all that are, and few others."""
    bits = bits_for(n_keys)
    if bits // 8 > MAX_BYTES:
        return df
    place = _place(on, bits)
    blocks = (keys.select(F.bitmap_bucket_number(place).alias("__block"), F.bitmap_bit_position(place).alias("__bit"))
              .groupBy("__block").agg(F.bitmap_construct_agg("__bit").alias("__bits")))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = df.withColumn("__block", F.bitmap_bucket_number(place)).join(F.broadcast(blocks), "__block")
    shifted = F.call_function("shiftright", byte, at.bitwiseAND(F.lit(7)).cast("int"))
    return marked.filter(shifted.bitwiseAND(F.lit(1)) == 1).select(*[F.col(f"`{c}`") for c in df.columns])
