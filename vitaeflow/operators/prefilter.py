"""Drop rows that a join would drop, before they move, where the list of keys is too long to broadcast.

The keys' hashes become a bitmap of bounded size, which is broadcast in pieces of 4 KB whatever the number
of keys. A row whose bit is not set has none of the keys; one whose bit is set may have, and the join that
follows decides. So rows are never lost, and the fewer keys there are for a bit, the fewer rows move in vain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and the most bits of a bitmap (64 MB).
BITS_PER_KEY, MOST_BITS = 16, 1 << 29
#: Bits of one of Spark's bitmaps.
_PIECE = 32_768


def bits_for(n_keys: int) -> int:
    """A whole number of pieces; one key in 16 bits lets about one other row in 16 pass."""
    return min(-(-max(n_keys, 1) * BITS_PER_KEY // _PIECE) * _PIECE, MOST_BITS)


def _bit(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits)) + 1


def key_bitmap(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """``(piece, bitmap)``: the bits of the non-null values in column ``key``, combined before the one small shuffle."""
    marked = keys.where(F.col(f"`{key}`").isNotNull()).select(_bit(F.col(f"`{key}`"), bits).alias("bit"))
    return marked.groupBy(F.bitmap_bucket_number("bit").alias("piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))


def may_match(rows: DataFrame, keys: DataFrame, key: str, n_keys: int | None = None) -> DataFrame:
    """The ``rows`` whose ``key`` may be among those of ``keys``: all that are, and few others; no shuffle of rows.

    Null keys match nothing. ``n_keys`` is the number of different keys where it is known, else it is estimated.
    """
    if n_keys is None:
        n_keys = keys.agg(F.approx_count_distinct(F.col(f"`{key}`"))).first()[0]
    bits = bits_for(n_keys)
    pieces = key_bitmap(keys, key, bits).toDF("_piece", "_bitmap")
    bit = _bit(F.col(f"`{key}`"), bits)
    at = F.bitmap_bit_position(bit)
    # the byte that holds the bit, then the bit
    byte = F.conv(F.hex(F.substring(F.col("_bitmap"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    found = rows.where(F.col(f"`{key}`").isNotNull()).join(F.broadcast(pieces), F.bitmap_bucket_number(bit) == F.col("_piece"))
    return found.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*(rows[f"`{c}`"] for c in rows.columns))
