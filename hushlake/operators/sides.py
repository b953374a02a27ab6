"""Broadcasting behind a check or a bound of the size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024


def byte_count() -> Column:
    """Aggregate: bytes of the rows as text."""
    return F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))


def measured(df: DataFrame, limit: int = BROADCAST_BYTES, size: int | None = None) -> DataFrame:
    """Mark a configuration table for broadcast if its rows, as text, are within ``limit`` bytes.

    Spark cannot know the size of an aggregated or generated table beforehand
    and would shuffle the large side of the join before finding out. Beyond
    the limit the join is left to Spark, which shuffles both sides and splits
    hot keys. ``size`` saves the measurement where it is known.
    """
    if size is None:
        size = df.agg(byte_count()).first()[0]
    return F.broadcast(df) if size <= limit else df


# Bits of a filter over keys: 2^29 bits are 16,384 rows of 4 KB, 64 MB however many keys there are.
KEY_BITS = 1 << 29
_BLOCK = 32768


def split_by_keys(df: DataFrame, other: DataFrame, keys: list[str], bits: int = KEY_BITS) -> tuple[DataFrame, DataFrame]:
    """``df`` in two parts: rows whose keys occur in ``other``, with few others among them, and rows whose keys do not.

    The keys of ``other`` become a bitmap of their hashes, which has a fixed
    size and goes to every task, so no row of ``df`` moves and nothing runs
    before the query does. Both parts read ``df``.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(bits))
    typed = other.select(*[F.col(k).cast(df.schema[k].dataType).alias(k) for k in keys])
    block, within = F.expr(f"__place div {_BLOCK}"), F.expr(f"__place % {_BLOCK}")
    filled = typed.select(place.alias("__place")).groupBy(block.alias("__block")).agg(F.bitmap_construct_agg(within).alias("__bits"))
    marked = df.withColumn("__place", place).withColumn("__block", block).join(F.broadcast(filled), "__block", "left")
    byte = F.conv(F.hex(F.expr(f"substring(__bits, int((__place % {_BLOCK}) div 8) + 1, 1)")), 16, 10).cast("int")
    occurs = F.coalesce(F.getbit(byte, (within % 8).cast("int")) == 1, F.lit(False))
    return tuple(marked.filter(c).select(*df.columns) for c in (occurs, ~occurs))
