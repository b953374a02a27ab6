"""Accounting of a detection cache whose entries live until unused for a while."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cache_sessions(df: DataFrame, key: str, ttl_seconds: int, ts: str = "ts") -> DataFrame:
    """Hits, misses and hit rate of each key; a hit renews the time to live.

    A use is a miss if it is the key's first or comes more than the time to
    live after the one before. Uses within a slot as wide as the time to live
    can never miss each other, so each slot is reduced, before the shuffle, to
    its number of uses and its ends. A busy key is then no more rows than
    there are slots in the time covered, and these are chained.
    """
    ttl = ttl_seconds * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    slots = (
        df.select(F.col(key), at.alias("__at"))
        .groupBy(key, F.floor(F.col("__at") / F.lit(max(ttl, 1))).alias("__slot"))
        .agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"), F.max("__at").alias("__last"))
    )
    before = F.lag("__last").over(Window.partitionBy(key).orderBy("__slot"))
    missed = F.coalesce(F.col("__first") - before > ttl, F.lit(True))
    totals = slots.withColumn("__missed", missed).groupBy(key).agg(
        F.sum("__n").alias("__n"), F.count_if("__missed").alias("misses")
    )
    hits = F.col("__n") - F.col("misses")
    return totals.select(key, hits.alias("hits"), "misses", (hits / F.col("__n")).alias("hit_rate"))
