"""Statistics over the request log.

Each is one aggregation whose partial results are combined before the
shuffle; what is shuffled is as small as the result.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.operators.ranges import Range, range_bounds

BUCKET_FORMAT = {"hour": "yyyy-MM-dd'T'HH:mm", "day": "yyyy-MM-dd"}


def in_range(requests: DataFrame, bounds: Range) -> DataFrame:
    """Requests of a range. A ``date`` column, if the log has one, prunes folders."""
    ts = F.col("timestamp")
    kept = requests.filter((ts >= F.lit(bounds.start)) & (ts < F.lit(bounds.stop)))
    if "date" in requests.columns:
        kept = kept.filter(F.col("date").between(F.lit(bounds.start.date()), F.lit(bounds.stop.date())))
    return kept


def success(status: Column) -> Column:
    return status.between(200, 399)


def percent(part: Column, whole: Column) -> Column:
    """Rounded half up; 0 where there is no whole."""
    return F.when(whole > 0, F.floor(part / whole * 100 + F.lit(0.5))).otherwise(F.lit(0)).cast("bigint")


def cache_hit_rate(cached: Column, total: Column) -> Column:
    return percent(cached, total)


def audit_stats(requests: DataFrame, range_name: str, as_of: dt.datetime, tz: str = "UTC") -> DataFrame:
    """All totals of a range in one pass over it."""
    bounds = range_bounds(range_name, as_of, tz)
    zero = F.lit(0).cast("bigint")

    def total(column: str) -> Column:
        return F.coalesce(F.sum(column), zero)

    sums = in_range(requests, bounds).agg(
        F.count(F.lit(1)).alias("requests"),
        total("entity_count").alias("entities"),
        F.coalesce(F.avg(success(F.col("status_code")).cast("int")), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("average_latency_ms"),
        F.count_if("streaming").alias("streaming_requests"),
        total("token_usage.input").alias("token_input"),
        total("token_usage.output").alias("token_output"),
        total("token_usage.total").alias("token_total"),
        total("token_usage.cached").alias("token_cached"),
    )
    tpm = F.col("token_total") / F.lit(bounds.minutes) if bounds.minutes > 0 else F.lit(0.0)
    return sums.withColumns(
        {
            "tokens_per_minute": tpm,
            "tokens_per_minute_shown": F.floor(tpm + F.lit(0.5)),
            "success_percent": F.floor(F.col("success_rate") * 100 + F.lit(0.5)),
            "cache_hit_percent": cache_hit_rate(F.col("token_cached"), F.col("token_total")),
            "granularity": F.lit(bounds.granularity),
        }
    )


def entity_distribution(detail: DataFrame, range_name: str, as_of: dt.datetime, tz: str = "UTC") -> DataFrame:
    """Entities of each type found in a range."""
    kept = in_range(detail, range_bounds(range_name, as_of, tz))
    lists = F.filter(F.col("fields.entities"), lambda e: e.isNotNull())
    types = kept.select(F.explode(F.flatten(lists)).alias("__entity"))
    return types.groupBy(F.col("__entity.type").alias("type")).agg(F.count(F.lit(1)).alias("n_entities"))


def distribution_map(distribution: DataFrame) -> DataFrame:
    """The distribution as one map, as a statistics document holds it: one entry for each type."""
    entries = F.collect_list(F.struct("type", "n_entities"))
    return distribution.agg(F.map_from_entries(F.sort_array(entries)).alias("entity_types"))


def activity_series(requests: DataFrame, range_name: str, as_of: dt.datetime, tz: str = "UTC") -> DataFrame:
    """Requests and entities in each hour or day of the range; empty ones are 0.

    Buckets carry local time. They are at most 30 rows, made from the range.
    """
    bounds = range_bounds(range_name, as_of, tz)
    shape = BUCKET_FORMAT[bounds.granularity]
    local = F.date_trunc(bounds.granularity, F.from_utc_timestamp("timestamp", tz))
    counted = (
        in_range(requests, bounds)
        .groupBy(F.date_format(local, shape).alias("date"))
        .agg(F.count(F.lit(1)).alias("requests"), F.sum("entity_count").alias("entities"))
    )
    zero = F.lit(0).cast("bigint")
    return _buckets(requests.sparkSession, bounds).join(counted, "date", "left").select(
        "date",
        F.coalesce("requests", zero).alias("requests"),
        F.coalesce("entities", zero).alias("entities"),
    )


def _buckets(spark, bounds: Range) -> DataFrame:
    if bounds.granularity == "hour":
        dates = [f"{bounds.first_date.isoformat()}T{hour:02d}:00" for hour in range(24)]
    else:
        dates = [(bounds.first_date + dt.timedelta(days=i)).isoformat() for i in range(bounds.days)]
    return spark.createDataFrame([(d,) for d in dates], "date string")


def bucket_label(date: Column, granularity: str) -> Column:
    """What a bucket is called on the axis: the time of an hour, month and day of a day."""
    return F.substring(date, 12, 5) if granularity == "hour" else F.substring(date, 6, 100)


def series_peak(series: DataFrame) -> DataFrame:
    """Highest value of both series, at least 1."""
    return series.agg(
        F.greatest(F.lit(1).cast("bigint"), F.max("entities"), F.max("requests")).alias("peak")
    )
