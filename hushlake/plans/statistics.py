"""Statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushlake.functions.labels import BUILT_IN_TYPES
from hushlake.operators import stats
from hushlake.operators.cache import cache_sessions
from hushlake.plans.registry import query
from hushlake.plans.tables import AS_OF, REQUESTS_SQL, details, events, requests

# name: start, stop (exclusive), minutes, unit, number of buckets
_RANGES = {
    "today": ("2024-01-15", "2024-01-15 12:00:00", 720, "hour", 24),
    "yesterday": ("2024-01-14", "2024-01-15", 1440, "hour", 24),
    "7d": ("2024-01-09", "2024-01-15 12:00:00", 6 * 1440 + 720, "day", 7),
    "30d": ("2023-12-17", "2024-01-15 12:00:00", 29 * 1440 + 720, "day", 30),
}


def _within(name: str) -> str:
    start, stop, *_ = _RANGES[name]
    return f"timestamp >= TIMESTAMP '{start}' AND timestamp < TIMESTAMP '{stop}'"


def _stats_sql(name: str) -> str:
    minutes, unit = _RANGES[name][2:4]
    return f"""WITH {REQUESTS_SQL}, sums AS (SELECT count(*) AS requests, CAST(coalesce(sum(entity_count), 0) AS BIGINT) AS entities,
  coalesce(avg(CASE WHEN status_code BETWEEN 200 AND 399 THEN 1 ELSE 0 END), 0.0::DOUBLE) AS success_rate,
  coalesce(avg(duration_ms), 0.0::DOUBLE) AS average_latency_ms, count(*) FILTER (WHERE streaming) AS streaming_requests,
  CAST(coalesce(sum(token_input), 0) AS BIGINT) AS token_input, CAST(coalesce(sum(token_output), 0) AS BIGINT) AS token_output,
  CAST(coalesce(sum(token_total), 0) AS BIGINT) AS token_total, CAST(coalesce(sum(token_cached), 0) AS BIGINT) AS token_cached
  FROM requests WHERE {_within(name)})
SELECT *, token_total / {minutes}.0::DOUBLE AS tokens_per_minute,
  CAST(floor(token_total / {minutes}.0::DOUBLE + 0.5) AS BIGINT) AS tokens_per_minute_shown,
  CAST(floor(success_rate * 100 + 0.5) AS BIGINT) AS success_percent,
  CASE WHEN token_total > 0 THEN CAST(floor(token_cached::DOUBLE / token_total * 100 + 0.5) AS BIGINT) ELSE 0 END AS cache_hit_percent,
  '{unit}' AS granularity FROM sums"""


def _series_cte(name: str) -> str:
    start, _, _, unit, n = _RANGES[name]
    shape = "%Y-%m-%dT%H:%M" if unit == "hour" else "%Y-%m-%d"
    return f"""buckets AS (SELECT strftime(TIMESTAMP '{start}' + i * INTERVAL 1 {unit}, '{shape}') AS date FROM range({n}) AS t(i)),
counted AS (SELECT strftime(date_trunc('{unit}', timestamp), '{shape}') AS date, count(*) AS requests, CAST(sum(entity_count) AS BIGINT) AS entities
  FROM requests WHERE {_within(name)} GROUP BY 1),
series AS (SELECT date, coalesce(requests, 0) AS requests, coalesce(entities, 0) AS entities FROM buckets LEFT JOIN counted USING (date))"""


def _register(name: str) -> None:
    unit = _RANGES[name][3]
    label = "substring(date, 12, 5)" if unit == "hour" else "substring(date, 6)"

    @query(f"audit_stats_{name}", _stats_sql(name))
    def totals(spark, sf_dir):
        return stats.audit_stats(requests(spark, sf_dir), name, AS_OF)

    @query(f"activity_{name}", f"WITH {REQUESTS_SQL}, {_series_cte(name)} SELECT date, {label} AS label, requests, entities FROM series")
    def series(spark, sf_dir):
        found = stats.activity_series(requests(spark, sf_dir), name, AS_OF)
        return found.withColumn("label", stats.bucket_label(F.col("date"), unit))


for _name in _RANGES:
    _register(_name)


@query(
    "series_peak",
    f"WITH {REQUESTS_SQL}, {_series_cte('30d')} SELECT greatest(1, max(entities), max(requests)) AS peak FROM series",
)
def series_peak(spark, sf_dir):
    return stats.series_peak(stats.activity_series(requests(spark, sf_dir), "30d", AS_OF))


@query(
    "cache_hit_rate",
    f"""WITH {REQUESTS_SQL} SELECT upstream_id, CAST(floor(sum(token_cached)::DOUBLE / sum(token_total) * 100 + 0.5) AS BIGINT) AS percent
FROM requests GROUP BY upstream_id""",
)
def cache_hit_rate(spark, sf_dir):
    usage = F.col("token_usage")
    sums = requests(spark, sf_dir).groupBy("upstream_id").agg(F.sum(usage["cached"]).alias("c"), F.sum(usage["total"]).alias("t"))
    return sums.select("upstream_id", stats.cache_hit_rate(F.col("c"), F.col("t")).alias("percent"))


_DISTRIBUTION = f"""{REQUESTS_SQL}, found AS (SELECT event_id, unnest(range(1, entity_count + 1)) AS i FROM requests
  WHERE event_id % 2 = 0 AND {_within('7d')}),
spread AS (SELECT [{', '.join(f"'{t}'" for t in BUILT_IN_TYPES)}][(event_id + i) % 8 + 1] AS type, count(*) AS n_entities
           FROM found GROUP BY 1)"""


@query("entity_distribution", f"WITH {_DISTRIBUTION} SELECT * FROM spread")
def entity_distribution(spark, sf_dir):
    return stats.entity_distribution(details(spark, sf_dir), "7d", AS_OF)


@query(
    "entity_distribution_map",
    f"WITH {_DISTRIBUTION} SELECT string_agg(type || '=' || n_entities, ',' ORDER BY type) AS entity_types FROM spread",
)
def entity_distribution_map(spark, sf_dir):
    found = stats.distribution_map(stats.entity_distribution(details(spark, sf_dir), "7d", AS_OF))
    return found.select(
        F.expr("array_join(transform(map_entries(entity_types), e -> concat(e.key, '=', e.value)), ',')").alias("entity_types")
    )


@query(
    "cache_sessions",
    """WITH gaps AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
sums AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE gap IS NULL OR gap > 900000000) AS misses FROM gaps GROUP BY user_id)
SELECT user_id, n - misses AS hits, misses, (n - misses) / n AS hit_rate FROM sums""",
)
def cache_sessions_query(spark, sf_dir):
    return cache_sessions(events(spark, sf_dir), "user_id", 900)
