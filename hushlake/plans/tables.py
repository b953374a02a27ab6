"""Input tables, and tables Spark derives from them, with the same derivation in SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.functions.labels import BUILT_IN_TYPES
from hushlake.operators.rules import Rule
from hushlake.sources.readers import spread

AS_OF = dt.datetime(2024, 1, 15, 12, 0, 0)

RULES = [
    Rule("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    Rule("PHONE_NUMBER", r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}"),
    Rule("IP_ADDRESS", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
    Rule("BANK_CARD", r"\b\d{16}\b"),
    Rule("SECRET", r"(?:token|secret|password|api[_-]?key)\s*[:=]\s*[^\s,;]+"),
]

# ``conversations`` holds no personal data; long words stand in for it.
WORD_RULES = [Rule("LONG_WORD", r"[a-z]{12,}")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"), "page_id")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with instants, as the stored time has no zone and means UTC."""
    return as_events(table(spark, sf_dir, "events"))


def as_events(raw: DataFrame) -> DataFrame:
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


# Column name and formula, the same text in both dialects. k is a number inside props.
_REQUEST_COLUMNS = [
    ("id", "concat('r', CAST(event_id AS STRING))"),
    ("timestamp", "ts"),
    ("upstream_id", "concat('up', CAST(user_id % 4 AS STRING))"),
    ("profile_id", "CASE WHEN user_id % 2 = 0 THEN 'openai' ELSE 'generic' END"),
    (
        "operation_id",
        "CASE event_id % 10 WHEN 0 THEN 'passthrough' WHEN 1 THEN 'disabled' ELSE 'chat' END",
    ),
    ("model", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat('m', CAST(event_id % 3 AS STRING)) END"),
    (
        "protection_mode",
        "CASE WHEN event_id % 20 IN (0, 1) THEN NULL WHEN event_id % 10 = 0 THEN 'passthrough' "
        "WHEN event_id % 10 = 1 THEN 'disabled' ELSE 'redacted' END",
    ),
    ("gateway_type", "CASE WHEN event_id % 3 = 0 THEN 'proxy_gateway' ELSE 'api_gateway' END"),
    (
        "target_host",
        "CASE WHEN event_id % 3 = 0 THEN concat('h', CAST(user_id % 6 AS STRING), '.example.com') END",
    ),
    ("method", "'POST'"),
    ("path", "concat('/v1/', event_type)"),
    ("status_code", "CAST(CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS BIGINT)"),
    ("duration_ms", "CAST(floor(value * 10) AS BIGINT)"),
    ("streaming", "event_id % 4 = 0"),
    ("request_bytes", "CAST(512 + k * 37 AS BIGINT)"),
    ("response_bytes", "CAST(256 + floor(value * 100) AS BIGINT)"),
    ("entity_count", "CAST(CASE WHEN event_id % 10 IN (0, 1) THEN 0 ELSE k % 5 END AS BIGINT)"),
    ("token_input", "CAST(k * 11 AS BIGINT)"),
    ("token_output", "CAST(floor(value) AS BIGINT)"),
    ("token_total", "CAST(k * 11 + floor(value) AS BIGINT)"),
    ("token_cached", "CAST(CASE WHEN event_id % 3 = 0 THEN k END AS BIGINT)"),
    ("error_code", "CASE WHEN event_type = 'error' THEN 'upstream_error' END"),
]

# DuckDB: the derived log, with token usage as four columns.
REQUESTS_SQL = (
    "requests AS (SELECT event_id, user_id, k, "
    + ", ".join(f'{formula} AS "{name}"' for name, formula in _REQUEST_COLUMNS)
    + " FROM (SELECT *, CAST(props ->> '$.k' AS BIGINT) AS k FROM events))"
)


def as_requests(events_: DataFrame) -> DataFrame:
    """The request log of an event table, batch or stream; event_id, user_id and k stay beside it."""
    keyed = events_.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    flat = keyed.select("event_id", "user_id", "k", *[F.expr(f).alias(n) for n, f in _REQUEST_COLUMNS])
    usage = F.struct(*[F.col(f"token_{n}").alias(n) for n in ("input", "output", "total", "cached")])
    return flat.withColumn("token_usage", usage).drop("token_input", "token_output", "token_total", "token_cached")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_requests(events(spark, sf_dir))


def redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with every fiftieth request delivered again, changed."""
    first = requests(spark, sf_dir).withColumn("pos", F.col("event_id"))
    again = first.filter("event_id % 50 = 0").withColumn("status_code", F.lit(599).cast("bigint"))
    return first.unionByName(again.withColumn("pos", F.col("event_id") + 1_000_000_000))


REDELIVERED_SQL = (
    REQUESTS_SQL + ", redelivered AS (SELECT * REPLACE (status_code AS status_code), event_id AS pos FROM requests"
    " UNION ALL SELECT * REPLACE (CAST(599 AS BIGINT) AS status_code), event_id + 1000000000 AS pos"
    " FROM requests WHERE event_id % 50 = 0)"
)


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with audited fields and raw exchanges."""
    types = F.array(*[F.lit(t) for t in BUILT_IN_TYPES])
    entity = lambda i: F.struct(
        F.element_at(types, ((F.col("event_id") + i) % len(BUILT_IN_TYPES) + 1).cast("int")).alias("type"),
        F.concat(F.lit("<E:"), F.lpad(F.hex(i), 4, "0"), F.lit(">")).alias("replacement"),
        F.lit("x***").alias("masked"),
        F.lit(0.9).alias("confidence"),
        F.array(F.lit("model:a")).alias("sources"),
    )
    found = F.when(
        F.col("entity_count") > 0,
        F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("entity_count")), entity),
    )
    field = F.struct(
        F.lit("messages[0].content").alias("path"),
        F.col("path").alias("original_masked"),
        F.col("path").alias("redacted"),
        found.alias("entities"),
    )
    headers = F.create_map(
        F.lit("content-type"),
        F.array(F.lit("application/json")),
        F.lit("x-user"),
        F.array(F.col("user_id").cast("string"), F.col("profile_id")),
    )
    no_headers = F.from_json(F.lit("{}"), "map<string,array<string>>")
    raw_request = F.struct("method", F.concat(F.lit("https://api.example.com"), "path").alias("url"), headers.alias("headers"), F.lit("{}").alias("body"))
    raw_response = F.struct(
        F.col("status_code").alias("status"),
        F.when(F.col("event_id") % 3 == 0, no_headers).otherwise(headers).alias("headers"),
        F.lit(None).cast("string").alias("body"),
    )
    return requests(spark, sf_dir).withColumns(
        {
            "fields": F.when(F.col("event_id") % 2 == 0, F.array(field)),
            "raw_request": F.when(F.col("event_id") % 4 != 3, raw_request),
            "raw_response": F.when(F.col("event_id") % 5 != 4, raw_response),
        }
    )


def literal(text: str) -> str:
    """A SQL string literal for DuckDB."""
    return "'" + text.replace("'", "''") + "'"


def rules_sql(rules: list[Rule]) -> str:
    rows = ", ".join(f"({i}, {literal(r.id)}, {literal(r.pattern)})" for i, r in enumerate(rules))
    return f"rules AS (SELECT * FROM (VALUES {rows}) AS v(pos, id, p))"
