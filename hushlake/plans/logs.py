"""Log sanitising, labels and the request log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from hushlake.functions.labels import BUILT_IN_TYPES, LABELS, LOCALES, label_types
from hushlake.functions.text import format_bytes, format_headers, limit_field, sanitize
from hushlake.operators import audit
from hushlake.operators.client_log import sanitize_client_log
from hushlake.operators.decode import decode
from hushlake.plans.registry import query
from hushlake.plans.tables import (
    AS_OF,
    REDELIVERED_SQL,
    REQUESTS_SQL,
    details,
    documents,
    events,
    literal,
    pages,
    redelivered,
    requests,
)
from hushlake.session import work_dir
from hushlake.sources.writers import write_requests

# ---------------------------------------------------------------- sanitising

# White space as ECMAScript has it, in RE2's notation.
_W = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def sanitized_sql(column: str) -> str:
    steps = [
        (rf"(authorization[{_W}]*[:=][{_W}]*bearer[{_W}]+)[^{_W},;]+", r"\1[REDACTED]", "gi"),
        (rf"((?:api[_-]?key|token|secret|password)[{_W}]*[:=][{_W}]*)[^{_W},;]+", r"\1[REDACTED]", "gi"),
        (rf"\b(sk-[A-Za-z0-9_-]+|Bearer[{_W}]+[A-Za-z0-9._~-]+)", "[REDACTED]", "g"),
    ]
    for pattern, replacement, flags in steps:
        column = f"regexp_replace({column}, {literal(pattern)}, '{replacement}', '{flags}')"
    return column


def limited_sql(column: str) -> str:
    return f"CASE WHEN length({column}) > 8000 THEN left({column}, 8000) || '…' ELSE {column} END"


@query("limit_field", f"SELECT doc_id, {limited_sql('text')} AS text FROM documents")
def limit_field_query(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", limit_field(F.col("text")).alias("text"))


@query("sanitize_log", f"SELECT doc_id, {sanitized_sql('text')} AS text FROM documents")
def sanitize_log(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", sanitize(F.col("text")).alias("text"))


@query("sanitize_pages", f"SELECT page_id, {sanitized_sql('html')} AS html FROM pages")
def sanitize_pages(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", sanitize(F.col("html")).alias("html"))


_CLEAN = {c: sanitized_sql(limited_sql(c)) for c in ("message", "stack", "component_stack", "source")}


def _json_string(col):
    listed = F.to_json(F.array(col))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


@query(
    "sanitize_client_log",
    f"""WITH log AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN text
  WHEN 2 THEN '{{"lang":"' || lang || '","n":' || n_chars || '}}' ELSE 'Authorization: Bearer ' || source || ', sk-' || lang END AS message,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END AS stack, 'Bearer ' || lang AS component_stack,
  CASE WHEN doc_id % 8 = 0 THEN 'TypeError' ELSE '' END AS error_name, 'token=' || source || ';x' AS source FROM documents)
SELECT doc_id, coalesce(nullif({_CLEAN['message']}, ''), nullif(error_name, ''), 'Unknown error') AS message,
       coalesce({_CLEAN['stack']}, '-') AS stack, {_CLEAN['component_stack']} AS component_stack, {_CLEAN['source']} AS source FROM log""",
)
def sanitize_client_log_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    log = docs.select(
        "doc_id",
        F.expr("CASE WHEN doc_id % 8 = 0 THEN 'TypeError' ELSE '' END").alias("error_name"),
        F.when(F.col("doc_id") % 4 == 0, _json_string(F.lit("")))
        .when(F.col("doc_id") % 4 == 1, _json_string(F.col("text")))
        .when(F.col("doc_id") % 4 == 2, F.to_json(F.struct("lang", F.col("n_chars").alias("n"))))
        .otherwise(_json_string(F.concat(F.lit("Authorization: Bearer "), "source", F.lit(", sk-"), "lang")))
        .alias("error"),
        F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("stack"),
        F.concat(F.lit("Bearer "), "lang").alias("component_stack"),
        F.concat(F.lit("token="), "source", F.lit(";x")).alias("source"),
    )
    return sanitize_client_log(log).select(
        "doc_id", "message", F.coalesce("stack", F.lit("-")).alias("stack"), "component_stack", "source"
    )


# ---------------------------------------------------------------- labels

_TYPED = """typed AS (SELECT event_id, ['zh', 'en', 'ja', 'de'][user_id % 4 + 1] AS locale,
  CASE event_id % 5 WHEN 0 THEN ' person ' WHEN 1 THEN 'PASSPORT' WHEN 2 THEN '' WHEN 3 THEN ' ' || event_type ELSE 'Ip_Address' END AS type
  FROM events)"""
_LABEL_ROWS = ", ".join(
    f"('{locale}', '{row[0]}', {literal(row[i + 1])})" for row in LABELS for i, locale in enumerate(LOCALES)
)


@query(
    "label_types",
    f"""WITH {_TYPED}, labels AS (SELECT * FROM (VALUES {_LABEL_ROWS}) AS v(locale, key, label))
SELECT event_id, t.locale, type, coalesce(label, nullif(trim(type), ''), CASE t.locale WHEN 'zh' THEN '自定义实体' WHEN 'en' THEN 'Custom entity'
  WHEN 'ja' THEN 'カスタム エンティティ' ELSE 'Benutzerdefinierte Entität' END) AS label
FROM typed t LEFT JOIN labels l ON l.locale = t.locale AND l.key = upper(trim(type))""",
)
def label_types_query(spark, sf_dir):
    typed = events(spark, sf_dir).selectExpr(
        "event_id",
        "array('zh', 'en', 'ja', 'de')[int(user_id % 4)] AS locale",
        "CASE event_id % 5 WHEN 0 THEN ' person ' WHEN 1 THEN 'PASSPORT' WHEN 2 THEN '' "
        "WHEN 3 THEN concat(' ', event_type) ELSE 'Ip_Address' END AS type",
    )
    return label_types(typed)


# ---------------------------------------------------------------- request log

ROW_SQL = "id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS at, upstream_id, operation_id, path, status_code, entity_count"
_UNPROTECTED = (
    "(coalesce(protection_mode IN ('passthrough', 'disabled'), false) OR operation_id IN ('passthrough', 'disabled'))"
)
_SEARCHED = "contains(lower(upstream_id || coalesce(model, '') || coalesce(target_host, '') || path), {})"


def request_rows(df):
    return df.select(
        "id",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"),
        "upstream_id",
        "operation_id",
        "path",
        "status_code",
        "entity_count",
    )


# Everything recorded about a request, nested members as text.
_TYPES = "[" + ", ".join(literal(t) for t in BUILT_IN_TYPES) + "]"
_HEADER_PAIRS = "'content-type=application/json;x-user=' || user_id || ',' || profile_id"
_ENTITY_LIST = (
    f"array_to_string(list_transform(range(1, entity_count + 1), lambda i: {_TYPES}[(event_id + i) % {len(BUILT_IN_TYPES)} + 1] "
    "|| '/<E:' || lpad(CAST(i AS VARCHAR), 4, '0') || '>/x***/0.9/model:a'), ' ')"
)
FIELDS_SQL = f"CASE WHEN event_id % 2 = 0 THEN 'messages[0].content|' || path || '|' || path || '|' || {_ENTITY_LIST} ELSE '-' END"
REQUEST_SQL = f"CASE WHEN event_id % 4 <> 3 THEN 'POST https://api.example.com' || path || ' ' || {_HEADER_PAIRS} || ' {{}}' ELSE '-' END"
RESPONSE_SQL = f"""CASE WHEN event_id % 5 <> 4 THEN status_code || ' ' || CASE WHEN event_id % 3 = 0 THEN '' ELSE {_HEADER_PAIRS} END || ' -'
ELSE '-' END"""
DETAIL_SQL = f"""{ROW_SQL}, coalesce(model, '-') AS model, profile_id, coalesce(protection_mode, '-') AS protection_mode, gateway_type,
coalesce(target_host, '-') AS target_host, method, duration_ms, streaming, request_bytes, response_bytes,
token_input || '/' || token_output || '/' || token_total || '/' || coalesce(CAST(token_cached AS VARCHAR), '-') AS usage,
coalesce(error_code, '-') AS error_code, {FIELDS_SQL} AS fields, {REQUEST_SQL} AS raw_request, {RESPONSE_SQL} AS raw_response"""

_HEADER_TEXT = "array_join(transform(array_sort(map_entries({}.headers)), e -> concat(e.key, '=', array_join(e.value, ','))), ';')"
NESTED = {
    "fields": """coalesce(array_join(transform(fields, f -> concat_ws('|', f.path, f.original_masked, f.redacted, coalesce(array_join(transform(
        f.entities, e -> concat_ws('/', e.type, e.replacement, e.masked, e.confidence, array_join(e.sources, ','))), ' '), ''))), '||'), '-')""",
    "raw_request": f"coalesce(concat(raw_request.method, ' ', raw_request.url, ' ', {_HEADER_TEXT.format('raw_request')}, ' ', raw_request.body), '-')",
    "raw_response": f"""if(raw_response is null, '-', concat(raw_response.status, ' ', {_HEADER_TEXT.format('raw_response')}, ' ',
        coalesce(raw_response.body, '-')))""",
}


def detail_rows(df):
    """All columns of a request with its detail."""
    dash = lambda *names: [F.coalesce(n, F.lit("-")).alias(n) for n in names]
    usage = "concat_ws('/', token_usage.input, token_usage.output, token_usage.total, coalesce(string(token_usage.cached), '-'))"
    return df.select(
        "id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), "upstream_id", "operation_id", "path", "status_code",
        "entity_count", *dash("model"), "profile_id", *dash("protection_mode"), "gateway_type", *dash("target_host"), "method",
        "duration_ms", "streaming", "request_bytes", "response_bytes", F.expr(usage).alias("usage"), *dash("error_code"),
        *[F.expr(text).alias(n) for n, text in NESTED.items()],
    )


# The hit lies across two columns: the model's last digit and the host.
@query("requests_search", f"WITH {REQUESTS_SQL} SELECT {ROW_SQL} FROM requests WHERE {_SEARCHED.format(literal('m0h3.ex'))}")
def requests_search(spark, sf_dir):
    return request_rows(audit.search_requests(requests(spark, sf_dir), "M0h3.EX"))


@query(
    "requests_on_date",
    f"WITH {REQUESTS_SQL} SELECT {ROW_SQL} FROM requests WHERE "
    "CAST(timezone('Asia/Tokyo', timezone('UTC', timestamp)) AS DATE) = DATE '2024-01-10'",
)
def requests_on_date(spark, sf_dir):
    return request_rows(audit.on_date(requests(spark, sf_dir), dt.date(2024, 1, 10), "Asia/Tokyo"))


@query("requests_unprotected", f"WITH {REQUESTS_SQL} SELECT {ROW_SQL} FROM requests WHERE {_UNPROTECTED}")
def requests_unprotected(spark, sf_dir):
    return request_rows(audit.by_protection(requests(spark, sf_dir), "unredacted"))


@query("requests_redacted", f"WITH {REQUESTS_SQL} SELECT {ROW_SQL} FROM requests WHERE NOT {_UNPROTECTED}")
def requests_redacted(spark, sf_dir):
    return request_rows(audit.by_protection(requests(spark, sf_dir), "redacted"))


@query(
    "requests_filtered",
    f"WITH {REQUESTS_SQL} SELECT {ROW_SQL} FROM requests WHERE {_SEARCHED.format(literal('click'))} "
    f"AND CAST(timestamp AS DATE) = DATE '2024-01-12' AND NOT {_UNPROTECTED}",
)
def requests_filtered(spark, sf_dir):
    return request_rows(audit.filter_requests(requests(spark, sf_dir), "CLICK", dt.date(2024, 1, 12), which="redacted"))


@query(
    "requests_page_deep",
    f"""WITH {REQUESTS_SQL}, crowded AS (SELECT * REPLACE (date_trunc('day', timestamp) + to_microseconds(event_id % 7 * 1000) AS timestamp) FROM requests),
page AS (SELECT id, timestamp, upstream_id FROM crowded ORDER BY timestamp DESC, id LIMIT 50 OFFSET 700)
SELECT id, strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS at, upstream_id, true AS has_more, CAST(750 AS BIGINT) AS next_offset FROM page""",
)
def requests_page_deep(spark, sf_dir):
    """A page within a crowded moment: all requests of a day fall into its first seven milliseconds."""
    moment = F.timestamp_micros(F.unix_micros(F.date_trunc("day", "timestamp")) + F.col("event_id") % 7 * 1000)
    paged = audit.page(requests(spark, sf_dir).withColumn("timestamp", moment), offset=700)
    return paged.select(
        "id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "upstream_id", "has_more",
        F.col("next_offset").cast("bigint").alias("next_offset"),
    )


@query(
    "requests_page",
    f"WITH {REQUESTS_SQL} SELECT {ROW_SQL}, true AS has_more, CAST(150 AS BIGINT) AS next_offset FROM requests "
    "ORDER BY timestamp DESC, id LIMIT 50 OFFSET 100",
)
def requests_page(spark, sf_dir):
    paged = audit.page(requests(spark, sf_dir), offset=100)
    return paged.select(
        *request_rows(paged).columns[:1], F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), "upstream_id",
        "operation_id", "path", "status_code", "entity_count", "has_more", F.col("next_offset").cast("bigint").alias("next_offset"),
    )


@query(
    "requests_dedupe",
    f"""WITH {REDELIVERED_SQL} SELECT id, arg_max(status_code, pos) AS status_code, arg_max(path, pos) AS path,
min(pos) AS pos FROM redelivered GROUP BY id""",
)
def requests_dedupe(spark, sf_dir):
    return audit.dedupe_requests(redelivered(spark, sf_dir).select("id", "status_code", "path", "pos"))


@query("request_detail", f"WITH {REQUESTS_SQL} SELECT {DETAIL_SQL} FROM requests WHERE id = 'r78'")
def request_detail(spark, sf_dir):
    """One request out of the stored log."""
    path, log = work_dir(spark, "log"), details(spark, sf_dir)
    write_requests(log, path)
    stored = spark.read.schema(log.schema.add("date", "date")).parquet(path)
    return detail_rows(audit.request_detail(stored, "r78"))


def _bytes_sql(column: str) -> str:
    tenths = f"CAST(floor({column} / 1024.0::DOUBLE * 10 + 0.5) AS BIGINT)"
    return (
        f"CASE WHEN {column} < 1024 THEN {column} || ' B' ELSE ({tenths} // 10) || '.' || ({tenths} % 10) || ' KB' END"
    )


@query(
    "request_properties",
    f"""WITH {REQUESTS_SQL} SELECT id, coalesce(model, '—') AS model,
CASE gateway_type WHEN 'proxy_gateway' THEN 'Proxy gateway' ELSE 'API gateway' END AS gateway,
coalesce(target_host, '—') AS target_host, profile_id AS profile,
CASE WHEN coalesce(protection_mode = 'disabled', false) OR operation_id = 'disabled' THEN 'disabled'
     WHEN {_UNPROTECTED} THEN 'passthrough' ELSE 'redacted' END AS protection,
entity_count, duration_ms || ' ms' AS duration, {_bytes_sql('request_bytes')} || ' → ' || {_bytes_sql('response_bytes')} AS traffic,
token_input || ' + ' || token_output || ' = ' || token_total ||
  CASE WHEN token_cached > 0 THEN ' · ' || token_cached || ' cached tokens' ELSE '' END AS tokens FROM requests""",
)
def request_properties(spark, sf_dir):
    return audit.request_properties(requests(spark, sf_dir))


@query("format_bytes", f"SELECT doc_id, {_bytes_sql('n_chars')} AS size FROM documents")
def format_bytes_query(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", format_bytes(F.col("n_chars")).alias("size"))


_HEADERS = "'content-type: application/json' || chr(10) || 'x-user: ' || user_id || ', ' || profile_id"


@query(
    "format_headers",
    f"WITH {REQUESTS_SQL} SELECT id, CASE WHEN event_id % 5 = 4 OR event_id % 3 = 0 THEN '—' ELSE {_HEADERS} END AS headers FROM requests",
)
def format_headers_query(spark, sf_dir):
    return details(spark, sf_dir).select("id", format_headers(F.col("raw_response.headers")).alias("headers"))


@query(
    "raw_exchange",
    f"""WITH {REQUESTS_SQL} SELECT id, 'POST https://api.example.com' || path AS request_title, {_HEADERS} AS request_headers,
'{{}}' AS request_body, 'HTTP ' || status_code AS response_title,
CASE WHEN event_id % 3 = 0 THEN '—' ELSE {_HEADERS} END AS response_headers, '—' AS response_body
FROM requests WHERE event_id % 4 <> 3 AND event_id % 5 <> 4""",
)
def raw_exchange(spark, sf_dir):
    return audit.raw_exchange(details(spark, sf_dir))


@query(
    "field_counts",
    f"""WITH {REQUESTS_SQL} SELECT id, CASE WHEN event_id % 2 = 0 THEN 'messages[0].content' ELSE '-' END AS path,
CASE WHEN event_id % 2 = 0 THEN entity_count ELSE 0 END AS n_entities FROM requests""",
)
def field_counts(spark, sf_dir):
    counted = audit.field_counts(details(spark, sf_dir))
    return counted.select("id", F.coalesce("path", F.lit("-")).alias("path"), F.col("n_entities").cast("bigint").alias("n_entities"))


@query("retention", f"WITH {REQUESTS_SQL} SELECT {ROW_SQL} FROM requests WHERE timestamp >= TIMESTAMP '2024-01-08 12:00:00'")
def retention(spark, sf_dir):
    return request_rows(audit.apply_retention(requests(spark, sf_dir), AS_OF, 7))


# Settings as documents: both on, one on, the other on, none given.
_SETTINGS = [
    ("up0", '{"record_request_content": true, "record_raw_request": true}'),
    ("up1", '{"record_request_content": true, "record_raw_request": "true"}'),
    ("up2", '{"record_request_content": null, "record_raw_request": true}'),
    ("up3", "{}"),
]


@query(
    "recording_gate",
    f"""WITH {REQUESTS_SQL} SELECT id, status_code, CASE WHEN upstream_id IN ('up0', 'up1') THEN {FIELDS_SQL} ELSE '-' END AS fields,
CASE WHEN upstream_id IN ('up0', 'up2') THEN {REQUEST_SQL} ELSE '-' END AS raw_request,
CASE WHEN upstream_id IN ('up0', 'up2') THEN {RESPONSE_SQL} ELSE '-' END AS raw_response FROM requests""",
)
def recording_gate(spark, sf_dir):
    """Each provider's settings, decoded from its document, decide what stays of its requests."""
    documents_ = spark.createDataFrame(_SETTINGS, "upstream_id string, json string")
    settings = decode(documents_, "settings", keep=["upstream_id"])
    kept = audit.apply_recording_settings(details(spark, sf_dir), settings, "upstream_id")
    return kept.select("id", "status_code", *[F.expr(text).alias(n) for n, text in NESTED.items()])
