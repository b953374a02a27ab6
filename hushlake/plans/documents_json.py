"""Strict decoding of JSON documents that Spark derives from the event table.

The documents carry missing members, wrong types, unknown enum values and
invalid text, by event_id. Their text is put together by the same SQL
expression on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hushlake.operators.decode import decode, redact_result
from hushlake.plans.registry import query
from hushlake.plans.tables import events
from hushlake.sources.readers import spread

# ---------------------------------------------------------------- documents


def _choice(*values: str, by: str = "event_id") -> str:
    """SQL text that takes one of the JSON values in turn."""
    cases = " ".join(f"WHEN {i} THEN {value}" for i, value in enumerate(values[:-1]))
    return f"CASE {by} % {len(values)} {cases} ELSE {values[-1]} END"


def _document(**members: str) -> str:
    """SQL text of a JSON object; one in 50 each is an array or not JSON in one of five ways."""
    body = ", ', ', ".join(f"'\"{name}\": ', {value}" for name, value in members.items())
    first = next(iter(members))
    quotes = f"concat('{{', chr(39), '{first}', chr(39), ': ', chr(39), 'x', chr(39), '}}')"
    return (
        f"CASE event_id % 50 WHEN 17 THEN '{{broken' WHEN 18 THEN '[1, 2]' WHEN 19 THEN {quotes} "
        f"WHEN 20 THEN concat('{{', {body}, '}} x') WHEN 21 THEN concat('{{', {body}, ', \"more\": NaN}}') "
        f"WHEN 22 THEN concat('{{', {body}) ELSE concat('{{', {body}, '}}') END"
    )


_ID = "concat('\"r', CAST(event_id AS STRING), '\"')"
_N = "CAST(user_id AS STRING)"

_USAGE = _choice(
    f"concat('{{\"input\": ', {_N}, ', \"output\": 2, \"total\": \"x\", \"cached\": 0}}')",
    f"concat('{{\"input\": 1.0, \"output\": null, \"total\": 7, \"cached\": ', {_N}, '}}')",
    "'[]'",
    "'null'",
    by="user_id",
)
_HEADERS = _choice(
    f"concat('{{\"accept\": [\"a\", 1, \"b\"], \"x-n\": ', {_N}, ', \"x-e\": []}}')", "'\"none\"'", "'{}'"
)
_ENTITIES = _choice(
    "concat('[{\"type\": \"T', event_type, '\", \"replacement\": \"<A:0001>\", \"confidence\": 0.5, \"sources\": [\"m\", 3], "
    "\"masked\": \"a**\"}, 5, {\"confidence\": \"high\", \"sources\": \"m\"}]')",
    "'{}'",
    "'null'",
    "'[]'",
)
_FIELDS = (
    f"concat('[{{\"path\": \"p', {_N}, '\", \"original_masked\": \"o', event_type, '\", \"redacted\": 3, \"entities\": ', {_ENTITIES}, "
    "'}, \"x\", {\"original_masked\": null, \"redacted\": \"r\"}]')"
)

DOCUMENTS = {
    "request": _document(
        id=_ID,
        timestamp=_choice("'\"2024-01-02T03:04:05Z\"'", "'5'"),
        upstream_id=_choice("'\"up\"'", "'true'", "'null'"),
        profile_id=_choice("'\"openai\"'", "'[]'"),
        operation_id=_choice("'\"chat\"'", "'{}'", "'\"\"'"),
        target_host=_choice("'\"h.example.com\"'", "'null'", "'3'"),
        method=_choice("'\"POST\"'", "'1'"),
        request_bytes=_choice(_N, "'\"512\"'", "'1e3'"),
        response_bytes=_choice("'256'", "'null'", _N),
        model=_choice("'\"m\"'", "'7'", "'null'"),
        protection_mode=_choice("'\"redacted\"'", "'\"passthrough\"'", "'\"disabled\"'", "'\"other\"'", "'1'"),
        gateway_type=_choice("'\"proxy_gateway\"'", "'\"api_gateway\"'", "'\"x\"'"),
        path="concat('\"/v1/', event_type, '\"')",
        status_code=_choice("'\"200\"'", "'200'", "'404.0'", "'null'", "'5e2'"),
        duration_ms=_N,
        streaming=_choice("'true'", "'\"true\"'", "'false'", "'1'"),
        entity_count=_choice(_N, "'[]'"),
        token_usage=_USAGE,
        error_code=_choice("'\"e\"'", "'{}'"),
        fields=_FIELDS,
        raw_request=_choice(
            f"concat('{{\"method\": \"POST\", \"url\": \"u', event_type, '\", \"headers\": ', {_HEADERS}, ', \"body\": 4}}')",
            "'\"raw\"'",
            f"concat('{{\"method\": null, \"url\": 5, \"headers\": ', {_HEADERS}, ', \"body\": \"b\"}}')",
        ),
        raw_response=_choice(
            f"concat('{{\"status\": ', {_N}, ', \"headers\": ', {_HEADERS}, ', \"body\": \"ok\"}}')", "'null'", "'[]'",
            f"concat('{{\"status\": \"200\", \"headers\": ', {_HEADERS}, '}}')",
        ),
    ),
    "policy": _document(
        enabled=_choice("'false'", "'\"no\"'", "'null'"),
        redact_ai_answers=_choice("'true'", "'1'"),
        entity_types=_choice(
            "'[{\"type\": \"URL\", \"enabled\": false}, {\"type\": 5}, \"PERSON\", {\"enabled\": \"x\", \"type\": \"URL\"}]'",
            "'{\"type\": \"URL\"}'",
        ),
        rules="concat('[{\"id\": \"', event_type, '\", \"pattern\": \"a+\"}, {\"id\": 1, \"enabled\": false}, null]')",
    ),
    "settings": _document(
        record_raw_request=_choice("'true'", "'0'"),
        retention_days=_choice("'7'", "'\"7\"'", "'null'"),
        hf_base_url=_choice("'\"u\"'", "'8'"),
        max_inference_tokens=_choice("'1024'", "'{}'"),
        inference_provider=_choice("'\"auto\"'", "'\"gpu\"'", "'\"tpu\"'", "'4'"),
        entity_cache_enabled=_choice("'false'", "'\"false\"'"),
        entity_cache_ttl_seconds=_choice(_N, "'false'"),
    ),
    "stats": _document(
        requests=_N,
        entities=_choice("'3'", "'\"3\"'"),
        success_rate=_choice("'0.5'", "'1'", "'\"x\"'"),
        entity_types=_choice("concat('{\"URL\": ', " + _N + ", ', \"PIN\": \"x\"}')", "'[1]'"),
        daily=_choice(
            "concat('[{\"date\": \"2024-01-01\", \"requests\": ', " + _N + ", '}, 4, {\"entities\": 2}]')", "'{}'"
        ),
        average_latency_ms=_choice("'12.5'", "'\"fast\"'", "'1e1'"),
        streaming_requests=_choice(_N, "'false'"),
        token_input=_choice(_N, "'\"1\"'", "'null'"),
        token_output=_choice("'4'", "'[]'"),
        token_total=_choice("'9'", "'null'"),
        token_cached=_choice("'2.0'", "'{}'", _N),
        tokens_per_minute=_choice("'0.25'", "'3'", "'null'"),
        granularity=_choice("'\"hour\"'", "'\"day\"'", "'\"week\"'", "'1'"),
    ),
    "result": _document(
        text=_choice("concat('\"masked ', event_type, '\"')", "'null'", "'5'"),
        scope_id=_choice("'\"s\"'", "'1'"),
        replacement_count=_choice(_N, "'\"2\"'"),
        entities=_ENTITIES,
    ),
    "profiles": _document(
        id=_ID, name=_choice("'\"n\"'", "'5'"), operations=_choice("'[1]'", "'{}'"),
        header_templates=_choice("'{\"a\": \"b\", \"c\": 1}'", "'[]'"),
    ),
    "upstreams": _document(
        id=_ID,
        base_url=_choice("'\"http://u\"'", "'1'"),
        credential_mode=_choice("'\"managed\"'", "'\"other\"'", "'null'"),
        profile_id=_choice("'\"p\"'", "'9'"),
        header_templates=_choice("'{\"a\": \"b\", \"c\": 1}'", "'[]'", "'{}'"),
        api_key=_choice("'\"k\"'", "'null'"),
        enabled=_choice("'false'", "'\"false\"'", "'null'"),
    ),
    "targets": _document(
        id=_ID, hosts=_choice("'[\"a.example.com\", 5, \"*.b.example.com\"]'", "'\"a\"'"), profile_id=_choice("'\"p\"'", "'0'"),
        enabled=_choice("'true'", "'\"true\"'"),
    ),
    "models": _document(
        id=_ID,
        valid=_choice("'true'", "'1'"),
        active=_choice("'true'", "'false'", "'\"true\"'"),
        built_in=_choice("'false'", "'true'", "'null'"),
        manifest=_choice(
            "concat('{\"name\": \"', event_type, '\", \"version\": \"1.', " + _N + ", '\", \"quantization\": \"int8\", \"max_tokens\": 512, "
            "\"stride\": \"x\", \"label_scheme\": \"BIO\", \"entity_types\": {\"0\": \"', event_type, '\", \"1\": 7, \"2\": \"PERSON\"}}')",
            "'[]'",
            "concat('{\"name\": 1, \"version\": 2, \"max_tokens\": \"512\", \"stride\": ', " + _N + ", ', \"entity_types\": {}}')",
        ),
        errors=_choice("'[\"e\", 1]'", "'{}'"),
    ),
}


def json_documents(spark, sf_dir, kind: str):
    return spread(events(spark, sf_dir), "event_id").select("event_id", F.expr(DOCUMENTS[kind]).alias("json"))


# ---------------------------------------------------------------- SQL twin parts


def docs_sql(kind: str) -> str:
    """CTE ``docs`` with a document ``j`` that is an object or empty."""
    return (
        f"raw AS (SELECT event_id, {DOCUMENTS[kind]} AS d FROM events), "
        # NaN is no JSON, though DuckDB takes it.
        "docs AS (SELECT event_id, CASE WHEN json_valid(d) AND NOT contains(d, 'NaN') THEN CAST(d AS JSON) ELSE CAST('{}' AS JSON) END AS j FROM raw)"
    )


def _t(path: str, default: str = "''", j: str = "j") -> str:
    return f"CASE WHEN json_type({j}, '$.{path}') = 'VARCHAR' THEN {j} ->> '$.{path}' ELSE {default} END"


def _n(path: str, default: str = "0", as_type: str = "BIGINT", j: str = "j") -> str:
    kinds = "('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT')"
    return (
        f"CAST(CASE WHEN json_type({j}, '$.{path}') IN {kinds} THEN CAST({j} ->> '$.{path}' AS DOUBLE) "
        f"ELSE {default} END AS {as_type})"
    )


def _b(path: str, default: str = "false", j: str = "j") -> str:
    return f"CASE WHEN json_type({j}, '$.{path}') = 'BOOLEAN' THEN CAST({j} ->> '$.{path}' AS BOOLEAN) ELSE {default} END"


def one_of_sql(path: str, values: str, default: str, j: str = "j") -> str:
    return f"CASE WHEN json_type({j}, '$.{path}') = 'VARCHAR' AND {j} ->> '$.{path}' IN ({values}) THEN {j} ->> '$.{path}' ELSE {default} END"


def _list(path: str, kind: str, j: str = "j") -> str:
    """Members of an array that have one JSON type, as a DuckDB list; empty for anything else."""
    items = f"CASE WHEN json_type({j}, '$.{path}') = 'ARRAY' THEN CAST(json_extract({j}, '$.{path}') AS JSON[]) ELSE [] END"
    return f"list_filter({items}, lambda x: json_type(x) = '{kind}')"


def _strings(path: str, j: str = "j") -> str:
    return f"array_to_string(list_transform({_list(path, 'VARCHAR', j)}, lambda x: x ->> '$'), ',')"


_REQUEST_SQL = f"""event_id, {_t('id')} AS id, {_t('timestamp')} AS timestamp, {_t('upstream_id')} AS upstream_id, {_t('profile_id')} AS profile_id,
{_t('operation_id')} AS operation_id, {_t('target_host', "'-'")} AS target_host, {_t('method')} AS method,
{_n('request_bytes')} AS request_bytes, {_n('response_bytes')} AS response_bytes,
{_t('model', "'-'")} AS model, {one_of_sql('protection_mode', "'redacted', 'passthrough', 'disabled'", "'-'")} AS protection_mode,
{one_of_sql('gateway_type', "'proxy_gateway'", "'api_gateway'")} AS gateway_type, {_t('path')} AS path, {_n('status_code')} AS status_code,
{_n('duration_ms')} AS duration_ms, {_b('streaming')} AS streaming, {_n('entity_count')} AS entity_count, {_t('error_code', "'-'")} AS error_code"""

_USAGE_SQL = f"""CASE WHEN json_type(j, '$.token_usage') = 'OBJECT' THEN {_n('token_usage.input')} || '/' || {_n('token_usage.output')} || '/' ||
{_n('token_usage.total')} || '/' || coalesce(CAST(nullif({_n('token_usage.cached')}, 0) AS STRING), '-') ELSE 'none' END AS usage"""


def request_columns():
    dash = F.lit("-")
    return [
        "id", "timestamp", "upstream_id", "profile_id", "operation_id",
        F.coalesce("target_host", dash).alias("target_host"), "method", "request_bytes", "response_bytes",
        F.coalesce("model", dash).alias("model"),
        F.coalesce("protection_mode", dash).alias("protection_mode"),
        "gateway_type", "path", "status_code", "duration_ms", "streaming", "entity_count",
        F.coalesce("error_code", dash).alias("error_code"),
    ]


REQUEST_COLUMNS_SQL = _REQUEST_SQL.removeprefix("event_id, ")


@query("decode_requests", f"WITH {docs_sql('request')} SELECT {_REQUEST_SQL}, {_USAGE_SQL} FROM docs")
def decode_requests(spark, sf_dir):
    decoded = decode(json_documents(spark, sf_dir, "request"), "request", keep=["event_id"])
    usage = F.expr(
        "coalesce(concat_ws('/', token_usage.input, token_usage.output, token_usage.total, "
        "if(token_usage is null, null, coalesce(string(token_usage.cached), '-'))), '')"
    )
    shown = F.when(F.col("token_usage").isNull(), F.lit("none")).otherwise(usage)
    return decoded.select("event_id", *request_columns(), shown.alias("usage"))


def _headers_sql(side: str) -> str:
    path = f"$.{side}.headers"
    member = f"'{path}.\"' || k || '\"'"
    listed = f"list_filter(CAST(json_extract(j, {member}) AS JSON[]), lambda x: json_type(x) = 'VARCHAR')"
    return (
        f"CASE WHEN json_type(j, '{path}') = 'OBJECT' THEN array_to_string(list_transform(list_sort(json_keys(j, '{path}')), "
        f"lambda k: k || '=' || CASE WHEN json_type(j, {member}) = 'ARRAY' THEN array_to_string(list_transform({listed}, lambda x: x ->> '$'), ',') "
        "ELSE '' END), ';') ELSE 'none' END"
    )


_DETAIL_SQL = f"""SELECT event_id,
CASE WHEN json_type(j, '$.raw_request') = 'OBJECT' THEN {_t('raw_request.method')} || ' ' || {_t('raw_request.url')} || ' ' ||
  {_t('raw_request.body', "'-'")} ELSE 'none' END AS request, {_headers_sql('raw_request')} AS request_headers,
CASE WHEN json_type(j, '$.raw_response') = 'OBJECT' THEN {_n('raw_response.status')} || ' ' || {_t('raw_response.body', "'-'")} ELSE 'none' END AS response,
{_headers_sql('raw_response')} AS response_headers FROM docs"""


@query("decode_exchange", f"WITH {docs_sql('request')} {_DETAIL_SQL}")
def decode_exchange(spark, sf_dir):
    decoded = decode(json_documents(spark, sf_dir, "request"), "request_detail", keep=["event_id"])
    listed = "coalesce(array_join(transform(array_sort(map_entries({0}.headers)), e -> concat(e.key, '=', array_join(e.value, ','))), ';'), 'none')"
    request = "if(raw_request is null, 'none', concat_ws(' ', raw_request.method, raw_request.url, coalesce(raw_request.body, '-')))"
    response = "if(raw_response is null, 'none', concat(raw_response.status, ' ', coalesce(raw_response.body, '-')))"
    return decoded.select(
        "event_id", F.expr(request).alias("request"), F.expr(listed.format("raw_request")).alias("request_headers"),
        F.expr(response).alias("response"), F.expr(listed.format("raw_response")).alias("response_headers"),
    )


@query(
    "decode_fields",
    f"""WITH {docs_sql('request')}, fields AS (SELECT event_id, unnest({_list('fields', 'OBJECT')}) AS f FROM docs),
counted AS (SELECT event_id, f, {_list('entities', 'OBJECT', 'f')} AS es FROM fields)
SELECT event_id, {_t('path', j='f')} AS path, {_t('original_masked', j='f')} AS original_masked, {_t('redacted', j='f')} AS redacted, array_to_string(list_transform(es, lambda e:
  {_t('type', "'UNKNOWN'", 'e')} || '/' || {_t('replacement', "''", 'e')} || '/' || {_t('masked', "'-'", 'e')} || '/' ||
  {_n('confidence', as_type='DOUBLE', j='e')} || '/' || {_strings('sources', 'e')}), ' ') AS entities FROM counted""",
)
def decode_fields(spark, sf_dir):
    decoded = decode(json_documents(spark, sf_dir, "request"), "request_detail", keep=["event_id"])
    # An ``inline`` that is not outer would read the fields twice: for the rows, and to leave out empty lists before them.
    return decoded.select("event_id", F.inline_outer("fields")).filter("path IS NOT NULL").select(
        "event_id", "path", "original_masked", "redacted",
        F.expr(
            "array_join(transform(entities, e -> concat_ws('/', e.type, e.replacement, coalesce(e.masked, '-'), "
            "e.confidence, array_join(e.sources, ','))), ' ')"
        ).alias("entities"),
    )


@query(
    "decode_policy",
    f"""WITH {docs_sql('policy')} SELECT event_id, {_b('enabled', 'true')} AS enabled, {_b('redact_ai_answers')} AS redact_ai_answers,
{_b('redact_system_messages')} AS redact_system_messages,
array_to_string(list_transform({_list('entity_types', 'OBJECT')}, lambda e: {_t('type', j='e')} || '=' || ({_b('enabled', 'true', 'e')})), ' ') AS types,
array_to_string(list_transform({_list('rules', 'OBJECT')}, lambda e: {_t('id', j='e')} || '/' || {_t('pattern', j='e')} || '=' || ({_b('enabled', 'true', 'e')})), ' ') AS rules
FROM docs""",
)
def decode_policy_query(spark, sf_dir):
    decoded = decode(json_documents(spark, sf_dir, "policy"), "policy", keep=["event_id"])
    return decoded.select(
        "event_id", "enabled", "redact_ai_answers", "redact_system_messages",
        F.expr("array_join(transform(entity_types, e -> concat(e.type, '=', e.enabled)), ' ')").alias("types"),
        F.expr("array_join(transform(rules, e -> concat(e.id, '/', e.pattern, '=', e.enabled)), ' ')").alias("rules"),
    )


@query(
    "decode_settings",
    f"""WITH {docs_sql('settings')} SELECT event_id, {_b('record_request_content')} AS record_request_content, {_b('record_raw_request')} AS record_raw_request,
{_n('retention_days', '30')} AS retention_days, {_t('hf_base_url', "'-'")} AS hf_base_url, {_n('max_inference_tokens', '512')} AS max_inference_tokens,
{one_of_sql('inference_provider', "'auto', 'gpu'", "'cpu'")} AS inference_provider, {_b('entity_cache_enabled', 'true')} AS entity_cache_enabled,
{_n('entity_cache_ttl_seconds', '900')} AS entity_cache_ttl_seconds FROM docs""",
)
def decode_settings_query(spark, sf_dir):
    decoded = decode(json_documents(spark, sf_dir, "settings"), "settings", keep=["event_id"])
    return decoded.withColumn("hf_base_url", F.coalesce("hf_base_url", F.lit("-")))


@query(
    "decode_stats",
    f"""WITH {docs_sql('stats')} SELECT event_id, {_n('requests')} AS requests, {_n('entities')} AS entities, {_n('success_rate', as_type='DOUBLE')} AS success_rate,
{_n('average_latency_ms', as_type='DOUBLE')} AS average_latency_ms, {_n('streaming_requests')} AS streaming_requests,
{_n('token_input')} AS token_input, {_n('token_output')} AS token_output, {_n('token_total')} AS token_total, {_n('token_cached')} AS token_cached,
{_n('tokens_per_minute', as_type='DOUBLE')} AS tokens_per_minute, {one_of_sql('granularity', "'hour', 'day'", "'-'")} AS granularity,
CASE WHEN json_type(j, '$.entity_types') = 'OBJECT' THEN 'PIN=' || {_n('entity_types.PIN')} || ',URL=' || {_n('entity_types.URL')} ELSE '' END AS entity_types,
array_to_string(list_transform({_list('daily', 'OBJECT')}, lambda e: {_t('date', j='e')} || '/' || {_n('requests', j='e')} || '/' || {_n('entities', j='e')}), ' ') AS daily
FROM docs""",
)
def decode_stats_query(spark, sf_dir):
    decoded = decode(json_documents(spark, sf_dir, "stats"), "stats", keep=["event_id"])
    return decoded.select(
        "event_id", "requests", "entities", "success_rate", "average_latency_ms", "streaming_requests",
        "token_input", "token_output", "token_total", "token_cached", "tokens_per_minute",
        F.coalesce("granularity", F.lit("-")).alias("granularity"),
        F.expr("array_join(transform(array_sort(map_entries(entity_types)), e -> concat(e.key, '=', e.value)), ',')").alias("entity_types"),
        F.expr("array_join(transform(daily, e -> concat_ws('/', e.date, e.requests, e.entities)), ' ')").alias("daily"),
    )


_TEMPLATES = (
    "CASE WHEN json_type(j, '$.header_templates') = 'OBJECT' THEN array_to_string(list_transform(list_filter(json_keys(j, '$.header_templates'), "
    "lambda k: json_type(j, '$.header_templates.' || k) = 'VARCHAR'), lambda k: k || '=' || (j ->> ('$.header_templates.' || k))), ',') ELSE 'none' END"
)
_SHOWN_TEMPLATES = "coalesce(array_join(transform(map_entries(header_templates), e -> concat(e.key, '=', e.value)), ','), 'none')"


@query(
    "decode_result",
    f"""WITH {docs_sql('result')} SELECT event_id, {_t('text', "'sent ' || event_id")} AS text, {_t('scope_id')} AS scope_id,
{_n('replacement_count')} AS replacement_count, len({_list('entities', 'OBJECT')}) AS n_entities FROM docs""",
)
def decode_result(spark, sf_dir):
    sent = json_documents(spark, sf_dir, "result").withColumn("sent", F.concat(F.lit("sent "), F.col("event_id").cast("string")))
    found = redact_result(sent, "sent", keep=["event_id"])
    return found.select(
        "event_id", "text", "scope_id", "replacement_count", F.size("entities").cast("bigint").alias("n_entities")
    )


@query(
    "decode_profiles",
    f"""WITH {docs_sql('profiles')} SELECT event_id, {_t('id')} AS id, {_t('name', _t('id'))} AS name,
CASE WHEN json_type(j, '$.operations') = 'ARRAY' THEN CAST(json_extract(j, '$.operations') AS STRING) ELSE '[]' END AS operations,
{_TEMPLATES} AS header_templates FROM docs""",
)
def decode_profiles(spark, sf_dir):
    decoded = decode(json_documents(spark, sf_dir, "profiles"), "profiles", keep=["event_id"])
    return decoded.withColumn("header_templates", F.expr(_SHOWN_TEMPLATES))


@query(
    "decode_upstreams",
    f"""WITH {docs_sql('upstreams')} SELECT event_id, {_t('id')} AS id, {_t('base_url')} AS base_url, {_t('profile_id')} AS profile_id,
{one_of_sql('credential_mode', "'managed'", "'passthrough'")} AS credential_mode, {_t('api_key', "'-'")} AS api_key, {_b('enabled', 'true')} AS enabled, {_TEMPLATES} AS header_templates FROM docs""",
)
def decode_upstreams(spark, sf_dir):
    decoded = decode(json_documents(spark, sf_dir, "upstreams"), "upstreams", keep=["event_id"])
    return decoded.withColumns({"api_key": F.coalesce("api_key", F.lit("-")), "header_templates": F.expr(_SHOWN_TEMPLATES)})


@query(
    "decode_targets",
    f"""WITH {docs_sql('targets')} SELECT event_id, {_t('id')} AS id, {_strings('hosts')} AS hosts, {_t('profile_id')} AS profile_id, {_b('enabled')} AS enabled FROM docs""",
)
def decode_targets(spark, sf_dir):
    decoded = decode(json_documents(spark, sf_dir, "targets"), "targets", keep=["event_id"])
    return decoded.withColumn("hosts", F.array_join("hosts", ","))


# The string members of the map, in order of their names.
_LABELS = """CASE WHEN json_type(j, '$.manifest.entity_types') = 'OBJECT' THEN array_to_string(list_transform(list_filter(
  list_sort(json_keys(j, '$.manifest.entity_types')), lambda k: json_type(j, '$.manifest.entity_types."' || k || '"') = 'VARCHAR'),
  lambda k: k || '=' || (j ->> ('$.manifest.entity_types."' || k || '"'))), ',') ELSE 'none' END"""


@query(
    "decode_models",
    f"""WITH {docs_sql('models')} SELECT event_id, {_t('id')} AS id, {_b('valid')} AS valid, {_b('active')} AS active, {_b('built_in')} AS built_in,
{_t('manifest.name')} AS name, {_t('manifest.version')} AS version, {_t('manifest.quantization')} AS quantization,
{_n('manifest.max_tokens')} AS max_tokens, {_n('manifest.stride')} AS stride, {_t('manifest.label_scheme')} AS label_scheme,
{_LABELS} AS entity_types, {_strings('errors')} AS errors FROM docs""",
)
def decode_models(spark, sf_dir):
    decoded = decode(json_documents(spark, sf_dir, "models"), "models", keep=["event_id"])
    labels = "coalesce(array_join(transform(array_sort(map_entries(manifest.entity_types)), e -> concat(e.key, '=', e.value)), ','), 'none')"
    return decoded.select(
        "event_id", "id", "valid", "active", "built_in", "manifest.name", "manifest.version", "manifest.quantization",
        "manifest.max_tokens", "manifest.stride", "manifest.label_scheme",
        F.expr(labels).alias("entity_types"), F.array_join("errors", ",").alias("errors"),
    )
