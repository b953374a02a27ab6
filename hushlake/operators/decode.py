"""Documents to typed columns, with the documented default for whatever is missing or wrong.

A document type is a table of members, each with what reads it. Objects are
taken apart once and their members read from there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.functions import variants as V
from hushlake.functions.once import compute_once

# What reads a member, given the opened object and the member's name.
Reader = Callable[[Column, str], Column]
Shape = dict[str, Reader]


def text(default: str = "") -> Reader:
    return lambda o, name: V.text(o[name], default)


def text_or_null(o: Column, name: str) -> Column:
    return V.optional_text(o[name])


def text_or_member(other: str) -> Reader:
    """Another member's text stands in for a missing one."""
    return lambda o, name: V.text(o[name], V.text(o[other]))


def one_of(*allowed: str, default: str | None) -> Reader:
    def read(o: Column, name: str) -> Column:
        value = V.optional_text(o[name])
        return F.when(value.isin(*allowed), value).otherwise(F.lit(default))

    return read


def count(default: int = 0) -> Reader:
    return lambda o, name: V.number(o[name], default)


def count_or_null(o: Column, name: str) -> Column:
    """Zero counts as missing."""
    return F.nullif(V.number(o[name]), F.lit(0).cast("bigint"))


def real(o: Column, name: str) -> Column:
    return V.number(o[name], as_type="double")


def flag(default: bool = False) -> Reader:
    return lambda o, name: V.boolean(o[name], default)


def strings(o: Column, name: str) -> Column:
    return V.string_list(o[name])


def string_map(o: Column, name: str) -> Column:
    return V.string_map(o[name])


def headers(o: Column, name: str) -> Column:
    return V.header_map(o[name])


def counts_by_name(o: Column, name: str) -> Column:
    return V.number_map(o[name])


def opaque_list(o: Column, name: str) -> Column:
    """A list kept as JSON text."""
    return F.when(V.kind(o[name]).startswith("ARRAY"), F.to_json(o[name])).otherwise("[]")


def built(shape: Shape, opened: Column) -> Column:
    """The typed struct of an opened object; all defaults for a null one."""
    return F.struct(*[read(opened, name).alias(name) for name, read in shape.items()])


def object_or_null(shape: Shape) -> Reader:
    return lambda o, name: V.bind(V.open_record(o[name], shape), lambda x: built(shape, x))


def object_or_defaults(shape: Shape) -> Reader:
    return lambda o, name: V.bind(
        F.coalesce(V.open_record(o[name], shape), V.open_json(F.lit("{}"), shape)), lambda x: built(shape, x)
    )


def objects(shape: Shape) -> Reader:
    """The objects of a list; other members are dropped."""
    return lambda o, name: F.transform(V.open_records(o[name], shape), lambda x: built(shape, x))


SWITCH: Shape = {"type": text(), "enabled": flag(True)}
RULE: Shape = {"id": text(), "pattern": text(), "enabled": flag(True)}
POLICY: Shape = {
    "enabled": flag(True),
    "redact_ai_answers": flag(),
    "redact_system_messages": flag(),
    "entity_types": objects(SWITCH),
    "rules": objects(RULE),
}
SETTINGS: Shape = {
    "record_request_content": flag(),
    "record_raw_request": flag(),
    "retention_days": count(30),
    "hf_base_url": text_or_null,
    "max_inference_tokens": count(512),
    "inference_provider": one_of("auto", "gpu", default="cpu"),
    "entity_cache_enabled": flag(True),
    "entity_cache_ttl_seconds": count(900),
}
BUCKET: Shape = {"date": text(), "requests": count(), "entities": count()}
STATS: Shape = {
    "requests": count(),
    "entities": count(),
    "success_rate": real,
    "average_latency_ms": real,
    "streaming_requests": count(),
    "entity_types": counts_by_name,
    "daily": objects(BUCKET),
    "token_input": count(),
    "token_output": count(),
    "token_total": count(),
    "token_cached": count(),
    "tokens_per_minute": real,
    "granularity": one_of("hour", "day", default=None),
}
ENTITY: Shape = {"type": text("UNKNOWN"), "replacement": text(), "confidence": real, "sources": strings}
AUDIT_ENTITY: Shape = {
    "type": text("UNKNOWN"),
    "replacement": text(),
    "masked": text_or_null,
    "confidence": real,
    "sources": strings,
}
FIELD: Shape = {"path": text(), "original_masked": text(), "redacted": text(), "entities": objects(AUDIT_ENTITY)}
USAGE: Shape = {"input": count(), "output": count(), "total": count(), "cached": count_or_null}
RAW_REQUEST: Shape = {"method": text(), "url": text(), "headers": headers, "body": text_or_null}
RAW_RESPONSE: Shape = {"status": count(), "headers": headers, "body": text_or_null}
REQUEST: Shape = {
    "id": text(),
    "timestamp": text(),
    "upstream_id": text(),
    "profile_id": text(),
    "operation_id": text(),
    "model": text_or_null,
    "protection_mode": one_of("redacted", "passthrough", "disabled", default=None),
    "gateway_type": one_of("proxy_gateway", default="api_gateway"),
    "target_host": text_or_null,
    "method": text(),
    "path": text(),
    "status_code": count(),
    "duration_ms": count(),
    "streaming": flag(),
    "request_bytes": count(),
    "response_bytes": count(),
    "entity_count": count(),
    "token_usage": object_or_null(USAGE),
    "error_code": text_or_null,
}
REQUEST_DETAIL: Shape = {
    **REQUEST,
    "fields": objects(FIELD),
    "raw_request": object_or_null(RAW_REQUEST),
    "raw_response": object_or_null(RAW_RESPONSE),
}
RESULT: Shape = {"text": text_or_null, "scope_id": text(), "replacement_count": count(), "entities": objects(ENTITY)}
PROFILE: Shape = {
    "id": text(),
    "name": text_or_member("id"),
    "operations": opaque_list,
    "header_templates": string_map,
}
UPSTREAM: Shape = {
    "id": text(),
    "base_url": text(),
    "profile_id": text(),
    "credential_mode": one_of("managed", default="passthrough"),
    "api_key": text_or_null,
    "header_templates": string_map,
    "enabled": flag(True),
}
TARGET: Shape = {"id": text(), "hosts": strings, "profile_id": text(), "enabled": flag()}
MANIFEST: Shape = {
    "name": text(),
    "version": text(),
    "quantization": text(),
    "max_tokens": count(),
    "stride": count(),
    "label_scheme": text(),
    "entity_types": string_map,
}
MODEL: Shape = {
    "id": text(),
    "valid": flag(),
    "active": flag(),
    "built_in": flag(),
    "manifest": object_or_defaults(MANIFEST),
    "errors": strings,
}

SHAPES: dict[str, Shape] = {
    "policy": POLICY,
    "settings": SETTINGS,
    "stats": STATS,
    "entity": ENTITY,
    "audit_entity": AUDIT_ENTITY,
    "field": FIELD,
    "usage": USAGE,
    "raw_request": RAW_REQUEST,
    "raw_response": RAW_RESPONSE,
    "request": REQUEST,
    "request_detail": REQUEST_DETAIL,
    "result": RESULT,
    "profiles": PROFILE,
    "upstreams": UPSTREAM,
    "targets": TARGET,
    "models": MODEL,
}


def decode(df: DataFrame, kind: str, json: str = "json", keep: list[str] | None = None) -> DataFrame:
    """Decode a column of JSON text; the members of the document become columns.

    Members that are not used later are not read from the text. A text is parsed once, whatever filters follow,
    also those that Spark infers from an ``inline`` or ``explode`` of a member.
    """
    shape, kept = SHAPES[kind], keep or []
    opened = compute_once(df.select(*kept, F.col(json).alias("__json")), {"__opened": V.open_json(F.col("__json"), shape)}, ["__json"])
    return opened.select(*kept, *[read(F.col("__opened"), name).alias(name) for name, read in shape.items()])


def decode_list(df: DataFrame, kind: str, member: str, json: str = "json", keep: list[str] | None = None) -> DataFrame:
    """Decode the objects of one list of a JSON document, one row each, with their place ``pos``."""
    shape, kept = SHAPES[kind], keep or []
    # From an explode that is not outer, Spark infers a filter that holds the parsing once more, and moves it to the scan.
    opened = df.select(*kept, V.open_records(V.open_json(F.col(json), [member])[member], shape).alias("__items"))
    apart = opened.select(*kept, F.posexplode_outer("__items").alias("pos", "__opened")).filter("pos IS NOT NULL")
    return apart.select(*kept, "pos", *[read(F.col("__opened"), name).alias(name) for name, read in shape.items()])


def redact_result(df: DataFrame, source: str, json: str = "json", keep: list[str] | None = None) -> DataFrame:
    """Results of masking calls. Where an answer has no text, the text that was sent stands in for it."""
    decoded = decode(df, "result", json, [*(keep or []), source])
    return decoded.withColumn("text", F.coalesce("text", source)).drop(*({source} - set(keep or [])))
