"""Strict decoding: hand-computed cases."""

import json

import pytest

from hushlake.operators.decode import decode, decode_list


def one(spark, kind, document):
    text = document if isinstance(document, str) else json.dumps(document)
    return decode(spark.createDataFrame([(text,)], "json string"), kind).first().asDict(recursive=True)


def test_policy(spark):
    found = one(
        spark,
        "policy",
        {
            "redact_ai_answers": "true",
            "entity_types": [{"type": "URL"}, {"type": "URL", "enabled": False}, 5, None, [1], {"type": 7, "enabled": "no"}],
            "rules": [{"id": "a", "pattern": "x", "enabled": False}, "b"],
            "extra": 1,
        },
    )
    assert found == {
        "enabled": True,
        "redact_ai_answers": False,
        "redact_system_messages": False,
        "entity_types": [
            {"type": "URL", "enabled": True}, {"type": "URL", "enabled": False}, {"type": "", "enabled": True},
        ],
        "rules": [{"id": "a", "pattern": "x", "enabled": False}],
    }


@pytest.mark.parametrize("document", ["{broken", "[]", "null", "5", '"x"', ""])
def test_no_object_gives_all_defaults(spark, document):
    assert one(spark, "policy", document)["enabled"] is True
    settings = one(spark, "settings", document)
    assert settings == {
        "record_request_content": False, "record_raw_request": False, "retention_days": 30, "hf_base_url": None,
        "max_inference_tokens": 512, "inference_provider": "cpu", "entity_cache_enabled": True, "entity_cache_ttl_seconds": 900,
    }


def test_numbers(spark):
    def days(value):
        return one(spark, "settings", f'{{"retention_days": {value}}}')["retention_days"]

    assert [days(v) for v in ("7", "7.0", "7e0", "-1", "0")] == [7, 7, 7, -1, 0]
    assert [days(v) for v in ('"7"', "null", "true", "[7]", "{}", "1e999")] == [30] * 6
    assert one(spark, "entity", '{"confidence": 1e999}')["confidence"] == 0.0
    assert one(spark, "entity", '{"confidence": 0.25}')["confidence"] == 0.25


def test_entity_and_field(spark):
    assert one(spark, "entity", {}) == {"type": "UNKNOWN", "replacement": "", "confidence": 0.0, "sources": []}
    assert one(spark, "audit_entity", {"masked": 5, "sources": ["a", 1, None]})["masked"] is None
    field = one(spark, "field", {"path": "p", "entities": {"type": "X"}})
    assert field == {"path": "p", "original_masked": "", "redacted": "", "entities": []}


def test_request_detail(spark):
    found = one(
        spark,
        "request_detail",
        {
            "id": "r1", "protection_mode": "other", "gateway_type": "x", "status_code": "200",
            "token_usage": {"input": 1, "cached": 0}, "model": None,
            "fields": [{"path": "p", "entities": [{"type": "A"}, 1]}, "x"],
            "raw_request": {"method": "GET", "headers": {"a": ["1", 2], "b": "x"}, "body": None},
            "raw_response": [],
        },
    )
    assert found["protection_mode"] is None and found["gateway_type"] == "api_gateway" and found["status_code"] == 0
    assert found["token_usage"] == {"input": 1, "output": 0, "total": 0, "cached": None}
    assert [f["path"] for f in found["fields"]] == ["p"] and len(found["fields"][0]["entities"]) == 1
    assert found["raw_request"] == {"method": "GET", "url": "", "headers": {"a": ["1"], "b": []}, "body": None}
    assert found["raw_response"] is None and found["model"] is None


def test_usage_is_null_unless_an_object(spark):
    for usage in (None, 5, [], "x"):
        assert one(spark, "request", {"token_usage": usage})["token_usage"] is None
    assert one(spark, "request", {"token_usage": {"cached": 3}})["token_usage"]["cached"] == 3


def test_providers_targets_profiles_models(spark):
    assert one(spark, "upstreams", {"id": "u", "credential_mode": "managed"})["credential_mode"] == "managed"
    assert one(spark, "upstreams", {"enabled": "no", "credential_mode": 1}) == {
        "id": "", "base_url": "", "profile_id": "", "credential_mode": "passthrough", "api_key": None,
        "header_templates": None, "enabled": True,
    }
    assert one(spark, "targets", {"hosts": ["a", 1]}) == {"id": "", "hosts": ["a"], "profile_id": "", "enabled": False}
    assert one(spark, "profiles", {"id": "p", "name": 5, "operations": [1, {"a": 2}], "header_templates": {"k": "v", "n": 1}}) == {
        "id": "p", "name": "p", "operations": '[1,{"a":2}]', "header_templates": {"k": "v"},
    }
    model = one(spark, "models", {"id": "m", "manifest": "none", "errors": None})
    assert model["manifest"] == {
        "name": "", "version": "", "quantization": "", "max_tokens": 0, "stride": 0, "label_scheme": "", "entity_types": None,
    }
    assert model["errors"] == [] and model["active"] is False


def test_stats(spark):
    found = one(spark, "stats", {"entity_types": {"A": 1, "B": "x"}, "daily": [{"date": 1}, 2], "granularity": "week"})
    assert found["entity_types"] == {"A": 1, "B": 0}
    assert found["daily"] == [{"date": "", "requests": 0, "entities": 0}] and found["granularity"] is None
    assert one(spark, "stats", {"entity_types": []})["entity_types"] == {}


def test_last_of_equal_keys_wins(spark):
    assert one(spark, "targets", '{"id": "a", "id": "b"}')["id"] == "b"


def test_lists(spark):
    text = json.dumps({"upstreams": [{"id": "a"}, 5, {"id": "b", "enabled": False}]})
    rows = decode_list(spark.createDataFrame([(text,), ("[]",)], "json string"), "upstreams", "upstreams").collect()
    assert [(r.pos, r.id, r.enabled) for r in rows] == [(0, "a", True), (1, "b", False)]


@pytest.mark.parametrize(
    "json_text, fine",
    [
        ('{"id": "x"}', True), (' {"id": "x"}\n', True), ('{"id": "x"} y', False), ('{"id": "x"}{"id": "y"}', False),
        ('{"id": "x"}, {"id": "y"}', False), ('{"id": "x"}], [2', False), ('{"id": "x"}}, {"a": 1', False), ("{'id': 'x'}", False),
        ('{"id": "x", "n": NaN}', False), ('{"id": "x"', False), ('{"id": "x",}', False), ("", False), (",", False), (None, False),
    ],
)
def test_only_whole_json_is_decoded(spark, json_text, fine):
    df = spark.createDataFrame([(json_text,)], "json string")
    assert decode(df, "upstreams").first().id == ("x" if fine else "")


def _parsers(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("parseJson")


def test_a_text_is_parsed_once_though_its_list_is_taken_apart(spark, sf_dir):
    """Spark infers a filter from an explode, which must not hold the parsing again, nor run it before the rows are dealt out."""
    from hushlake.plans.catalog import QUERIES

    docs = spark.createDataFrame([(1, '{"rules": [{"id": "a"}, 5, null, [], "x", {"id": 7}]}'), (2, '{"rules": []}'), (3, "{")], "n long, json string")
    exploded = decode(docs, "policy", keep=["n"]).selectExpr("n", "inline(rules)")
    assert [(r.n, r.id) for r in exploded.collect()] == [(1, "a"), (1, "")]
    listed = decode_list(docs, "policy", "rules", keep=["n"])
    assert [(r.n, r.pos, len(r.rules)) for r in listed.collect()] == [(1, 0, 0), (1, 1, 0)]
    for df in (exploded, listed, QUERIES["decode_fields"](spark, sf_dir)):
        assert _parsers(df) == 1
