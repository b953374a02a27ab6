"""Texts of request bodies by the paths of their profiles."""

import json

import pytest

from hushlake.operators.decode import decode
from hushlake.operators.fields import ANY_PATHS, BLOCK_PATHS, CHAT_PATHS, RESPONSE_PATHS, extract_fields, field_audit, operation_paths, profile_paths
from hushlake.operators.mask import Policy
from hushlake.operators.rules import Rule

BODY = {
    "system": [{"type": "text", "text": "sys"}],
    "instructions": "be kind",
    "input": [{"role": "user", "content": [{"type": "input_text", "text": "in"}]}, {"type": "function_call_output", "output": "out"}],
    "messages": [
        {"role": "user", "content": [{"type": "image", "source": "x"}, {"text": "hi"}, {"content": [{"text": "deep"}]}]},
        {"role": "assistant", "content": "yo", "tool_calls": [{"function": {"name": "n", "arguments": "{}"}}]},
        {"role": "user", "content": None},
        {"content": [{"input": {"a b": {"c": ["x", 1, {"d'e": "y"}]}}}]},
    ],
}


def found(spark, paths, body=BODY, profile="p", **more):
    text = body if isinstance(body, str) or body is None else json.dumps(body)
    requests = spark.createDataFrame([(1, profile, text)], "k int, profile_id string, body string")
    rows = extract_fields(requests, ["k"], profile_paths(spark, {"p": paths}), **more).collect()
    return sorted(((r.path, r.role, r.text) for r in rows), key=lambda r: r[0])


def test_parts_tool_and_system_texts(spark):
    assert found(spark, CHAT_PATHS) == [
        ("messages[0].content[1].text", "user", "hi"), ("messages[1].content", "assistant", "yo"),
        ("messages[1].tool_calls[0].function.arguments", "assistant", "{}"),
    ]
    blocks = found(spark, BLOCK_PATHS)
    assert ("system[0].text", "system", "sys") in blocks
    assert ("messages[0].content[2].content[0].text", "tool", "deep") in blocks
    assert ("messages[3].content[0].input['a b'].c[2]['d\\'e']", None, "y") in blocks
    assert found(spark, RESPONSE_PATHS) == [
        ("input[0].content[0].text", "user", "in"), ("input[1].output", "tool", "out"), ("instructions", "system", "be kind"),
    ]


def test_wildcards(spark):
    assert found(spark, [("*.text", None)], {"a": {"text": "x"}, "b c": {"text": "y"}, "text": "z"}) == [
        ("['b c'].text", None, "y"), ("a.text", None, "x"),
    ]
    assert found(spark, [("a[1].t", "r")], {"a": [{"t": "x"}, {"t": "y"}]}) == [("a[1].t", "r", "y")]
    assert found(spark, ANY_PATHS, '"whole"') == [("", None, "whole")]
    nested = "x"
    for _ in range(20):
        nested = {"n": nested}
    assert found(spark, ANY_PATHS, nested) == []
    assert found(spark, ANY_PATHS, nested, depth=20) == [(".".join("n" * 20), None, "x")]


@pytest.mark.parametrize("body", [None, "", "[1", "5", "{}", "[]", "null"])
def test_bodies_without_texts(spark, body):
    assert found(spark, ANY_PATHS, body) == []


def test_unknown_profiles_and_empty_tables(spark):
    assert found(spark, CHAT_PATHS, profile="other") == [] and found(spark, CHAT_PATHS, profile=None) == []
    assert found(spark, []) == []


def test_a_path_that_cannot_be_read_is_refused(spark):
    with pytest.raises(ValueError):
        found(spark, [("messages[x].content", None)])


def test_profiles_are_data(spark):
    documents = [
        {"id": "p", "operations": [{"path": "q", "role": "system"}, {"path": "r"}, {"path": 7}, {"path": ""}, "s"]},
        {"id": "none", "operations": "q"},
    ]
    rows = spark.createDataFrame([(json.dumps(d),) for d in documents], "json string")
    paths = operation_paths(decode(rows, "profiles"))
    assert sorted(map(tuple, paths.collect())) == [("p", "q", "system"), ("p", "r", None)]


def test_one_scan_and_no_shuffle(spark, tmp_path):
    spark.createDataFrame([(1, "p", json.dumps(BODY), "wide")], "k int, profile_id string, body string, other string").write.parquet(f"{tmp_path}/r")
    fields = extract_fields(spark.read.parquet(f"{tmp_path}/r"), ["k"], profile_paths(spark, {"p": CHAT_PATHS}))
    audit = field_audit(fields, [Rule("HI", "hi")], ["k"], "k")
    plan = audit._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "other" not in plan
    assert plan.count("Exchange") == plan.count("BroadcastExchange")


def test_list_of_parts_is_masked(spark):
    requests = spark.createDataFrame([(1, "p", json.dumps(BODY))], "k int, profile_id string, body string")
    fields = extract_fields(requests, ["k"], profile_paths(spark, {"p": BLOCK_PATHS}))
    rules = [Rule("SHORT", "hi|deep|sys|yo")]
    masked = {r.path for r in field_audit(fields, rules, ["k"], "k").collect() if r.entities}
    assert masked == {"messages[0].content[1].text", "messages[0].content[2].content[0].text"}
    everything = field_audit(fields, rules, ["k"], "k", Policy(redact_ai_answers=True, redact_system_messages=True))
    assert {r.path for r in everything.collect() if r.entities} == masked | {"system[0].text", "messages[1].content"}
