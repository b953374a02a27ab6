"""Log texts, labels, annotation: hand-computed cases."""

import random
import time

import pytest
from pyspark.sql import functions as F

from hushlake.functions import text as T
from hushlake.functions.labels import label_types
from hushlake.operators.annotate import annotate_all, annotate_first
from hushlake.operators.client_log import sanitize_client_log


def apply(spark, function, value, type_="string"):
    return spark.createDataFrame([(value,)], f"v {type_}").select(function(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "text, clean",
    [
        (None, None),
        ("", ""),
        ("Authorization: Bearer abc.def, next", "Authorization: Bearer [REDACTED], next"),
        ("AUTHORIZATION = bearer  xyz;rest", "AUTHORIZATION = bearer  [REDACTED];rest"),
        ("authorization: bearer abc", "authorization: bearer [REDACTED]"),
        ("API_KEY=1 api-key: 2, apikey=3;", "API_KEY=[REDACTED] api-key: [REDACTED], apikey=[REDACTED];"),
        ("Password : p@ss　word", "Password : [REDACTED]　word"),
        ("sk-abc_1-2 xsk-3 ésk-4", "[REDACTED] xsk-3 é[REDACTED]"),
        ("Bearer a~b bearer c", "[REDACTED] bearer c"),
        ("token\x0b=\x0bv", "token\x0b=\x0b[REDACTED]"),
        ("nothing here", "nothing here"),
    ],
)
def test_sanitize(spark, text, clean):
    assert apply(spark, T.sanitize, text) == clean


def test_limit_comes_before_sanitize(spark):
    text = "x" * 7990 + " token=abcdefgh"
    cut = apply(spark, T.limit_field, text)
    assert cut == text[:8000] + "…" and len(cut) == 8001
    assert apply(spark, lambda c: T.sanitize(T.limit_field(c)), text) == "x" * 7990 + " token=[REDACTED]"
    assert apply(spark, T.limit_field, "y" * 8000) == "y" * 8000


@pytest.mark.parametrize(
    "n, shown", [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.3 KB"), (1331, "1.3 KB"), (5 * 1024**2, "5120.0 KB")]
)
def test_bytes(spark, n, shown):
    assert apply(spark, T.format_bytes, n, "bigint") == shown


def test_headers(spark):
    shown = apply(spark, T.format_headers, {"a": ["1", "2"], "b": []}, "map<string,array<string>>")
    assert shown.split("\n") == ["a: 1, 2", "b: "]
    assert apply(spark, T.format_headers, None, "map<string,array<string>>") == "—"
    assert apply(spark, T.format_headers, {}, "map<string,array<string>>") == "—"


def test_hidden_value_and_trim(spark):
    assert apply(spark, T.hide_value, "secret") == "s*****"
    assert apply(spark, T.hide_value, "") == ""
    assert apply(spark, T.js_trim, "﻿　 a b ") == "a b"


def test_client_log(spark):
    rows = [
        (1, '"token=abc"', "", "stack sk-1", None, "http://x"),
        (2, '""', "TypeError", None, None, None),
        (3, '""', None, None, None, None),
        (4, '{"password":"x","n":1}', None, None, "Bearer z", None),
    ]
    df = spark.createDataFrame(rows, "id int, error string, error_name string, stack string, component_stack string, source string")
    out = {r.id: r for r in sanitize_client_log(df).collect()}
    assert (out[1].message, out[1].stack, out[1].component_stack) == ("token=[REDACTED]", "stack [REDACTED]", None)
    assert out[2].message == "TypeError" and out[3].message == "Unknown error"
    assert out[4].component_stack == "[REDACTED]"
    assert out[4].message.startswith("{") and '"n":1' in out[4].message


def test_labels(spark):
    rows = [("en", "person"), ("de", " PIN "), ("ja", "Weird"), ("zh", " "), ("en", "IP_ADDRESS")]
    out = label_types(spark.createDataFrame(rows, "locale string, type string")).collect()
    assert {(r.locale, r.type): r.label for r in out} == {
        ("en", "person"): "Person name",
        ("de", " PIN "): "PIN",
        ("ja", "Weird"): "Weird",
        ("zh", " "): "自定义实体",
        ("en", "IP_ADDRESS"): "IP address",
    }


def marks(spark, function, text, entities):
    schema = "text string, entities array<struct<type string, replacement string>>"
    return [tuple(p) for p in spark.createDataFrame([(text, entities)], schema).select(function("text", "entities")).first()[0]]


def test_annotate_all(spark):
    entities = [("A", "a.b"), ("B", "a.bc"), ("C", "[z]"), ("E", ""), ("F", "a.b")]
    assert marks(spark, annotate_all, "a.bc [z]axb a.b", entities) == [
        ("", None), ("a.bc", "B"), (" ", None), ("[z]", "C"), ("axb ", None), ("a.b", "F"), ("", None),
    ]
    assert marks(spark, annotate_all, "abc", []) == [("abc", None)]
    assert marks(spark, annotate_all, "abc", None) == [("abc", None)]
    odd = [("X", r"\d$1"), ("Y", "(q)|{2}")]
    assert [p for p in marks(spark, annotate_all, r"1 \d$1 (q)|{2}", odd) if p[1]] == [(r"\d$1", "X"), ("(q)|{2}", "Y")]


def test_annotate_first(spark):
    assert marks(spark, annotate_first, "x x x", [("A", "x"), ("B", "x")]) == [
        ("", None), ("x", "A"), (" ", None), ("x", "B"), (" x", None),
    ]
    # Two unmarked parts: the next entity is marked once in each of them.
    assert marks(spark, annotate_first, "y x y", [("A", "x"), ("B", "y"), ("C", "")]) == [
        ("", None), ("y", "B"), (" ", None), ("x", "A"), (" ", None), ("y", "B"), ("", None),
    ]
    assert marks(spark, annotate_first, "abc", None) == [("abc", None)]


def test_parts_put_together_are_the_text(spark):
    text, entities = "ab<A:1>ba<A:1>", [("A", "<A:1>"), ("B", "b")]
    for function in (annotate_all, annotate_first):
        assert "".join(p for p, _ in marks(spark, function, text, entities)) == text


def one_by_one(text, entities):
    """The rule as it is stated."""
    parts = [(text, None)]
    for type_, replacement in entities:
        if replacement:
            cut = []
            for part, mark in parts:
                at = part.find(replacement) if mark is None else -1
                cut += [(part, mark)] if at < 0 else [(part[:at], None), (replacement, type_), (part[at + len(replacement) :], None)]
            parts = cut
    return parts


@pytest.mark.parametrize(
    "words, replacements",
    [
        (["<A:1>", "<B:2>", "<C:3>", "<D>", "x", "<", "> "], ["<A:1>", "<B:2>", "<C:3>", "<D>", ""]),
        (["cc+", "q.", "z", " ", "é\n"], ["cc+", "q.", "z", "é"]),
        (["ab", "ba", "c", "+(", "q"], ["ab", "ba", "a", "bb", "c", "+("]),
    ],
)
def test_annotate_first_equals_the_stated_rule(spark, words, replacements):
    """Closed shapes, open ones that cannot overlap, and ones that do; lists too short, too long and with other types."""
    rng = random.Random(len(words))
    rows = []
    for i in range(500):
        text = "".join(rng.choice(words) for _ in range(rng.randint(0, 30)))
        rows.append((i, text, [(f"T{rng.randint(0, 3)}", rng.choice(replacements)) for _ in range(rng.randint(0, 12))]))
    schema = "i int, text string, entities array<struct<type string, replacement string>>"
    found = spark.createDataFrame(rows, schema).select("i", annotate_first("text", "entities").alias("parts")).collect()
    assert {r.i: [tuple(p) for p in r.parts] for r in found} == {i: one_by_one(text, listed) for i, text, listed in rows}


def test_annotate_first_is_nearly_linear(spark):
    """Eight times the entities take nowhere near sixty-four times as long."""
    schema = "text string, entities array<struct<type string, replacement string>>"

    def seconds(n):
        listed = [("E", f"<E:{i:04X}>") for i in range(n)]
        df = spark.createDataFrame([(" and here ".join(r for _, r in listed), listed)], schema)
        took = []
        for _ in range(3):
            start = time.perf_counter()
            assert df.select(F.size(annotate_first("text", "entities"))).first()[0] == 2 * n + 1
            took.append(time.perf_counter() - start)
        return min(took)

    assert seconds(4000) < 4 * seconds(500) + 0.5
