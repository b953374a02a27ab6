"""Detection, merging and masking against plain Python on small fixtures."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from hushlake.operators.detect import PLACEHOLDER, chunk_text, detect_distinct, detect_rules, with_spans
from hushlake.operators.mask import Policy, mask, mask_conversations, mask_fast, residual_matches
from hushlake.operators.rules import Rule, checked, group_count, load_rules, may_match, rules_frame
from hushlake.operators.spans import SPAN_COLUMNS, detect_external, filter_types, merge_spans
from hushlake.plans.tables import RULES

OVERLAPPING = [
    Rule("NAMED", r"(?:key|pin)=\S+"),
    Rule("DIGITS", r"[0-9]{2,}"),
    Rule("WORD", r"[a-c]{3,}"),
    Rule("MIXED", r"[0-9a-c]{4}"),
]


def spans_of(text, rules):
    """All matches outside placeholders: (start, end, position of the rule)."""
    found, at = [], 0
    for piece in re.split(f"({PLACEHOLDER})", text):
        if not re.fullmatch(PLACEHOLDER, piece):
            for pos, rule in enumerate(rules):
                found += [(at + m.start(), at + m.end(), pos) for m in re.finditer(rule.pattern, piece)]
        at += len(piece)
    return sorted(found)


def islands_of(spans):
    out = []
    for start, end, pos in spans:
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), [*out[-1][2], (pos, start - end, start)])
        else:
            out.append((start, end, [(pos, start - end, start)]))
    return out


def masked_by_hand(text, scope, rules):
    result, at = "", 0
    islands = islands_of(spans_of(text, rules))
    for start, end, members in islands:
        name = rules[min(members)[0]].id
        digest = hashlib.sha256(f"{scope}|{name}|{text[start:end]}".encode()).hexdigest()[:4].upper()
        result += text[at:start] + f"<MASK_{name}:{digest}>"
        at = end
    return result + text[at:], len(islands)


def random_text(rng, length):
    parts = ["key=", "pin=", "abc", "ab", "c", "12", "3", "7", " ", " ", ".", "é", "😀", "\n", "<MASK_X:0AF1>", "<A:12>"]
    return "".join(rng.choice(parts) for _ in range(length))


def test_masking_equals_plain_python(spark):
    rng = random.Random(7)
    texts = [random_text(rng, rng.choice([0, 1, 5, 20, 60])) for _ in range(400)]
    texts += [random_text(rng, 6000) for _ in range(4)]  # many spans: blocks of the scan and of the text
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = {r.id: r for r in mask(df, OVERLAPPING, "id").collect()}
    for i, text in enumerate(texts):
        expected, count = masked_by_hand(text, i, OVERLAPPING)
        assert rows[i].text == expected
        assert rows[i].replacement_count == count == len(rows[i].entities)
    assert max(r.replacement_count for r in rows.values()) > 500


def test_span_table_equals_plain_python(spark):
    rng = random.Random(11)
    texts = [random_text(rng, 40) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    spans = detect_rules(df, OVERLAPPING, ["id"])
    found = {(r.id, r.start, r.end, r.pos) for r in spans.collect()}
    assert found == {(i, *s) for i, text in enumerate(texts) for s in spans_of(text, OVERLAPPING)}
    assert all(texts[r.id][r.start : r.end] == r.value for r in spans.collect())
    merged = {(r.id, r.start, r.end, r.type) for r in merge_spans(spans, ["id"]).collect()}
    assert merged == {
        (i, s, e, OVERLAPPING[min(m)[0]].id)
        for i, text in enumerate(texts)
        for s, e, m in islands_of(spans_of(text, OVERLAPPING))
    }


def test_masking_is_idempotent_and_leaves_nothing(spark):
    df = spark.createDataFrame(
        [(1, "mail a@b.org, token = a@b.org and 10.0.0.1"), (2, None), (3, ""), (4, "clean")], "id long, text string"
    )
    once = mask(df, RULES, "id").select("id", "text")
    twice = mask(once, RULES, "id").select("id", "text")
    assert sorted(once.collect()) == sorted(twice.collect())
    assert {r.residual for r in residual_matches(once, RULES).collect()} == {0}
    assert {r.residual for r in residual_matches(df, RULES).collect()} == {0, 4}


def test_sample_sentence(spark):
    text = "write to kim.lee+x@mail.example.com or call +44 (020) 555-0199 from 203.0.113.9."
    row = mask(spark.createDataFrame([(1, text)], "id long, text string"), RULES, "id").first()
    assert re.fullmatch(
        r"write to <MASK_EMAIL_ADDRESS:[0-9A-F]{4}> or call <MASK_PHONE_NUMBER:[0-9A-F]{4}> from <MASK_IP_ADDRESS:[0-9A-F]{4}>\.",
        row.text,
    )
    assert [e.type for e in row.entities] == ["EMAIL_ADDRESS", "PHONE_NUMBER", "IP_ADDRESS"]
    assert row.scope_id == "1"


def test_merge_cases(spark):
    rows = [
        ("identical", 0, 5, "A", "m1", 0.5), ("identical", 0, 5, "A", "m2", 0.75),
        ("nested", 0, 10, "A", "m1", 0.5), ("nested", 2, 4, "B", "m1", 0.25),
        ("chain", 0, 4, "A", "m1", 0.5), ("chain", 3, 8, "B", "m1", 0.5), ("chain", 7, 9, "C", "m1", 0.5),
        ("touching", 0, 4, "A", "m1", 0.5), ("touching", 4, 8, "B", "m1", 0.5),
    ]
    external = spark.createDataFrame(rows, "k string, start int, end int, type string, source string, confidence double")
    none = detect_rules(spark.createDataFrame([("x", "")], "k string, text string"), RULES, ["k"])
    merged = merge_spans(detect_external(none, external, ["k"]), ["k"]).orderBy("k", "start").collect()
    assert [(r.k, r.start, r.end, r.type, r.sources, r.confidence) for r in merged] == [
        ("chain", 0, 9, "B", ["m1"], 0.5),
        ("identical", 0, 5, "A", ["m1", "m2"], 0.75),
        ("nested", 0, 10, "A", ["m1"], 0.5),
        ("touching", 0, 4, "A", ["m1"], 0.5),
        ("touching", 4, 8, "B", ["m1"], 0.5),
    ]


def test_external_entities_keep_their_format_and_rules_win(spark):
    df = spark.createDataFrame([(1, "Ann Lee a@b.org")], "id long, text string")
    external = spark.createDataFrame(
        [(1, 0, 7, "PERSON", "model:a", 0.5), (1, 8, 11, "PERSON", "model:a", 0.5), (1, 9, 99, "URL", "model:a", 0.5)],
        "id long, start int, end int, type string, source string, confidence double",
    )
    row = mask(df, RULES, "id", external=external, keys=["id"]).first()
    assert re.fullmatch(r"<PERSON:[0-9A-F]{4}> <MASK_EMAIL_ADDRESS:[0-9A-F]{4}>", row.text)
    assert row.entities[1].sources == ["model:a", "rule:EMAIL_ADDRESS"]


def test_type_switches_spare_rules(spark):
    df = spark.createDataFrame([(1, "a@b.org")], "id long, text string")
    external = spark.createDataFrame(
        [(1, 0, 2, "EMAIL_ADDRESS", "m", 0.5)], "id long, start int, end int, type string, source string, confidence double"
    )
    both = detect_external(detect_rules(df, RULES, ["id"]), external, ["id"])
    types = spark.createDataFrame([("EMAIL_ADDRESS", False)], "type string, enabled boolean")
    assert [r.external for r in filter_types(both, types).collect()] == [False]
    assert filter_types(external, types).count() == 0
    assert both.columns == ["id", *SPAN_COLUMNS]


def test_fast_path_with_groups_of_its_own(spark):
    rules = [Rule("A", r"(x)(y)+z"), Rule("B", r"(?<n>q)w")]
    assert [group_count(r.pattern) for r in rules] == [2, 1]
    df = spark.createDataFrame([(1, "xyyz qw . xz")], "id long, text string")
    fast, merged = mask_fast(df, rules, "id").first(), mask(df, rules, "id").first()
    assert fast.text == merged.text and [e.type for e in fast.entities] == ["A", "B"]


def test_fast_path_can_leave_the_rest_of_an_overlap(spark):
    rules = [Rule("A", "ab"), Rule("B", "bcd")]
    df = spark.createDataFrame([(1, "abcd")], "id long, text string")
    assert mask_fast(df, rules, "id").first().text.endswith("cd")
    assert re.fullmatch(r"<MASK_A:[0-9A-F]{4}>", mask(df, rules, "id").first().text)


def test_roles(spark):
    turns = [(1, "user", "a@b.org"), (1, "system", "a@b.org"), (1, "assistant", "a@b.org"), (1, "model", "a@b.org")]
    df = spark.createDataFrame(turns, "conv_id long, role string, text string")

    def hit(policy):
        return {r.role for r in mask_conversations(df, RULES, policy).collect() if r.replacement_count}

    assert hit(Policy()) == {"user"}
    assert hit(Policy(redact_system_messages=True)) == {"user", "system"}
    assert hit(Policy(redact_ai_answers=True)) == {"user", "assistant", "model"}
    assert hit(Policy(enabled=False)) == set()


@pytest.mark.parametrize("pattern", ["", "a*", r"\b", "(?=x)", "x|y?", "^"])
def test_patterns_that_can_match_nothing_are_refused(pattern):
    if pattern:
        with pytest.raises(ValueError):
            checked([Rule("A", pattern)])
    else:
        assert checked([Rule("A", pattern)]) == []


def test_rule_ids_and_switches(spark):
    with pytest.raises(ValueError):
        checked([Rule("1A", "x")])
    assert checked([Rule("a_1", "x"), Rule("B", "y", enabled=False)]) == [Rule("A_1", "x")]
    frame = rules_frame(spark, [Rule("b", "y"), Rule("a", "x"), Rule("c", " ")])
    assert load_rules(frame) == [Rule("B", "y"), Rule("A", "x")]


@pytest.mark.parametrize(
    "pattern, texts",
    [
        (r"[a-z]+@[a-z]+\.org", ["a@b.org", "a@b", "@.org"]),
        (r"(?:token|pass(?:word|phrase))=\S", ["token=1", "password=1", "passphrase=1", "pass=1"]),
        (r"(?i)token", ["TOKEN", "token"]),
        (r"(?i:tok)en", ["TOKen", "token"]),
        (r"a?b{2,}c", ["bbc", "abbc", "bc"]),
        (r"(?!x)y", ["y", "x"]),
        (r"\p{Lu}x", ["Éx", "x"]),
        (r"[ab]\x{20}c", ["a c"]),
        (r"x(?:a|)y", ["xy", "xay"]),
    ],
)
def test_cheap_test_never_rules_out_a_match(spark, pattern, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    wrong = df.filter(F.col("text").rlike(pattern) & ~F.expr(may_match("text", pattern)))
    assert wrong.count() == 0


def test_distinct_detection_equals_direct(spark):
    texts = ["a@b.org x", "clean", "a@b.org x", None, "a@b.org x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    shared = {r.id: r.spans for r in detect_distinct(df, RULES).collect()}
    direct = {r.id: r.spans for r in with_spans(df, RULES).collect()}
    assert shared == direct


def test_chunks_cover_the_text(spark):
    rng = random.Random(3)
    texts = ["", "   ", "one", *(" " * rng.randint(0, 2) + " \n".join(["tok😀n"] * n) + " " for n in (3, 4, 5, 6, 7, 50, 1000))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for size, stride in ((4, 1), (4, 0), (3, 2), (1, 0)):
        chunks = chunk_text(df, ["id"], size, stride).orderBy("id", "chunk").collect()
        for i, text in enumerate(texts):
            mine = [c for c in chunks if c.id == i]
            tokens = text.split()
            starts = list(range(0, max(len(tokens) - stride, 1), size - stride)) if tokens else []
            assert [c.text.split() for c in mine] == [tokens[s : s + size] for s in starts]
            assert all(text[c["at"] : c["at"] + len(c.text)] == c.text and len(c.text.split()) == c.n_tokens for c in mine)
    with pytest.raises(ValueError):
        chunk_text(df, ["id"], 4, 4)


def test_no_rules_and_odd_column_names(spark):
    df = spark.createDataFrame([(1, "a@b.org `x`", None), (2, None, "s")], "id long, `the text` string, scope_id string")
    for masked in (mask(df, [], "id", text="the text"), mask_fast(df, [], "id", text="the text")):
        assert {r.id: r["the text"] for r in masked.collect()} == {1: "a@b.org `x`", 2: None}
        assert {r.replacement_count for r in masked.collect()} == {0}
    row = mask(df, RULES, "scope_id", text="the text").filter("id = 1").first()
    assert row.replacement_count == 1 and row.scope_id is None


def test_quotes_and_backslashes_in_patterns(spark):
    df = spark.createDataFrame([(1, "it's a\\b \"q\" `t`")], "id long, text string")
    rules = [Rule("Q", r"'s"), Rule("B", r"\\b"), Rule("D", '"q"'), Rule("T", "`t`")]
    merged, fast = mask(df, rules, "id").first(), mask_fast(df, rules, "id").first()
    assert [e.type for e in merged.entities] == [e.type for e in fast.entities] == ["Q", "B", "D", "T"]
    assert merged.text == fast.text
