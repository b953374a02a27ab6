"""Masking: placeholders, rewriting, role scope, counts and the leak check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.functions.arrays import interleave, let, name, quoted
from hushlake.functions.once import compute_once
from hushlake.operators.detect import PLACEHOLDER, RULE_CONFIDENCE, with_spans
from hushlake.operators.rules import Rule, checked, group_count, group_names, may_match, refers_to_groups
from hushlake.operators.sides import split_by_keys
from hushlake.operators.spans import (
    NO_SPANS,
    SPAN,
    SPAN_COLUMNS,
    external_spans,
    island_bounds,
    islands,
)

ENTITY = "struct<type string, replacement string, confidence double, sources array<string>>"
NO_ENTITIES = f"array<{ENTITY}>"

# SQL for the partly hidden value of an island: first character and asterisks.
HIDDEN = "concat(left(x.value, 1), repeat('*', greatest(length(x.value) - 1, 0)))"

# A text with more islands than this is cut to blocks first, so that taking a
# slice does not walk the text from its beginning each time.
_MANY = 16
_BLOCK = 4096


@dataclass(frozen=True)
class Policy:
    """Which content is masked at all."""

    enabled: bool = True
    redact_ai_answers: bool = False
    redact_system_messages: bool = False


def placeholder(type_: str, external: str, value: str, scope: str, pepper: str = "") -> str:
    """SQL for ``<MASK_RULE:HEX4>`` of rules and ``<TYPE:HEX4>`` of external entities.

    The four digits come from a hash over scope, type and value; ``pepper`` is
    an optional secret in front of them.
    """
    hashed = f"{quoted(pepper)}, " if pepper else ""
    digest = f"sha2(concat_ws('|', {hashed}{scope}, {type_}, {value}), 256)"
    return f"concat(if({external}, '<', '<MASK_'), {type_}, ':', upper(substring({digest}, 1, 4)), '>')"


def _slice(text: str, blocks: str, start: str, end: str) -> str:
    """SQL for characters [start, end) of a text, by way of its blocks if it has any."""
    first, last = f"(({start}) div {_BLOCK})", f"((({end}) - 1) div {_BLOCK})"
    near = f"array_join(slice({blocks}, int({first} + 1), int(greatest({last} - {first} + 1, 0))), '')"
    return (
        f"if({blocks} is null, substring({text}, {start} + 1, {end} - ({start})), "
        f"substring({near}, ({start}) % {_BLOCK} + 1, {end} - ({start})))"
    )


def with_islands(
    df: DataFrame,
    rules: list[Rule],
    scope: str,
    *,
    text: str = "text",
    external: DataFrame | None = None,
    keys: list[str] | None = None,
    pepper: str = "",
    into: str = "islands",
) -> DataFrame:
    """Add the merged spans of each text with their values and placeholders.

    Also leaves ``<into>_blocks`` for rewriting. With ``external``, spans of a
    detector are joined by ``keys``, which must name one text; ``df`` is read
    twice then, for texts with such spans and for the others.
    """
    spans, bounds, blocks = f"__{into}_spans", f"__{into}_bounds", f"{into}_blocks"
    if external is not None:
        given = external_spans(external, keys)
        some, none = split_by_keys(df, given, keys)
        listed = given.groupBy(*keys).agg(F.collect_list(F.struct(*SPAN_COLUMNS).cast(SPAN)).alias("__external"))
        # Only texts that have spans of the detector meet them in a shuffle; the others stay where they are.
        df = some.join(listed, keys, "left").unionByName(none.withColumn("__external", F.lit(None).cast(NO_SPANS)))
    out = with_spans(df, rules, text, spans)
    if external is not None:
        # Spans that reach past the end of the text are cut there.
        cut = F.transform("__external", lambda s: s.withField("end", F.least(s["end"], F.length(text))))
        fitting = F.filter(cut, lambda s: s["end"] > s["start"])
        both = F.sort_array(F.concat(F.col(spans), F.coalesce(fitting, F.array().cast(NO_SPANS))))
        out = out.withColumn(spans, both).drop("__external")
    out = out.withColumn(
        bounds, F.expr(f"if(size({name(spans)}) > 0, {island_bounds(name(spans))}, null)")
    ).withColumn(
        blocks,
        F.expr(
            f"if(size({name(bounds)}) > {_MANY}, "
            f"regexp_extract_all({name(text)}, {quoted(f'(?s).{{1,{_BLOCK}}}')}, 0), null)"
        ),
    )
    value = f"coalesce(x.value, {_slice(name(text), name(blocks), 'x.start', 'x.end')})"
    named = (
        "named_struct('start', x.start, 'end', x.end, 'type', x.type, 'external', x.external, "
        "'confidence', x.confidence, 'sources', x.sources, 'value', v, 'replacement', "
        f"{placeholder('x.type', 'x.external', 'v', f'cast({name(scope)} as string)', pepper)})"
    )
    found = f"transform({islands(name(spans), name(bounds))}, x -> {let(value, 'v', named)})"
    return compute_once(
        out, {into: F.expr(f"if({name(bounds)} is null, null, {found})")}, drop=[spans, bounds]
    )


def rewrite(text: str, islands: str, replacement: str = "x.replacement") -> Column:
    """The text with each island ``x`` replaced by the SQL expression ``replacement``."""
    col, found, blocks = name(text), name(islands), name(f"{islands}_blocks")
    gap = _slice(col, blocks, f"coalesce(get({found}, i - 1).end, 0)", "x.start")
    tail = _slice(col, blocks, f"element_at({found}, -1).end", f"length({col})")
    joined = interleave(
        f"concat(transform({found}, (x, i) -> {gap}), array({tail}))",
        f"transform({found}, x -> {replacement})",
    )
    return F.expr(f"if(size({found}) > 0, {joined}, {col})")


def entities_of(islands: str, with_masked: bool = False) -> Column:
    """Entity list of a result; audit entities also show the partly hidden value."""
    shown = f"'masked', {HIDDEN}, " if with_masked else ""
    return F.expr(
        f"transform({name(islands)}, x -> named_struct('type', x.type, 'replacement', x.replacement, "
        f"{shown}'confidence', x.confidence, 'sources', x.sources))"
    )


def mask(
    df: DataFrame,
    rules: list[Rule],
    scope: str,
    *,
    text: str = "text",
    policy: Policy = Policy(),
    where: Column | None = None,
    external: DataFrame | None = None,
    keys: list[str] | None = None,
    pepper: str = "",
) -> DataFrame:
    """Replace found values in ``text``; add scope_id, replacement_count and entities.

    Rows where ``where`` is not true, and all rows when the policy is off,
    pass unchanged. No row leaves its task but for texts with ``external`` spans.
    """
    scoped = df.withColumn("scope_id", F.col(scope).cast("string"))
    if not policy.enabled:
        return scoped.withColumn("replacement_count", F.lit(0)).withColumn(
            "entities", F.array().cast(NO_ENTITIES)
        )
    source = text
    if where is not None:
        source = "__masked"
        scoped = scoped.withColumn(source, F.when(where, F.col(text)))
    found = with_islands(
        scoped,
        rules,
        "scope_id",
        text=source,
        external=external,
        keys=keys,
        pepper=pepper,
        into="__islands",
    )
    return compute_once(
        found,
        {
            text: F.coalesce(rewrite(source, "__islands"), F.col(text)),
            "replacement_count": F.coalesce(F.size("__islands"), F.lit(0)),
            "entities": F.coalesce(entities_of("__islands"), F.array().cast(NO_ENTITIES)),
        },
        drop=["__masked", "__islands", "__islands_blocks"],
    )


def mask_fast(df: DataFrame, rules: list[Rule], scope: str, *, text: str = "text", pepper: str = "") -> DataFrame:
    """One scan with all rules in one pattern: leftmost match wins, ties by order.

    A match that starts inside an earlier one is skipped, so the rest of it
    stays readable. Use it for one rule, or for rules that cannot overlap.
    Patterns with back-references, and names of groups used twice, are refused.
    """
    rules = checked(rules)
    names = [n for r in rules for n in group_names(r.pattern)]
    if any(refers_to_groups(r.pattern) for r in rules) or len(set(names)) < len(names):
        raise ValueError("a joint pattern would break references to groups: use mask")
    df = df.withColumn(text, F.make_valid_utf8(text))
    pattern = "|".join(f"({r.pattern})" for r in rules)
    firsts, group = [], 1
    for rule in rules:
        firsts.append(group)
        group += 1 + group_count(rule.pattern)
    col = name(text)
    # Rule by rule with its cheap test: the joint pattern is run on hits only.
    possible = " or ".join(f"({may_match(col, r.pattern)} and {col} rlike {quoted(r.pattern)})" for r in rules)
    everything = ", ".join(
        f"regexp_extract_all({col}, {quoted(pattern)}, {g}) as g{i}" for i, g in enumerate([0, *firsts])
    )
    which = "coalesce(" + ", ".join(f"if(m.g{i + 1} <> '', {quoted(r.id)}, null)" for i, r in enumerate(rules)) + ")"
    entity = (
        f"named_struct('type', t, 'replacement', {placeholder('t', 'false', 'm.g0', 'scope_id', pepper)}, "
        f"'confidence', double({RULE_CONFIDENCE}), 'sources', array(concat('rule:', t)))"
    )
    hit = F.expr(f"if({possible or 'false'}, struct({everything}), null)") if rules else F.lit(None)
    found = df.withColumn("scope_id", F.col(scope).cast("string")).withColumn("__found", hit)
    if rules:
        zipped = f"arrays_zip({', '.join(f'__found.g{i}' for i in range(len(rules) + 1))})"
        entities = f"coalesce(transform({zipped}, m -> {let(which, 't', entity)}), cast(array() as {NO_ENTITIES}))"
    else:
        entities = f"cast(array() as {NO_ENTITIES})"
    masked = interleave(f"split({col}, {quoted(pattern)}, -1)", "entities.replacement")
    listed = compute_once(found, {"entities": F.expr(entities)}, drop=["__found"])
    return compute_once(
        listed,
        {text: F.expr(f"if(size(entities) > 0, {masked}, {col})"), "replacement_count": F.size("entities")},
    )


def role_in_scope(role: Column, policy: Policy) -> Column:
    """User content always; system messages and answers only if the policy says so."""
    return (
        F.when(role == "system", F.lit(policy.redact_system_messages))
        .when(role.isin("assistant", "model"), F.lit(policy.redact_ai_answers))
        .otherwise(F.lit(True))
    )


def mask_conversations(
    conversations: DataFrame,
    rules: list[Rule],
    policy: Policy,
    *,
    scope: str = "conv_id",
    text: str = "text",
    role: str = "role",
) -> DataFrame:
    return mask(
        conversations, rules, scope, text=text, policy=policy, where=role_in_scope(F.col(role), policy)
    )


def entity_counts(spans: DataFrame) -> DataFrame:
    """Entities of each type."""
    return spans.groupBy("type").agg(F.count(F.lit(1)).alias("n_entities"))


def residual_matches(masked: DataFrame, rules: list[Rule], text: str = "text", into: str = "residual") -> DataFrame:
    """Add the number of rule matches left outside placeholders.

    It runs every pattern on every piece, so that it depends on no test the masking relies on.
    """
    counts = " + ".join(f"regexp_count(piece, {quoted(r.pattern)})" for r in checked(rules))
    pieces = f"split(make_valid_utf8({name(text)}), {quoted(PLACEHOLDER)}, -1)"
    total = f"aggregate(transform({pieces}, piece -> {counts or '0'}), 0, (a, n) -> a + n)"
    return compute_once(masked, {into: F.expr(f"coalesce({total}, 0)")})
