"""Detection: where rules match, chunked texts and repeated texts.

All matching happens beside the text, in the task that reads it: no shuffle,
no Python. Only rows with a hit pay for offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlake.functions.arrays import let, name, quoted, scan_before
from hushlake.functions.once import compute_once
from hushlake.operators.rules import Rule, checked, may_match
from hushlake.operators.spans import NO_SPANS

# Shape of a placeholder. Text inside one is never searched, so masking
# masked text again changes nothing.
PLACEHOLDER = r"<(?:MASK_)?[A-Z][A-Z0-9_]*:[0-9A-F]{4}>"

# White space between tokens, and a token with what follows it.
WHITE_SPACE = " \t\n\r\f\x0b"
TOKEN = r"[^ \t\n\r\f\x0B]+[ \t\n\r\f\x0B]*"

RULE_CONFIDENCE = 1.0


def with_spans(df: DataFrame, rules: list[Rule], text: str = "text", into: str = "spans") -> DataFrame:
    """Add an array of all rule matches, sorted by position, overlaps included.

    Places come from decoded characters and slices from bytes, so bytes that
    are no valid UTF-8 are replaced in the text first. Each step is a
    projection of its own, so that what the next step uses twice is computed once.
    """
    rules = checked(rules)
    col = name(text)
    segments, hits, todo = (f"__{into}_{part}" for part in ("segments", "hits", "todo"))
    out = df.withColumn(text, F.make_valid_utf8(text)).withColumn(segments, F.expr(_segments(col)))
    if rules:
        # One column whatever the number of rules.
        listed = ", ".join(_hits(name(segments), r.pattern) for r in rules)
        out = out.withColumn(hits, F.expr(f"array({listed})"))
        jobs = ", ".join(_jobs(name(segments), f"get({name(hits)}, {i})", r.pattern, i, r.id) for i, r in enumerate(rules))
        # Rules without a hit are null here; most rows have none at all.
        out = out.withColumn(todo, F.expr(f"filter(array({jobs}), j -> j is not null)"))
        placed = f"if(size({name(todo)}) > 0, sort_array(flatten(transform(flatten({name(todo)}), job -> {_PLACED}))), null)"
        found = F.expr(f"coalesce(cast({placed} as {NO_SPANS}), cast(array() as {NO_SPANS}))")
    else:
        found = F.array().cast(NO_SPANS)
    return compute_once(out, {into: found}, drop=[segments, hits, todo])


def has_match(text: str, rules: list[Rule]) -> str:
    """SQL: whether some rule matches a text."""
    tests = [f"({may_match(name(text), r.pattern)} and {name(text)} rlike {quoted(r.pattern)})" for r in checked(rules)]
    return " or ".join(tests) or "false"


def has_placeholder(text: str) -> str:
    """SQL: whether a text holds a placeholder."""
    return f"({may_match(text, PLACEHOLDER)} and {text} rlike {quoted(PLACEHOLDER)})"


def _segments(text: str) -> str:
    """The pieces between placeholders, each with its place in the text."""
    shape = quoted(PLACEHOLDER)
    lengths = (
        f"zip_with(pieces, regexp_extract_all({text}, {shape}, 0), "
        "(p, m) -> length(p) + coalesce(length(m), 0))"
    )
    places = scan_before(lengths, "0", lambda a, b: f"{a} + {b}")
    split = let(
        f"split({text}, {shape}, -1)",
        "pieces",
        f"zip_with({places}, pieces, (at, body) -> named_struct('at', at, 'body', body))",
    )
    return (
        f"if({has_placeholder(text)}, {split}, "
        f"array(named_struct('at', 0, 'body', {text})))"
    )


def _hits(segments: str, pattern: str) -> str:
    """Matches of each segment; none where the cheap test rules them out."""
    return (
        f"transform({segments}, s -> if({may_match('s.body', pattern)}, "
        f"regexp_extract_all(s.body, {quoted(pattern)}, 0), cast(array() as array<string>)))"
    )


def _jobs(segments: str, hits: str, pattern: str, pos: int, rule_id: str) -> str:
    """For a rule that hit: by segment, its matches and the gap before each. Null if it did not."""
    sizes = (
        f"zip_with(slice(split(z.segment.body, {quoted(pattern)}, -1), 1, size(z.values)), z.values, "
        "(gap, m) -> named_struct('gap', length(gap), 'own', length(m)))"
    )
    job = (
        f"named_struct('at', z.segment.at, 'values', z.values, 'sizes', {sizes}, "
        f"'pos', {pos}, 'type', {quoted(rule_id)})"
    )
    zipped = f"zip_with({segments}, {hits}, (s, h) -> named_struct('segment', s, 'values', h))"
    hit = f"filter({zipped}, z -> size(z.values) > 0)"
    return f"if(exists({hits}, h -> size(h) > 0), transform({hit}, z -> {job}), null)"


# The spans of one job: places are running sums of gaps and matches.
_PLACED = (
    "zip_with(arrays_zip(job.sizes, job.values), "
    + scan_before("transform(job.sizes, w -> w.gap + w.own)", "0", lambda a, b: f"{a} + {b}")
    + ", (w, before) -> named_struct('start', job.at + before + w.sizes.gap, "
    "'end', job.at + before + w.sizes.gap + w.sizes.own, 'external', false, 'pos', job.pos, "
    "'type', job.type, 'source', concat('rule:', job.type), "
    f"'confidence', double({RULE_CONFIDENCE}), 'value', w.values))"
)


def detect_rules(
    df: DataFrame, rules: list[Rule], keys: list[str], text: str = "text", scope: str | None = None
) -> DataFrame:
    """One row for each match: keys, scope, rule id, start, end, value and provenance."""
    kept = list(dict.fromkeys([*keys, *([scope] if scope else [])]))
    found = with_spans(df.select(*kept, text), rules, text, "__spans")
    return found.filter(F.size("__spans") > 0).select(*kept, F.inline("__spans"))


def detect_distinct(df: DataFrame, rules: list[Rule], text: str = "text", into: str = "spans") -> DataFrame:
    """Detect once for each distinct text and give every copy the result.

    Only texts in which some rule matches are collapsed, so few are shuffled,
    and copies are combined before that: a text that fills a third of the table
    costs one detection. To join results back, the hash of the text is
    shuffled, never the text; a hot hash is split by the adaptive skew join.
    Results that outlive a run are kept by ``detection_cache``.
    """
    df = df.withColumn(text, F.make_valid_utf8(text))
    hit = df.select(text).filter(has_match(text, rules))
    found = with_spans(hit.distinct(), rules, text, into)
    key = F.sha2(F.col(text), 256)
    results = found.filter(F.size(into) > 0).select(key.alias("__key"), into)
    others = [c for c in df.columns if c != text]
    joined = df.select(*others, key.alias("__key")).join(results, "__key", "left")
    return joined.select(*others, F.coalesce(into, F.array().cast(NO_SPANS)).alias(into))


def chunk_text(
    df: DataFrame, keys: list[str], max_tokens: int, stride: int, text: str = "text"
) -> DataFrame:
    """Cut texts to windows of ``max_tokens`` tokens that overlap by ``stride``.

    Gives keys, chunk number, token count, place of the chunk in the text and
    the chunk itself, which is an exact piece of the text. Tokens are
    separated by white space. A text without tokens gives no chunk.
    """
    if not 0 <= stride < max_tokens:
        raise ValueError("need 0 <= stride < max_tokens")
    step = max_tokens - stride
    col, blank = name(text), quoted(WHITE_SPACE)
    starts = f"sequence(0, int(greatest(ceil((size(ts) - {max_tokens}) / {step}), 0)))"
    # Lengths of the blocks between window starts give the window places.
    lengths = f"transform(ks, k -> length(array_join(slice(ts, k * {step} + 1, {step}), '')))"
    window = (
        f"named_struct('chunk', k, 'n_tokens', least(size(ts) - k * {step}, {max_tokens}), "
        f"'at', length({col}) - length(trim(LEADING {blank} FROM {col})) + before, "
        f"'text', trim(TRAILING {blank} FROM array_join(slice(ts, k * {step} + 1, {max_tokens}), '')))"
    )
    placed = f"zip_with(ks, {scan_before(lengths, '0', lambda a, b: f'{a} + {b}')}, (k, before) -> {window})"
    windows = let(
        f"regexp_extract_all({col}, {quoted(TOKEN)}, 0)",
        "ts",
        f"if(size(ts) > 0, {let(starts, 'ks', placed)}, null)",
    )
    # The outer form computes the windows once; its row for a text without tokens is dropped.
    return df.select(*keys, F.inline_outer(F.expr(windows))).filter(F.col("chunk").isNotNull())


def rebase_spans(chunk_spans: DataFrame, at: str = "at", chunk: str = "chunk") -> DataFrame:
    """Move spans found in chunks to their place in the whole text."""
    shifted = chunk_spans.withColumn("start", F.col("start") + F.col(at)).withColumn(
        "end", F.col("end") + F.col(at)
    )
    return shifted.drop(at, chunk)
