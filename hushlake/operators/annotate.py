"""Marking placeholders in a masked text with the entity they stand for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushlake.functions.arrays import let, name, scan_before

PART = "struct<part string, type string>"


def annotate_all(text: str, entities: str) -> Column:
    """Cut the text at every occurrence of a replacement: array of (part, type or null).

    Of two entities with the same replacement the last counts. Longer
    replacements are tried first, so one that is a prefix of another does not
    cut it. The parts put together are the text; parts may be empty.
    """
    col = name(text)
    usable = f"filter({name(entities)}, e -> e.replacement <> '')"
    # Later entries win, as the map keeps the last of equal keys.
    in_order = "sort_array(transform(es, (e, i) -> struct(e.replacement as r, i as i, e.type as t)))"
    last = "filter(so, (x, i) -> coalesce(get(so, i + 1).r <> x.r, true))"
    known = let(in_order, "so", f"map_from_entries(transform({last}, x -> struct(x.r, x.t)))")
    longest = (
        "array_sort(map_keys(known), (a, b) -> case when length(a) > length(b) then -1 "
        "when length(a) < length(b) then 1 else 0 end)"
    )
    pattern = f"array_join(transform(keys, k -> {_escaped('k')}), '|')"
    plain = f"transform(split({col}, pattern, -1), p -> named_struct('part', p, 'type', cast(null as string)))"
    marks = f"transform(regexp_extract_all({col}, pattern, 0), m -> named_struct('part', m, 'type', known[m]))"
    zipped = f"filter(flatten(zip_with({plain}, {marks}, (p, m) -> array(p, m))), x -> x is not null)"
    cut = let(longest, "keys", let(pattern, "pattern", zipped))
    whole = f"array(named_struct('part', {col}, 'type', cast(null as string)))"
    return F.expr(let(usable, "es", f"if(coalesce(size(es), 0) = 0, {whole}, {let(known, 'known', cut)})"))


def annotate_first(text: str, entities: str) -> Column:
    """Entity by entity, mark the first occurrence in each part not marked yet.

    Where no two occurrences in the text can overlap, one scan finds all of them
    and the step that marks each is worked out from their order, see ``_steps``.
    Only texts in which replacements overlap go entity by entity.
    """
    whole = f"array(cast(struct({name(text)}, null) as {PART}))"
    usable = f"filter(coalesce({name(entities)}, array()), e -> e.replacement <> '')"
    # A replacement of this shape neither overlaps another one nor holds it.
    closed = "forall(es, e -> e.replacement rlike '^<[^<>]+>$')"
    scanned = let(f"if(closed, '<[^<>]+>', {_joint('keys')})", "pattern", f"if(not closed and {_overlap(text)}, null, {_scanned(text)})")
    keys = "array_distinct(transform(es, e -> e.replacement))"
    found = let(keys, "keys", let(closed, "closed", scanned))
    return F.expr(let(usable, "es", f"if({name(text)} is null or size(es) = 0, {whole}, coalesce({found}, {_one_by_one(whole)}))"))


def _joint(keys: str) -> str:
    """SQL: a pattern that matches any of the strings, longer ones first."""
    longest = f"array_sort({keys}, (a, b) -> length(b) - length(a))"
    return f"array_join(transform({longest}, k -> {_escaped('k')}), '|')"


def _escaped(key: str) -> str:
    """SQL: a string as a pattern that matches it alone."""
    return f"regexp_replace({key}, " + r"r'[.*+?^${}()|\[\]\\]', r'\\$0')"


def _overlap(text: str) -> str:
    """SQL: one key begins another, or keys begin in the text at more places than a scan without overlaps finds."""
    in_order = "sort_array(keys)"
    prefixes = let(in_order, "ks", "exists(sequence(1, size(ks)), i -> coalesce(startswith(get(ks, i), get(ks, i - 1)), false))")
    counts = f"regexp_count({name(text)}, concat('(?=(?:', pattern, '))')) > regexp_count({name(text)}, pattern)"
    return f"({prefixes} or {counts})"


def _steps() -> str:
    """SQL: for each occurrence in ``ms``, the place in ``es`` of the entity that marks it; a large number for none.

    An occurrence is the first of its replacement in its part once anything
    between the one before it (inclusive) and itself is marked. So it is marked
    by the first entity with its replacement that comes after the earliest of
    those marks; the first occurrence by the first such entity. Entities and
    occurrences sorted together by replacement give each occurrence its
    entities (``at`` and ``n``) and the occurrence before it.
    """
    merged = (
        "sort_array(concat(transform(es, (e, i) -> named_struct('r', e.replacement, 'kind', 0, 'i', i)), "
        "transform(ms, (m, i) -> named_struct('r', m, 'kind', 1, 'i', i))))"
    )
    new = "(i = 0 or get(so, i - 1).r <> x.r)"
    running = lambda values: (
        f"zip_with({values}, {scan_before(values, '0', lambda a, b: f'greatest({a}, {b})')}, (own, before) -> greatest(own, before))"
    )
    group = running(f"transform(so, (x, i) -> if({new}, i, 0))")
    first = running(f"transform(so, (x, i) -> if(x.kind = 1 and ({new} or get(so, i - 1).kind = 0), i, 0))")
    placed = (
        f"zip_with(zip_with(so, {group}, (s, g) -> named_struct('s', s, 'g', g)), {first}, "
        "(z, f) -> named_struct('s', z.s, 'g', z.g, 'f', f))"
    )
    listed = (
        f"transform({placed}, (z, i) -> if(z.s.kind = 1, named_struct('i', z.s.i, "
        "'before', if(i > z.f, get(so, i - 1).i, -1), 'at', z.g, 'n', z.f - z.g), null))"
    )
    in_order = f"sort_array(filter({listed}, o -> o is not null))"
    earliest = "if(o.before < 0, -1, array_min(slice(ts, o.before + 1, size(ts) - o.before)))"
    halve = (
        "if(a.lo >= a.hi, a, if(get(so, o.at + (a.lo + a.hi) div 2).i <= since, "
        "named_struct('lo', int((a.lo + a.hi) div 2 + 1), 'hi', a.hi), named_struct('lo', a.lo, 'hi', int((a.lo + a.hi) div 2))))"
    )
    passed = f"aggregate(sequence(1, int(ceil(log2(o.n + 1)))), named_struct('lo', 0, 'hi', o.n), (a, x) -> {halve}, a -> a.lo)"
    step = let(earliest, "since", f"coalesce(get(slice(so, o.at + 1, o.n), {passed}).i, {_NEVER})")
    return let(merged, "so", f"aggregate({in_order}, cast(array() as array<int>), (ts, o) -> array_append(ts, {step}))")


_NEVER = 2147483647


def _scanned(text: str) -> str:
    """SQL: the parts, from one scan for all replacements."""
    col = name(text)
    pieces = f"flatten(zip_with(split({col}, pattern, -1), ms, (p, m) -> filter(array(p, m), x -> x is not null)))"
    marks = f"filter(transform(steps, (t, i) -> named_struct('at', 2 * i + 1, 'step', t)), k -> k.step < {_NEVER})"
    gap = "array_join(slice(ss, coalesce(get(ks, i - 1).at, -1) + 2, k.at - coalesce(get(ks, i - 1).at, -1) - 1), '')"
    marked = (
        f"flatten(transform(ks, (k, i) -> array(cast(struct({gap}, null) as {PART}), "
        f"cast(struct(get(ss, k.at), get(es, k.step).type) as {PART}))))"
    )
    tail = f"array(cast(struct(array_join(slice(ss, coalesce(element_at(ks, -1).at, -1) + 2, size(ss)), ''), null) as {PART}))"
    parts = let(marks, "ks", f"if(size(ks) = 0, array(cast(struct({col}, null) as {PART})), concat({marked}, {tail}))")
    return let(f"regexp_extract_all({col}, pattern, 0)", "ms", let(_steps(), "steps", let(pieces, "ss", parts)))


def _one_by_one(start: str) -> str:
    """SQL: the rule as it is stated, step by step."""
    cut = (
        "array(cast(struct(left(p.part, at - 1), null) as {part}), "
        "cast(struct(e.replacement, e.type) as {part}), "
        "cast(struct(substring(p.part, at + length(e.replacement)), null) as {part}))"
    ).format(part=PART)
    marked = let("locate(e.replacement, p.part)", "at", f"if(p.type is not null or at = 0, array(p), {cut})")
    return f"aggregate(es, {start}, (ps, e) -> flatten(transform(ps, p -> {marked})))"
