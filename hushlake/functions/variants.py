"""Strict reading of JSON values: a wrong type gives the default, never a cast.

``open_json`` and ``open_record`` take an object apart once, to a struct with
one VARIANT for each named member; the other functions read such a member.
Null (a missing member, or a document that is no object) gives the default.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _members(names: Iterable[str]) -> str:
    return ", ".join(f"`{name}` variant" for name in names)


def parse(json: Column) -> Column:
    """JSON text to VARIANT; null for text that is not JSON to its end.

    The parser stops after the first value, whatever follows. So the text is
    parsed as the first of two elements, the second being its own hash: both
    come out only if the text is one value and nothing else.
    """
    mark = F.xxhash64(json)
    whole = F.try_parse_json(F.concat(F.lit("["), json, F.lit(","), mark.cast("string"), F.lit("]")))
    element = lambda both, i: F.get(both, F.lit(i))
    fits = lambda both: (F.size(both) == 2) & (F.try_variant_get(element(both, 1), "$", "bigint") == mark)
    return bind(F.try_variant_get(whole, "$", "array<variant>"), lambda both: F.when(fits(both), element(both, 0)))


def open_json(json: Column, names: Iterable[str]) -> Column:
    """Members of an object given as JSON text. Text that is not JSON to its end gives null."""
    return open_record(parse(json), names)


def open_record(v: Column, names: Iterable[str]) -> Column:
    """Members of an object; null for anything else."""
    return F.try_variant_get(v, "$", f"struct<{_members(names)}>")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; null for a null value."""
    return F.get(F.transform(F.array(value), lambda x: F.when(x.isNotNull(), body(x))), F.lit(0))


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_record(v: Column) -> Column:
    """True for a JSON object; not for null, arrays and scalars."""
    return F.coalesce(kind(v).startswith("OBJECT"), F.lit(False))


def is_number(v: Column) -> Column:
    return F.substring(kind(v), 1, 3).isin("BIG", "DOU", "FLO", "DEC")


def records(v: Column) -> Column:
    """The objects of an array; an empty array for anything else."""
    items = F.filter(F.try_variant_get(v, "$", "array<variant>"), is_record)
    return F.coalesce(items, F.from_json(F.lit("[]"), "array<variant>"))


def open_records(v: Column, names: Iterable[str]) -> Column:
    """Members of the objects of an array, taken apart in one cast; an empty array for anything else."""
    kind_ = f"array<struct<{_members(names)}>>"
    return F.coalesce(F.filter(F.try_variant_get(v, "$", kind_), lambda x: x.isNotNull()), F.array().cast(kind_))


def text(v: Column, default: str | Column = "") -> Column:
    return F.coalesce(optional_text(v), default if isinstance(default, Column) else F.lit(default))


def optional_text(v: Column) -> Column:
    return F.when(kind(v) == "STRING", F.variant_get(v, "$", "string"))


def number(v: Column, default: float = 0, as_type: str = "bigint") -> Column:
    """A finite JSON number; numeric strings are not numbers."""
    found = F.when(is_number(v), F.try_variant_get(v, "$", as_type))
    if as_type == "double":
        found = F.when(F.abs(found) < float("inf"), found)
    return F.coalesce(found, F.lit(default).cast(as_type))


def boolean(v: Column, default: bool = False) -> Column:
    return F.coalesce(F.when(kind(v) == "BOOLEAN", F.variant_get(v, "$", "boolean")), F.lit(default))


def string_list(v: Column) -> Column:
    """The strings of an array; an empty array for anything else."""
    kept = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda x: kind(x) == "STRING")
    return F.coalesce(
        F.transform(kept, lambda x: F.variant_get(x, "$", "string")), F.array().cast("array<string>")
    )


def _map(v: Column) -> Column:
    return F.when(is_record(v), F.try_variant_get(v, "$", "map<string,variant>"))


def string_map(v: Column) -> Column:
    """Only the string values of an object; null when it is no object."""
    kept = F.map_filter(_map(v), lambda _, x: kind(x) == "STRING")
    return F.transform_values(kept, lambda _, x: F.variant_get(x, "$", "string"))


def header_map(v: Column) -> Column:
    """Object of string lists; a value that is no list becomes an empty one."""
    return F.transform_values(_map(v), lambda _, x: string_list(x))


def number_map(v: Column) -> Column:
    """Object of numbers; a value that is no number becomes 0. Empty when no object."""
    found = F.transform_values(_map(v), lambda _, x: number(x))
    return F.coalesce(found, F.create_map().cast("map<string,bigint>"))
