"""Text columns: trimming, truncation, sanitising, hiding and display forms."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as ECMAScript defines it, as the inside of a
# regular-expression character class.
WHITE = (
    r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)

# Fixed value: longest log field kept, in characters.
FIELD_LIMIT = 8000

# What counts as a credential in a log line, in order of use.
_BEARER_HEADER = rf"(?i)(authorization[{WHITE}]*[:=][{WHITE}]*bearer[{WHITE}]+)[^{WHITE},;]+"
_NAMED_SECRET = (
    rf"(?i)((?:api[_-]?key|token|secret|password)[{WHITE}]*[:=][{WHITE}]*)[^{WHITE},;]+"
)
_BARE_SECRET = rf"(?<![A-Za-z0-9_])(?:sk-[A-Za-z0-9_-]+|Bearer[{WHITE}]+[A-Za-z0-9._~-]+)"


def js_trim(col: Column) -> Column:
    """Trim Unicode white space on both sides, not only blanks."""
    return F.regexp_replace(col, rf"^[{WHITE}]+|[{WHITE}]+$", "")


def n_chars(col: Column) -> Column:
    """Number of characters (code points)."""
    return F.length(col)


def limit_field(col: Column, limit: int = FIELD_LIMIT) -> Column:
    """Cut after ``limit`` UTF-16 units and append an ellipsis; null stays null.

    A character outside the basic plane counts as two units, and is left out
    whole where the limit falls between them. Text within half the limit cannot be too long.
    """
    units = F.encode(col, "UTF-16BE")
    # The high half of a pair begins with D8 to DB.
    halved = F.hex(F.substring(units, 2 * limit - 1, 1)).between("D8", "DB")
    kept = F.decode(F.substring(units, F.lit(1), F.when(halved, 2 * limit - 2).otherwise(2 * limit)), "UTF-16BE")
    return F.when((F.length(col) * 2 > limit) & (F.octet_length(units) > 2 * limit), F.concat(kept, F.lit("…"))).otherwise(col)


def sanitize(col: Column) -> Column:
    """Replace credentials in a log text by ``[REDACTED]``.

    Most texts hold none of the words that make a credential. Looking for the
    words is far cheaper than the patterns, which run only where one is found.
    """

    def clean(text: Column, lower: Column) -> Column:
        def has(*words: str) -> Column:
            return functools.reduce(lambda a, b: a & b, [F.contains(lower, F.lit(w)) for w in words])

        named = has("token") | has("secret") | has("password") | has("api", "key")
        out = F.when(has("authorization", "bearer"), F.regexp_replace(text, _BEARER_HEADER, "$1[REDACTED]")).otherwise(text)
        out = F.when(named, F.regexp_replace(out, _NAMED_SECRET, "$1[REDACTED]")).otherwise(out)
        return F.when(has("sk-") | has("bearer"), F.regexp_replace(out, _BARE_SECRET, "[REDACTED]")).otherwise(out)

    cleaned = F.transform(
        F.array(F.struct(col.alias("text"), F.lower(col).alias("lower"))), lambda x: clean(x["text"], x["lower"])
    )
    return F.get(cleaned, F.lit(0))


def hide_value(col: Column) -> Column:
    """First character and one asterisk for each further one."""
    return F.concat(F.left(col, F.lit(1)), F.repeat(F.lit("*"), F.greatest(F.length(col) - 1, F.lit(0))))


def format_bytes(col: Column) -> Column:
    """``n B`` below 1024, else kilobytes with one decimal (never larger units)."""
    return F.when(col < 1024, F.concat(col.cast("string"), F.lit(" B"))).otherwise(
        F.concat(F.format_string("%.1f", (col / F.lit(1024)).cast("double")), F.lit(" KB"))
    )


def format_headers(col: Column) -> Column:
    """One ``key: v1, v2`` line for each header; a dash when there is none."""
    lines = F.transform(
        F.map_entries(col),
        lambda e: F.concat(e["key"], F.lit(": "), F.array_join(e["value"], ", ")),
    )
    return F.coalesce(F.nullif(F.array_join(lines, "\n"), F.lit("")), F.lit("—"))
