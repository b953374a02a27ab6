"""Cleaning of client error records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.functions import variants as V
from hushlake.functions.text import limit_field, sanitize


def sanitize_client_log(log: DataFrame, error: str = "error", name: str = "error_name") -> DataFrame:
    """Cut, then sanitise, the text columns of a client log.

    ``error`` holds what was caught: JSON text. A JSON string is the message
    itself, any other value is kept as the JSON text it came as; a blank message becomes the
    error's name, or ``Unknown error``. ``stack``, ``component_stack`` and
    ``source`` may be null and stay so.
    """
    parsed = V.parse(F.col(error))
    message = F.when(V.kind(parsed) == "STRING", F.variant_get(parsed, "$", "string")).otherwise(F.col(error))
    clean = {c: _clean(F.col(c)) for c in ("stack", "component_stack", "source")}
    filled = F.coalesce(F.nullif(_clean(message), F.lit("")), F.nullif(F.col(name), F.lit("")), F.lit("Unknown error"))
    return log.withColumns({"message": filled, **clean}).drop(error, name)


def _clean(col: Column) -> Column:
    return sanitize(limit_field(col))
