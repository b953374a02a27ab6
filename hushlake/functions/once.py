"""Columns that are worth computing only once."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: dict[str, Column], drop: Iterable[str] = ()) -> DataFrame:
    """Add or replace columns so that later steps refer to them and never copy them.

    A filter on a projected column is pushed below the projection by putting
    the column's expression in its place, which runs a costly expression
    twice, and far more often through several projections. A filter on what a
    generator gave stays above it, while filters on all other columns still
    reach the scan. The generator here gives exactly one row for each row.
    """
    gone = {*columns, *drop}
    row = F.struct(*[value.alias(key) for key, value in columns.items()])
    return df.select(*[c for c in df.columns if c not in gone], F.inline_outer(F.array(row)))
