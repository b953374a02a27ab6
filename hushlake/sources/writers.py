"""Writing results. A log is laid out by date so that ranges and retention prune folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


# A Bloom filter of each row group's ids, as large as their number asks for.
ID_INDEX = {"parquet.bloom.filter.enabled#id": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def write_requests(requests: DataFrame, path: str, mode: str = "append", **options: str) -> None:
    """Write the log as Parquet, one folder for each UTC date.

    Rebalancing gathers a quiet date to one file and, by measured size, splits
    a busy one over several tasks. Rows are in order of id within a file, and
    row groups have a Bloom filter of their ids, so that looking up one request
    reads the row group that holds it and the footers of the others.
    """
    dated = requests.withColumn("date", F.to_date("timestamp")).hint("rebalance", "date").sortWithinPartitions("date", "id")
    dated.write.options(**{**ID_INDEX, **options}).mode(mode).partitionBy("date").parquet(path)


def write_masked(masked: DataFrame, path: str, mode: str = "append") -> None:
    """Write masked texts with their scope, counts and entities. Raw values are not among them."""
    masked.write.mode(mode).parquet(path)


def write_entities(masked: DataFrame, keys: list[str], path: str, mode: str = "append") -> None:
    """Write the entities of masked texts, one row each."""
    masked.select(*keys, "scope_id", F.inline("entities")).write.mode(mode).parquet(path)


def write_vault(vault: DataFrame, path: str, masked_path: str, mode: str = "append") -> None:
    """Write raw values, to a place of their own: neither folder may lie in the other."""
    vault_parts, masked_parts = (p.rstrip("/").split("/") for p in (path, masked_path))
    shared = min(len(vault_parts), len(masked_parts))
    if vault_parts[:shared] == masked_parts[:shared]:
        raise ValueError("the vault must not lie with the masked texts")
    vault.write.mode(mode).parquet(path)


def purge(requests: DataFrame, path: str) -> None:
    """Replace the stored log by an empty one of the same schema; ``write_requests`` may append to it again.

    A log laid out by date stays without a ``date`` column in its files, as its folders give it.
    """
    kept = [f for f in requests.schema.fields if f.name != "date"]
    requests.sparkSession.createDataFrame([], StructType(kept)).write.mode("overwrite").parquet(path)
