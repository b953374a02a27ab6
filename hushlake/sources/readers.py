"""Reading stored tables and documents. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.operators.decode import decode, decode_list
from hushlake.schemas import CLIENT_LOG, DETAIL, REQUESTS


def read_requests(spark: SparkSession, path: str, format: str = "parquet", detail: bool = False) -> DataFrame:
    """The request log as Parquet or as typed JSON lines; ``detail`` adds fields and raw exchanges."""
    schema = DETAIL if detail else REQUESTS
    return spark.read.schema(schema).format(format).load(path)


def read_request_documents(spark: SparkSession, path: str, detail: bool = False) -> DataFrame:
    """The request log as lines of untrusted JSON: wrong values become defaults."""
    lines = spark.read.text(path)
    decoded = decode(lines, "request_detail" if detail else "request", json="value")
    return decoded.withColumn("timestamp", F.try_to_timestamp("timestamp"))


def read_policy(spark: SparkSession, path: str) -> DataFrame:
    """Policy documents, one in each file."""
    return decode(spark.read.text(path, wholetext=True), "policy", json="value")


def read_dimension(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``profiles``, ``upstreams``, ``targets`` or ``models`` of documents that list them."""
    member = "proxy_rules" if kind == "targets" else kind
    return decode_list(spark.read.text(path, wholetext=True), kind, member, json="value")


def read_client_log(spark: SparkSession, path: str) -> DataFrame:
    """Client errors, one JSON object on each line."""
    return spark.read.schema(CLIENT_LOG).json(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal out the rows of a scan that has fewer splits than the cluster has cores.

    A large file that cannot be split would keep one core busy with all of its
    texts. A scan with enough splits, as any large table has, is left alone.
    Give it a plain scan: counting the splits runs nothing then.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def texts(df: DataFrame, text_col: str, scope_col: str, keys: list[str] | None = None) -> DataFrame:
    """Any table as texts to be masked: keys, scope_id and text."""
    return df.select(*(keys or []), F.col(scope_col).cast("string").alias("scope_id"), F.col(text_col).alias("text"))
