"""Tables, folders and small helpers that the operators of this package share."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.session import adopt, work_dir

#: Deleted or split at where a contract speaks of white space: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: Texts may be long, so few of them go to a Python worker at a time.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def ready(spark: SparkSession) -> SparkSession:
    """The session with this package's settings, and with the folder it was imported from on its workers' path."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    return adopt(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Lost executors cost nothing that is in such a table, and what reads it
    starts from files, so that adaptive execution can split skewed joins.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on the machine that asks."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def in_third(number: int, column: str = "doc_id"):
    """Whether crc32 of the id as text leaves ``number`` modulo 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 3 == number

