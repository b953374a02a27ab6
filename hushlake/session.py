"""Session settings and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Re-plan at run time: coalesce small shuffles, split skewed join
    # partitions, turn a join into a broadcast once its side is measured.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The last of two equal JSON keys wins instead of voiding the document.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Sessions of a hot key are merged in each task before they are shuffled.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # Streaming state lies on disk instead of in the heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "hushlake", master: str | None = None, **extra: str) -> SparkSession:
    """Start or get a session with the settings this package relies on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def adopt(spark: SparkSession) -> SparkSession:
    """Give a session that was built elsewhere the settings that can be set at run time."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


#: Folders that ``work_dir`` has named and ``clean`` has not removed.
_named: list[str] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for checkpoints and intermediate tables.

    It lies under ``spark.checkpoint.dir``, which every executor can reach. A
    temporary folder of this machine is used only where that setting is
    absent and the session runs in local mode.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="hushlake-")
    _named.append(f"{base.rstrip('/')}/hushlake-{name}-{uuid.uuid4().hex}")
    return _named[-1]


def clean(spark: SparkSession) -> int:
    """Removes all working folders named so far, and says how many there were.

    For when results that were made from them have been written elsewhere:
    tables that still read them are of no use afterwards.
    """
    removed = 0
    while _named:
        path = spark._jvm.org.apache.hadoop.fs.Path(_named.pop())
        removed += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return removed
