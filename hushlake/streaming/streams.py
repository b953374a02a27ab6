"""The operators over streams.

Masking keeps no state. Windows and sessions keep state that the watermark
bounds: it holds what is still open, not the past. What they have closed lies in
the sink, each window once; what is open is read from the state itself. Routing
and re-delivery go batch by batch, with tables in place of state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.operators.mask import Policy, mask
from hushlake.operators.routing import match_targets
from hushlake.operators.rules import Rule
from hushlake.schemas import REQUESTS
from hushlake.session import work_dir


def stream_requests(spark: SparkSession, path: str, format: str = "parquet", schema: str = REQUESTS, **options: str) -> DataFrame:
    """Follow a growing request log."""
    return spark.readStream.schema(schema).options(**options).format(format).load(path)


def mask_stream(texts: DataFrame, rules: list[Rule], scope: str, policy: Policy = Policy(), text: str = "text") -> DataFrame:
    return mask(texts, rules, scope, text=text, policy=policy)


def activity_stream(requests: DataFrame, width: str = "1 hour", delay: str = "10 minutes", ts: str = "timestamp") -> DataFrame:
    """Requests and entities in each closed window of time."""
    return (
        requests.withWatermark(ts, delay)
        .groupBy(F.window(ts, width))
        .agg(F.count(F.lit(1)).alias("requests"), F.sum("entity_count").alias("entities"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "requests", "entities")
    )


def open_activity(state: DataFrame) -> DataFrame:
    """The windows of ``activity_stream`` that are still open."""
    return state.select("key.window.*", F.col("value.count").alias("requests"), F.col("value.sum").alias("entities"))


def tpm_stream(
    requests: DataFrame, width: int = 5, slide: int = 1, delay: str = "10 minutes", ts: str = "timestamp"
) -> DataFrame:
    """Tokens per minute over the last ``width`` minutes, every ``slide`` minutes."""
    return _rates(
        requests.withWatermark(ts, delay)
        .groupBy(F.window(ts, f"{width} minutes", f"{slide} minutes"))
        .agg(F.sum("token_usage.total").alias("sum"))
        .select("window.*", "sum"),
        width,
    )


def open_tpm(state: DataFrame, width: int = 5) -> DataFrame:
    """The windows of ``tpm_stream`` that are still open."""
    return _rates(state.select("key.window.*", "value.sum"), width)


def _rates(windows: DataFrame, width: int) -> DataFrame:
    tokens = F.coalesce("sum", F.lit(0).cast("bigint"))
    return windows.select("start", "end", tokens.alias("tokens"), (tokens / width).alias("tokens_per_minute"))


def cache_stream(uses: DataFrame, key: str, ttl: str = "900 seconds", delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Closed lives of cache entries: one miss opens each, all further uses are hits.

    Uses of a key are merged to sessions in each task before they are shuffled.
    """
    return _lives(
        uses.withWatermark(ts, delay)
        .groupBy(key, F.session_window(ts, ttl))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(key, "session_window.*", "count"),
        key,
    )


def open_cache(state: DataFrame, key: str) -> DataFrame:
    """The lives of ``cache_stream`` that are still open."""
    return _lives(state.select(f"value.{key}", "value.session_window.*", "value.count"), key)


def _lives(sessions: DataFrame, key: str) -> DataFrame:
    return sessions.select(key, "start", "end", F.lit(1).cast("bigint").alias("misses"), (F.col("count") - 1).alias("hits"))


def dedupe_stream(requests: DataFrame, delay: str = "1 hour", ts: str = "timestamp") -> DataFrame:
    """Drop re-delivered rows. Unlike the batch form, the first delivery is kept.

    Every delivery goes to the task that keeps its id's state; where an id may
    be hot, use ``dedupe_available``.
    """
    return requests.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["id"])


def _run(stream: DataFrame, base: str, sink: Callable) -> None:
    writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    sink(writer).start().awaitTermination()


def run_available(stream: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Process what is there, append it to Parquet and read that back.

    Sink and checkpoint lie in the shared folder, so the run survives the loss
    of executors and of the driver. Windows that the watermark has not closed
    stay in the state; ``run_bounded`` gives them too.
    """
    base = path or work_dir(stream.sparkSession, name)
    _run(stream, base, lambda w: w.format("parquet").outputMode("append").option("path", f"{base}/data"))
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/data")


def run_bounded(windows: DataFrame, open_windows: Callable[[DataFrame], DataFrame], name: str, path: str | None = None) -> DataFrame:
    """Process what is there and give every window, those still open at its end included.

    Closed windows are appended to the sink, which knows the batches it holds,
    and leave the state. Open ones are read from the state as the last batch
    left it, so they stay open: a later run over the same folder goes on with
    them, and one without new rows gives the same answer.
    """
    base = path or work_dir(windows.sparkSession, name)
    closed = run_available(windows, name, base)
    state = windows.sparkSession.read.format("statestore").load(f"{base}/checkpoint")
    return closed.unionByName(open_windows(state).select(closed.columns))


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], DataFrame], schema: str, name: str, path: str | None = None) -> DataFrame:
    """Process what is there, keep what ``each`` makes of a batch and its number, and read all of it back.

    A batch writes a folder of its own, so one that is repeated after a failure
    replaces what it wrote before.
    """
    spark = stream.sparkSession
    base = path or work_dir(spark, name)
    # An empty batch from the start: there is always something to read.
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{base}/data/__batch=-1")

    def keep(batch: DataFrame, number: int) -> None:
        each(batch, number).write.mode("overwrite").parquet(f"{base}/data/__batch={number}")

    _run(stream, base, lambda w: w.foreachBatch(keep))
    return read_batches(spark, schema, base).drop("__batch")


def read_batches(spark: SparkSession, schema: str, base: str) -> DataFrame:
    """What the batches of a run wrote, with the batch's number in ``__batch``."""
    return spark.read.schema(f"{schema}, __batch bigint").option("basePath", f"{base}/data").parquet(f"{base}/data")


def route_available(
    requests: DataFrame, targets_path: str, schema: str, name: str = "route", path: str | None = None, host: str = "target_host"
) -> DataFrame:
    """Route a stream by the targets as they stand when a batch begins.

    Each batch reads the latest version of the table, so an edit takes effect
    with the next one, and looks up its distinct hosts by an equality join.
    """
    return run_batches(
        requests, lambda batch, _: match_targets(batch, read_targets(batch.sparkSession, targets_path), host), schema, name, path
    )


TARGETS = "id string, hosts array<string>, profile_id string, enabled boolean"


def store_targets(targets: DataFrame, path: str, version: int) -> None:
    """A version of the target table, in a folder of its own."""
    targets.select("id", "hosts", "profile_id", "enabled").write.mode("overwrite").parquet(f"{path}/version={version}")


def read_targets(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the target table, by default the latest; only its folder is opened."""
    stored = spark.read.schema(f"{TARGETS}, version int").parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.filter(F.col("version") == version).drop("version")


def dedupe_available(
    requests: DataFrame, schema: str, name: str = "dedupe", path: str | None = None, ts: str = "timestamp", delay: str = "1 hour"
) -> DataFrame:
    """Drop re-delivered rows, across batches and restarts; the first delivery is kept.

    A batch is reduced to one row for each id before the shuffle: of equal ids
    in one batch the earliest in time stays. Then ids that an earlier batch kept
    are looked up in what it wrote: only the column ``id``, and only days that
    lie within ``delay`` of the batch. Nothing is held in memory between batches.
    """
    spark = requests.sparkSession
    base = path or work_dir(spark, name)
    stored = f"{schema}, __date date"
    names = [c for c in requests.columns if c != "id"]

    def fresh(batch: DataFrame, number: int) -> DataFrame:
        order = F.struct(F.col(ts).isNull(), F.col(ts), F.xxhash64(*names))
        first = batch.groupBy("id").agg(F.min_by(F.struct(*names), order).alias("__first")).select("id", "__first.*")
        first = first.withColumn("__date", F.to_date(ts)).select(*requests.columns, "__date")
        # Written once, so that what follows does not read the source again.
        staged = f"{base}/staged/{number}"
        first.write.mode("overwrite").parquet(staged)
        first = spark.read.schema(stored).parquet(staged)
        margin = F.expr(f"interval {delay}")
        low, high = first.agg(F.to_date(F.min(ts) - margin), F.to_date(F.max(ts) + margin)).first()
        near = F.col("__date").isNull() | F.col("__date").between(F.lit(low), F.lit(high))
        kept = read_batches(spark, stored, base).filter(F.col("__batch") < number).filter(near)
        # The semi-join leaves of the kept ids those of this batch; its small side is broadcast by measured size.
        known = kept.select("id").join(first.select("id"), "id", "left_semi")
        return first.join(known, "id", "left_anti")

    return run_batches(requests, fresh, stored, name, base).drop("__date")
