"""A detection cache in files: a text met again within the time to live is not searched again.

Each run writes, for every distinct text it met, the text's hash and what was
found in it, under the run's time. So a use renews the expiry, an entry is live
if its last use is no older than the time to live, and older runs' folders are
never opened. Entries belong to the rules they were made with. Texts themselves
are not stored; found values are, as in a vault: keep the folder apart.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.functions.once import compute_once
from hushlake.operators.detect import has_match, with_spans
from hushlake.operators.ranges import instant
from hushlake.operators.rules import Rule
from hushlake.operators.sides import BROADCAST_BYTES, byte_count
from hushlake.operators.spans import NO_SPANS
from hushlake.session import work_dir

ENTRIES = f"key string, spans {NO_SPANS}, fresh boolean, rules string, at bigint"


def rules_key(rules: list[Rule]) -> str:
    """Tells one list of rules from another: ids, patterns and their order."""
    return hashlib.sha256(json.dumps([(r.id, r.pattern) for r in rules]).encode()).hexdigest()[:16]


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """All that runs have written: key, spans, whether that run searched the text, rules, and the run's time in seconds."""
    return spark.read.schema(ENTRIES).option("basePath", path).parquet(path)


def live_entries(spark: SparkSession, path: str, rules: list[Rule], as_of: dt.datetime, ttl_seconds: int = 900) -> DataFrame:
    """key and spans of the entries whose last use is no older than the time to live. Other folders are pruned."""
    now = int(instant(as_of).timestamp())
    near = F.col("at").between(now - ttl_seconds, now) & (F.col("rules") == rules_key(rules))
    # Equal keys of several runs hold equal spans.
    return read_cache(spark, path).filter(near).groupBy("key").agg(F.any_value("spans").alias("spans"))


def _hash(text: str) -> Column:
    return F.sha2(F.col(text), 256)


def detect_cached(
    df: DataFrame, rules: list[Rule], path: str, as_of: dt.datetime, ttl_seconds: int = 900, *, text: str = "text", into: str = "spans",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """``df`` without its text, with the spans of each text; texts with a live entry are not searched.

    Hashes are reduced to distinct ones before they are shuffled. Of the unseen
    texts only those in which some rule matches are shuffled, and copies are
    combined before; the others need no more than their hash.
    """
    spark = df.sparkSession
    now = int(instant(as_of).timestamp())
    # An empty run makes sure that there is a folder to read.
    empty = spark.createDataFrame([], "key string, spans " + NO_SPANS + ", fresh boolean")
    empty.write.mode("ignore").parquet(f"{path}/rules=none/at=0")
    keyed = df.withColumn(text, F.make_valid_utf8(text)).withColumn("__key", _hash(text))
    known = live_entries(spark, path, rules, as_of, ttl_seconds)
    used = keyed.filter(F.col("__key").isNotNull()).select(F.col("__key").alias("key")).distinct()
    met = work_dir(spark, "cache-met")
    used.join(known, "key", "left").write.parquet(met)
    met = spark.read.schema("key string, spans " + NO_SPANS).parquet(met)
    unseen = met.filter("spans IS NULL").select(F.col("key").alias("__key"))
    size = unseen.agg(byte_count()).first()[0]
    if size <= limit:
        # Few new texts: their hashes go to the texts, and no other text is searched.
        texts = keyed.join(F.broadcast(unseen), "__key", "left_semi")
        hits = compute_once(texts, {"__hit": F.expr(has_match(text, rules))}).filter("__hit")
    else:
        # Many: a search in place comes first, so that only texts with a match are shuffled.
        hits = keyed.filter(F.expr(has_match(text, rules))).join(unseen, "__key", "left_semi")
    found = with_spans(hits.select("__key", text).dropDuplicates(["__key"]), rules, text, "__found")
    found = found.select(F.col("__key").alias("key"), "__found")
    # An unseen text without a match has been searched too; nothing was found.
    spans = F.coalesce("spans", "__found", F.array().cast(NO_SPANS))
    rows = met.join(found, "key", "left").select("key", spans.alias("spans"), F.col("spans").isNull().alias("fresh"))
    rows.write.mode("append").parquet(f"{path}/rules={rules_key(rules)}/at={now}")
    written = read_cache(spark, path).filter((F.col("rules") == rules_key(rules)) & (F.col("at") == now))
    results = written.filter(F.size("spans") > 0).groupBy(F.col("key").alias("__key")).agg(F.any_value("spans").alias("__spans"))
    others = [c for c in df.columns if c != text]
    joined = keyed.select(*others, "__key").join(results, "__key", "left")
    return joined.select(*others, F.coalesce("__spans", F.array().cast(NO_SPANS)).alias(into))


def cache_runs(spark: SparkSession, path: str) -> DataFrame:
    """For each run: its time, distinct texts met, and how many of them were searched."""
    runs = read_cache(spark, path).filter("rules <> 'none'").groupBy("rules", "at")
    return runs.agg(F.count_distinct("key").alias("texts"), F.count_if("fresh").alias("searched"))
