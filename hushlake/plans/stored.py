"""Tables written to the shared folder and read back through the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushlake.operators import audit
from hushlake.operators.mask import mask
from hushlake.operators.routing import url_host
from hushlake.operators.vault import build_vault, islands_table
from hushlake.plans.documents_json import REQUEST_COLUMNS_SQL, docs_sql, json_documents, request_columns
from hushlake.plans.logs import DETAIL_SQL, ROW_SQL, detail_rows, request_rows
from hushlake.plans.masking import DOC_ISLANDS
from hushlake.plans.registry import query
from hushlake.plans.tables import AS_OF, REQUESTS_SQL, RULES, details, documents, requests
from hushlake.schemas import VAULT
from hushlake.session import work_dir
from hushlake.sources import readers, writers
from hushlake.streaming.streams import run_available, stream_requests


@query(
    "stored_requests",
    f"WITH {REQUESTS_SQL} SELECT {ROW_SQL} FROM requests WHERE timestamp >= TIMESTAMP '2024-01-08 12:00:00'",
)
def stored_requests(spark, sf_dir):
    """Written by date, read with retention: only folders inside it are opened."""
    path = work_dir(spark, "requests")
    writers.write_requests(requests(spark, sf_dir), path)
    stored = spark.read.schema(requests(spark, sf_dir).schema.add("date", "date")).parquet(path)
    return request_rows(audit.apply_retention(stored, AS_OF, 7))


@query("stored_detail", f"WITH {REQUESTS_SQL} SELECT {DETAIL_SQL} FROM requests")
def stored_detail(spark, sf_dir):
    """Typed JSON lines."""
    path = work_dir(spark, "detail")
    details(spark, sf_dir).write.json(path)
    return detail_rows(readers.read_requests(spark, path, "json", detail=True))


@query(
    "stored_documents",
    f"WITH {docs_sql('request')} SELECT {REQUEST_COLUMNS_SQL} FROM docs",
)
def stored_documents(spark, sf_dir):
    """Lines of untrusted JSON, through the strict decoder; a time that is none is null."""
    path = work_dir(spark, "documents")
    json_documents(spark, sf_dir, "request").select("json").write.text(path)
    read = readers.read_request_documents(spark, path).select(*request_columns())
    written = F.coalesce(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))
    return read.withColumn("timestamp", written)


@query("stored_client_log", "SELECT 'query' AS kind, text AS message, source FROM documents")
def stored_client_log(spark, sf_dir):
    path = work_dir(spark, "client-log")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.select(F.lit("query").alias("kind"), F.col("text").alias("message"), "source").write.json(path)
    return readers.read_client_log(spark, path).select("kind", "message", "source")


@query("stored_vault", f"WITH {DOC_ISLANDS} SELECT DISTINCT CAST(doc_id AS VARCHAR) AS scope_id, replacement AS placeholder, type, value FROM islands")
def stored_vault(spark, sf_dir):
    """Raw values go to a place of their own."""
    path, apart = work_dir(spark, "masked"), work_dir(spark, "vault")
    docs = documents(spark, sf_dir)
    writers.write_vault(build_vault(islands_table(docs, RULES, "doc_id")), apart, path)
    return spark.read.schema(VAULT).parquet(apart)


@query(
    "stored_entities",
    f"WITH {DOC_ISLANDS} SELECT doc_id, CAST(doc_id AS VARCHAR) AS scope_id, type, replacement, confidence, sources FROM islands",
)
def stored_entities(spark, sf_dir):
    base = work_dir(spark, "masked")
    masked = mask(documents(spark, sf_dir), RULES, "doc_id")
    writers.write_masked(masked, f"{base}/texts")
    writers.write_entities(spark.read.schema(masked.schema).parquet(f"{base}/texts"), ["doc_id"], f"{base}/entities")
    return spark.read.parquet(f"{base}/entities").withColumn("sources", F.array_join("sources", ","))


@query("tail_requests", f"WITH {REQUESTS_SQL} SELECT {ROW_SQL} FROM requests")
def tail_requests(spark, sf_dir):
    """The log followed as a stream."""
    path = work_dir(spark, "tail")
    requests(spark, sf_dir).drop("event_id", "user_id", "k").write.parquet(path)
    return request_rows(run_available(stream_requests(spark, path), "tailed"))


@query("purged_requests", f"WITH {REQUESTS_SQL} SELECT {ROW_SQL} FROM requests WHERE event_id % 3 = 1")
def purged_requests(spark, sf_dir):
    """The log by date, cleared, then written to again."""
    path, log = work_dir(spark, "purged"), requests(spark, sf_dir)
    writers.write_requests(log, path)
    stored = spark.read.schema(log.schema.add("date", "date")).parquet(path)
    writers.purge(stored, path)
    writers.write_requests(log.filter("event_id % 3 = 1"), path)
    return request_rows(spark.read.schema(log.schema.add("date", "date")).parquet(path))


@query(
    "stored_policy",
    """SELECT DISTINCT event_type AS rule_id, user_id % 2 = 0 AS enabled, CAST(1 AS BIGINT) AS n_rules, CAST(2 AS BIGINT) AS n_types
FROM events""",
)
def stored_policy(spark, sf_dir):
    """Policy documents from files, one for each kind of event and parity of user."""
    path = work_dir(spark, "policy")
    kinds = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", (F.col("user_id") % 2 == 0).alias("even")).distinct()
    rule = F.array(F.struct(F.col("event_type").alias("id"), F.lit("a+").alias("pattern")))
    types = F.from_json(F.lit('[{"type": "URL"}, {"type": "PIN", "enabled": false}]'), "array<struct<type string, enabled boolean>>")
    body = F.to_json(F.struct(F.col("even").alias("enabled"), types.alias("entity_types"), rule.alias("rules")))
    folder = F.concat_ws("-", "event_type", "even")
    # A file is a document, so each goes to a folder and file of its own.
    kinds.select(folder.alias("document"), body.alias("value")).repartition("document").write.partitionBy("document").text(path)
    read = readers.read_policy(spark, f"{path}/*/*.txt")
    return read.select(
        F.element_at("rules.id", 1).alias("rule_id"), "enabled", F.size("rules").cast("bigint").alias("n_rules"),
        F.size("entity_types").cast("bigint").alias("n_types"),
    )


@query(
    "stored_dimensions",
    """WITH hosts AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host FROM pages)
SELECT 'upstreams' AS kind, host AS id, true AS enabled FROM hosts UNION ALL SELECT 'targets', host, false FROM hosts
UNION ALL SELECT 'profiles', host, CAST(NULL AS BOOLEAN) FROM hosts UNION ALL SELECT 'models', host, CAST(NULL AS BOOLEAN) FROM hosts""",
)
def stored_dimensions(spark, sf_dir):
    """Documents that list providers, targets, profiles and models, made from the hosts of the pages."""
    base = work_dir(spark, "dimensions")
    hosts = spark.read.parquet(f"{sf_dir}/pages.parquet").select(url_host(F.col("url")).alias("id")).distinct()
    found = None
    for kind, member in (("upstreams", "upstreams"), ("targets", "proxy_rules"), ("profiles", "profiles"), ("models", "models")):
        one = F.to_json(F.struct(F.array(F.struct("id", F.lit(kind == "upstreams").alias("enabled"))).alias(member)))
        hosts.select(F.col("id").alias("document"), one.alias("value")).write.partitionBy("document").text(f"{base}/{kind}")
        read = readers.read_dimension(spark, f"{base}/{kind}/*/*.txt", kind)
        enabled = F.col("enabled") if "enabled" in read.columns else F.lit(None).cast("boolean")
        part = read.select(F.lit(kind).alias("kind"), "id", enabled.alias("enabled"))
        found = part if found is None else found.unionByName(part)
    return found


@query("stored_texts", "SELECT CAST(conv_id AS VARCHAR) AS scope_id, turn, text FROM conversations")
def stored_texts(spark, sf_dir):
    """Any table as texts to be masked."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return readers.texts(table, "text", "conv_id", ["turn"]).select("scope_id", "turn", "text")
