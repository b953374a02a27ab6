"""Readers, writers, streams over several batches, and the driver contract."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from hushlake.operators import audit
from hushlake.operators.mask import mask
from hushlake.operators.rules import Rule
from hushlake.schemas import REQUESTS
from hushlake.sources import readers, writers
from hushlake.streaming import streams as S

UTC = dt.timezone.utc
RULES = [Rule("A", "a+")]


def test_policy_and_dimensions_from_files(spark, tmp_path):
    (tmp_path / "policy.json").write_text(json.dumps({"enabled": False, "rules": [{"id": "x", "pattern": "y"}]}, indent=1))
    policy = readers.read_policy(spark, str(tmp_path / "policy.json")).first()
    assert policy.enabled is False and policy.rules[0].enabled is True
    (tmp_path / "targets.json").write_text(json.dumps({"proxy_rules": [{"id": "t", "hosts": ["a"], "enabled": True}, 1]}))
    assert [r.hosts for r in readers.read_dimension(spark, str(tmp_path / "targets.json"), "targets").collect()] == [["a"]]


def test_request_documents(spark, tmp_path):
    lines = ['{"id":"r1","timestamp":"2024-01-02T03:04:05Z","status_code":"x"}', "broken", '{"timestamp":"never"}']
    (tmp_path / "log.jsonl").write_text("\n".join(lines) + "\n")
    rows = readers.read_request_documents(spark, str(tmp_path / "log.jsonl")).orderBy("id").collect()
    assert len(rows) == 3 and rows[2].id == "r1" and rows[2].status_code == 0
    assert [r.timestamp for r in rows[:2]] == [None, None]


def test_client_log(spark, tmp_path):
    (tmp_path / "client.log").write_text('{"timestamp":"t","kind":"error","message":"m"}\n{"kind":"query","message":"n","source":"s"}\n')
    rows = readers.read_client_log(spark, str(tmp_path / "client.log")).orderBy("kind").collect()
    assert [(r.kind, r.message, r.source) for r in rows] == [("error", "m", None), ("query", "n", "s")]


def test_purge(spark, tmp_path):
    path = str(tmp_path / "log")
    row = {"id": "1", "timestamp": dt.datetime(2024, 1, 1, tzinfo=UTC)}
    log = spark.createDataFrame([row], REQUESTS)
    log.write.parquet(path)
    writers.purge(readers.read_requests(spark, path), path)
    assert readers.read_requests(spark, path).count() == 0


def test_vault_stays_apart(spark, tmp_path):
    vault = spark.createDataFrame([("1", "<A:0000>", "A", "x")], "scope_id string, placeholder string, type string, value string")
    with pytest.raises(ValueError):
        writers.write_vault(vault, str(tmp_path / "m" / "vault"), str(tmp_path / "m"))
    masked = mask(spark.createDataFrame([(1, "aa b")], "id long, text string"), RULES, "id")
    writers.write_masked(masked, str(tmp_path / "m"))
    stored = spark.read.parquet(str(tmp_path / "m"))
    assert "value" not in stored.schema.simpleString() and "aa" not in stored.first().text
    writers.write_entities(stored, ["id"], str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).first().type == "A"


def test_texts(spark):
    df = spark.createDataFrame([(7, 1, "x")], "scope long, k long, body string")
    assert readers.texts(df, "body", "scope", ["k"]).first().asDict() == {"k": 1, "scope_id": "7", "text": "x"}


def deliver(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder)


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    """Three deliveries, each run to its end and restarted from the checkpoint."""
    source, base = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id string, timestamp timestamp"
    at = lambda minute: dt.datetime(2024, 1, 1, 0, minute, tzinfo=UTC)
    batches = [[("a", at(0)), ("a", at(1)), ("b", at(2))], [("b", at(3)), ("c", at(4))], [("a", at(5)), ("d", at(6))]]
    for batch in batches:
        deliver(spark, source, batch, schema)
        stream = S.stream_requests(spark, source, "json", schema)
        out = S.run_available(S.dedupe_stream(stream), "d", base)
    assert sorted(r.id for r in out.collect()) == ["a", "b", "c", "d"]


def test_windows_close_with_the_watermark(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id string, timestamp timestamp, entity_count bigint"
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m, tzinfo=UTC)
    run = lambda: S.run_available(S.activity_stream(S.stream_requests(spark, source, "json", schema)), "a", base)
    deliver(spark, source, [("a", at(0, 5), 1), ("b", at(0, 50), 2)], schema)
    assert run().count() == 0
    deliver(spark, source, [("c", at(0, 55), 4), ("d", at(1, 20), 8)], schema)
    assert [(r.requests, r.entities) for r in run().collect()] == [(3, 7)]
    deliver(spark, source, [("late", at(0, 1), 16), ("e", at(2, 30), 32)], schema)
    assert sorted((r.requests, r.entities) for r in run().collect()) == [(1, 8), (3, 7)]


def test_masked_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(1, "aa b"), (2, "b")]
    deliver(spark, source, rows, "id long, text string")
    stream = S.stream_requests(spark, source, "json", "id long, text string")
    out = S.run_available(S.mask_stream(stream, RULES, "id"), "m", str(tmp_path / "out"))
    batch = mask(spark.createDataFrame(rows, "id long, text string"), RULES, "id")
    assert sorted(r.text for r in out.collect()) == sorted(r.text for r in batch.collect())


def test_contract(spark):
    import __spark_entry__ as contract

    result = contract.entry(spark)
    assert result.count() > 0 and result.columns == ["doc_id", "text", "replacement_count", "entities"]
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_working_folder_needs_a_shared_place(spark, monkeypatch):
    from hushlake.session import work_dir

    base = spark.conf.get("spark.checkpoint.dir", None)
    made = work_dir(spark, "x")
    assert base is None or made.startswith(base)
    assert work_dir(spark, "x") != made


def _rows_scanned(df):
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


def test_one_request_is_found_in_one_row_group(spark, tmp_path):
    """Small row groups: all but the one with the id are left out by its order and its Bloom filter."""
    import hashlib

    path, day = str(tmp_path / "log"), dt.datetime(2024, 1, 1, tzinfo=UTC)
    name = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    rows = [(name(i), day + dt.timedelta(hours=i % 72), "x" * 50) for i in range(30_000)]
    log = spark.createDataFrame(rows, "id string, timestamp timestamp, path string")
    # Two appends: each date has two files whose ids lie in the same range.
    for part in (log.filter("substring(id, 64, 1) < '8'"), log.filter("substring(id, 64, 1) >= '8'")):
        writers.write_requests(part, path, **{"parquet.block.size": "65536", "parquet.page.row.count.limit": "200", "parquet.block.row.count.limit": "1000"})
    stored = spark.read.schema(log.schema.add("date", "date")).parquet(path)
    found = audit.request_detail(stored, name(77))
    assert [r.path for r in found.collect()] == ["x" * 50]
    assert 1 <= _rows_scanned(found) <= 1000
    missing = audit.request_detail(stored, name(99_999))
    assert missing.collect() == [] and _rows_scanned(missing) <= 1000
    dated = audit.request_detail(stored, name(77), (day + dt.timedelta(hours=77 % 72)).date())
    assert dated.count() == 1 and "PartitionFilters: [isnotnull(date" in dated._jdf.queryExecution().executedPlan().toString()


def test_recording_by_settings(spark):
    detail = spark.createDataFrame(
        [("r1", "a"), ("r2", "b"), ("r3", "c"), ("r4", None)], "id string, tenant string"
    ).selectExpr("id", "tenant", "array(named_struct('path', id)) AS fields", "id AS raw_request", "id AS raw_response")
    settings = spark.createDataFrame([("a", True, False), ("b", None, True)], "tenant string, record_request_content boolean, record_raw_request boolean")
    kept = {r.id: (r.fields is not None, r.raw_request, r.raw_response) for r in audit.apply_recording_settings(detail, settings, "tenant").collect()}
    assert kept == {"r1": (True, None, None), "r2": (False, "r2", "r2"), "r3": (False, None, None), "r4": (False, None, None)}
    assert audit.apply_recording_settings(detail.select("id", "tenant"), settings, "tenant").columns == ["id", "tenant"]


def test_recording_reads_what_is_selected(spark, tmp_path):
    detail = spark.range(9).selectExpr("string(id) AS id", "'a' AS tenant", "array('f') AS fields", "'q' AS raw_request", "'p' AS raw_response")
    detail.write.parquet(str(tmp_path / "d"))
    settings = spark.createDataFrame([("a", True, True)], "tenant string, record_request_content boolean, record_raw_request boolean")
    kept = audit.apply_recording_settings(spark.read.parquet(str(tmp_path / "d")), settings, "tenant").select("id", "raw_request")
    assert "ReadSchema: struct<id:string,tenant:string,raw_request:string>" in kept._jdf.queryExecution().executedPlan().toString()


def test_working_folders_are_removed_on_demand(spark, tmp_path, monkeypatch):
    from hushlake import session

    monkeypatch.setattr(session, "_named", [])
    monkeypatch.setattr(session.tempfile, "mkdtemp", lambda prefix: str(tmp_path))
    made = session.work_dir(spark, "kept")
    spark.range(3).write.parquet(made)
    session.work_dir(spark, "never-written")
    (tmp_path / "other").mkdir()
    assert spark.read.parquet(made).count() == 3
    assert session.clean(spark) == 1 and session.clean(spark) == 0
    assert [p.name for p in tmp_path.iterdir()] == ["other"]
