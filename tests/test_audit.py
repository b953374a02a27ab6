"""Request log, statistics, policy and routing: hand-computed cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hushlake.operators import audit, policy, stats
from hushlake.operators.mask import Policy
from hushlake.operators.ranges import day_bounds, range_bounds
from hushlake.operators.routing import match_targets, protection_mode, route_upstream
from hushlake.schemas import DETAIL, REQUESTS

UTC = dt.timezone.utc


def log(spark, rows, schema=REQUESTS):
    """Requests with given columns; the rest is null."""
    from pyspark.sql.types import _parse_datatype_string

    names = _parse_datatype_string(schema).names
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def test_search_runs_across_columns(spark):
    df = log(spark, [{"id": "1", "upstream_id": "Up", "model": "GPT", "path": "/v1"}, {"id": "2", "upstream_id": "up", "path": "/x"}])
    found = lambda q: {r.id for r in audit.search_requests(df, q).collect()}
    assert found("pgpt/") == {"1"} and found("UP/X") == {"2"} and found("") == {"1", "2"} and found("none") == set()


def test_unprotected_falls_back_to_the_operation(spark):
    rows = [
        {"id": "1", "protection_mode": "redacted", "operation_id": "chat"},
        {"id": "2", "protection_mode": None, "operation_id": "disabled"},
        {"id": "3", "protection_mode": "passthrough", "operation_id": "chat"},
        {"id": "4", "protection_mode": "redacted", "operation_id": "passthrough"},
        {"id": "5", "protection_mode": None, "operation_id": None},
    ]
    df = log(spark, rows)
    assert {r.id for r in audit.by_protection(df, "unredacted").collect()} == {"2", "3", "4"}
    assert {r.id for r in audit.by_protection(df, "redacted").collect()} == {"1", "5"}
    assert audit.by_protection(df).count() == 5
    labels = {r.id: r.protection for r in audit.request_properties(df).collect()}
    assert labels == {"1": "redacted", "2": "disabled", "3": "passthrough", "4": "passthrough", "5": "redacted"}


def test_day_has_23_hours_when_clocks_go_forward():
    start, end = day_bounds(dt.date(2024, 3, 31), "Europe/Berlin")
    assert end - start == dt.timedelta(hours=23)
    assert start == dt.datetime(2024, 3, 30, 23, tzinfo=UTC)


def test_ranges():
    as_of = dt.datetime(2024, 1, 15, 12)
    today, yesterday, week = (range_bounds(n, as_of) for n in ("today", "yesterday", "7d"))
    assert (today.minutes, yesterday.minutes, week.minutes) == (720, 1440, 6 * 1440 + 720)
    assert (today.granularity, week.granularity, week.first_date) == ("hour", "day", dt.date(2024, 1, 9))
    assert range_bounds("today", as_of, "Asia/Tokyo").start == dt.datetime(2024, 1, 14, 15, tzinfo=UTC)


def test_dedupe_and_page(spark):
    rows = [{"id": i, "status_code": s, "timestamp": dt.datetime(2024, 1, 1, 0, t, tzinfo=UTC)} for i, s, t in
            [("a", 1, 1), ("b", 2, 2), ("a", 3, 3), ("c", 4, 3)]]
    df = log(spark, rows).withColumn("pos", F.monotonically_increasing_id())
    once = audit.dedupe_requests(df)
    assert sorted((r.id, r.status_code) for r in once.collect()) == [("a", 3), ("b", 2), ("c", 4)]
    first = once.agg(F.min_by("id", "pos")).first()[0]
    assert first == "a"
    page = sorted(audit.page(once, 0, 2).collect(), key=lambda r: r.id)
    assert [(r.id, r.has_more, r.next_offset) for r in page] == [("a", True, 2), ("c", True, 2)]
    assert [(r.id, r.has_more, r.next_offset) for r in audit.page(once, 2, 2).collect()] == [("b", False, None)]


def test_deep_pages_equal_a_full_sort(spark):
    rng = random.Random(4)
    moments = [None if i % 40 == 0 else dt.datetime(2024, 1, 1, 0, rng.randint(0, 20), rng.randint(0, 3), tzinfo=UTC) for i in range(400)]
    df = log(spark, [{"id": f"r{i:03}", "timestamp": t} for i, t in enumerate(moments)])
    order = sorted(range(400), key=lambda i: (moments[i] is None, -moments[i].timestamp() if moments[i] else 0, i))
    for offset in (0, 50, 199, 380, 391, 399, 400, 900):
        rows = sorted(audit.page(df, offset, 9).collect(), key=lambda r: order.index(int(r.id[1:])))
        assert [int(r.id[1:]) for r in rows] == order[offset : offset + 9]
        assert {(r.has_more, r.next_offset) for r in rows} <= {(offset + 9 < 400, offset + 9 if offset + 9 < 400 else None)}


def test_recording_gate_and_retention(spark):
    row = {
        "id": "1", "timestamp": dt.datetime(2024, 1, 1, tzinfo=UTC), "fields": [("p", "o", "r", [])],
        "raw_request": ("GET", "u", {}, ""), "raw_response": (200, {"a": ["b"]}, None),
    }
    df = log(spark, [row], DETAIL)
    kept = audit.apply_recording(df, False, True).first()
    assert kept["fields"] is None and kept["raw_request"] is not None
    kept = audit.apply_recording(df, True, False).first()
    assert kept["fields"] is not None and kept["raw_request"] is None and kept["raw_response"] is None
    exchange = audit.raw_exchange(df).first()
    assert (exchange.request_headers, exchange.response_headers, exchange.request_body) == ("—", "a: b", "—")
    assert audit.apply_retention(df, dt.datetime(2024, 1, 31), 30).count() == 1
    assert audit.apply_retention(df, dt.datetime(2024, 1, 31, 0, 0, 1), 30).count() == 0
    assert [tuple(r) for r in audit.field_counts(df).collect()] == [("1", "p", 0)]


def test_statistics_of_nothing(spark):
    empty = log(spark, [])
    row = stats.audit_stats(empty, "today", dt.datetime(2024, 1, 1, 6)).first()
    assert (row.requests, row.success_rate, row.cache_hit_percent, row.tokens_per_minute) == (0, 0.0, 0, 0.0)
    series = stats.activity_series(empty, "today", dt.datetime(2024, 1, 1, 6))
    assert series.count() == 24 and stats.series_peak(series).first().peak == 1


def test_local_series(spark):
    df = log(spark, [{"id": "1", "timestamp": dt.datetime(2024, 1, 1, 22, 30, tzinfo=UTC), "entity_count": 2}])
    series = stats.activity_series(df, "today", dt.datetime(2024, 1, 2, 6), "Asia/Tokyo")
    assert [(r.date, r.entities) for r in series.collect() if r.requests] == [("2024-01-02T07:00", 2)]


def test_effective_types(spark):
    types = spark.createDataFrame([(0, "URL", False), (1, "X", False), (2, "URL", True), (3, "X", True)], "pos int, type string, enabled boolean")
    rows = policy.effective_types(types).orderBy("pos").collect()
    assert [r.type for r in rows] == [*policy.BUILT_IN_TYPES, "X"]
    assert {r.type: r.enabled for r in rows if r.type in ("URL", "X", "PERSON")} == {"URL": False, "X": False, "PERSON": True}
    assert policy.effective_types(types.limit(0)).count() == len(policy.BUILT_IN_TYPES)


def test_labels_of_the_first_active_model(spark):
    schema = "pos int, active boolean, entity_types map<string,string>"
    labels = lambda rows: sorted(r.value for r in policy.active_labels(spark.createDataFrame(rows, schema)).collect())
    assert labels([(0, False, {"0": "Z"}), (1, True, {"0": " A ", "1": "A", "2": " "}), (2, True, {"0": "B"})]) == ["A"]
    assert labels([(0, True, {}), (1, True, {"0": "B"})]) == sorted(policy.BUILT_IN_TYPES)
    assert labels([(0, False, {"0": "B"})]) == sorted(policy.BUILT_IN_TYPES)
    assert labels([(0, True, {"0": " "})]) == []


def test_switch_patch_and_history(spark):
    types = spark.createDataFrame([(0, "A", True), (1, "A", True), (2, "B", True)], "pos int, type string, enabled boolean")
    changes = spark.createDataFrame([("A", False), ("C", False)], "type string, enabled boolean")
    assert sorted((r.type, r.enabled) for r in policy.set_switch(types, changes).collect()) == [
        ("A", False), ("A", False), ("B", True), ("C", False),
    ]
    history = spark.createDataFrame([("u", 1, "put", "x"), ("u", 2, "delete", None), ("u", 3, "put", "y"), ("v", 4, "put", "z"), ("v", 5, "delete", None)],
                                    "id string, seq int, op string, url string")
    assert [(r.id, r.url) for r in policy.config_snapshot(history, ["id"]).collect()] == [("u", "y")]


def test_config_checks(spark):
    providers = spark.createDataFrame(
        [("a", "u", "p", "managed", None, True), ("a", "u", "p", "managed", " ", False), (" ", "u", "p", "passthrough", None, True)],
        "id string, base_url string, profile_id string, credential_mode string, api_key string, is_new boolean",
    )
    assert [r.valid for r in policy.validate_upstreams(providers).collect()] == [False, True, False]
    lines = spark.createDataFrame([(" a.b \r\n\n *.c \r\n",)], "lines string")
    assert policy.clean_hosts(lines, "lines").first().hosts == ["a.b", "*.c"]


@pytest.mark.parametrize("limit", [None, 0])
def test_target_precedence(spark, monkeypatch, limit):
    """The same with and without broadcasting."""
    if limit is not None:
        monkeypatch.setattr("hushlake.operators.sides.measured.__defaults__", (limit, None))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    targets = spark.createDataFrame(
        [
            ("t1", ["*.example.com"], "p1", True), ("t2", ["*.a.example.com", "a.example.com"], "p2", True),
            ("t3", ["A.example.com:443"], "p3", True), ("t0", ["a.example.com"], "p0", False), ("t4", ["*.example.com:8080"], "p4", True),
            ("t11", ["x.example.com:8080", " "], "p5", True),
        ],
        "id string, hosts array<string>, profile_id string, enabled boolean",
    )
    hosts = {
        "example.com": None, "b.example.com": "t1", "A.Example.Com": "t2", "a.example.com:443": "t2", "c.a.example.com": "t2",
        "d.c.b.example.com": "t1", "b.example.com:8080": "t1", "x.example.com:8080": "t11", "x.example.com:1": "t1", "com": None, "": None,
    }
    requests = spark.createDataFrame([(h,) for h in [*hosts, None]], "target_host string")
    out = match_targets(requests, targets)
    try:
        found = {r.target_host: (r.target_id, r.route) for r in out.collect()}
        assert ("BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()) == (limit is None)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found.pop(None) == (None, "passthrough")
    assert found == {h: (t, "protected" if t else "passthrough") for h, t in hosts.items()}


def test_provider_route_and_mode(spark):
    upstreams = spark.createDataFrame([("a", "u", "p", True), ("b", "u", "p", False)], "id string, base_url string, profile_id string, enabled boolean")
    paths = spark.createDataFrame([("/proxy/a/v1",), ("/proxy/b/v1",), ("/v1/a",), ("/proxy/c",)], "path string")
    assert {r.path: r.routed_upstream for r in route_upstream(paths, upstreams).collect()} == {
        "/proxy/a/v1": "a", "/proxy/b/v1": None, "/v1/a": None, "/proxy/c": None,
    }
    modes = spark.createDataFrame([(True,), (False,)], "g boolean").select(
        protection_mode(F.col("g"), Policy()).alias("m"), protection_mode(F.col("g"), Policy(enabled=False)).alias("off")
    )
    assert [tuple(r) for r in modes.collect()] == [("redacted", "disabled"), ("passthrough", "disabled")]
