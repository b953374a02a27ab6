"""Streams that stay bounded and go on after a restart, over several deliveries."""

import datetime as dt

import pytest
from measure import shuffled

from hushlake.streaming import streams as S

UTC = dt.timezone.utc
LOG = "id string, timestamp timestamp, entity_count bigint, token_usage struct<total bigint>"


def at(minute, second=0):
    return dt.datetime(2024, 1, 1, tzinfo=UTC) + dt.timedelta(minutes=minute, seconds=second)


def deliver(spark, folder, rows, schema, files=1):
    spark.createDataFrame(rows, schema).repartition(files).write.mode("append").parquet(folder)


def log_rows(minutes, ids="r"):
    return [(f"{ids}{m}", at(m), m % 5, (m,)) for m in minutes]


def windows(rows, width, slide):
    """Requests, entities and tokens of all windows, in minutes from the start."""
    out = {}
    for _, when, n, (tokens,) in rows:
        minute = int((when - at(0)).total_seconds() // 60)
        for start in range(minute // slide * slide, minute - width, -slide):
            k, e, t = out.get(start, (0, 0, 0))
            out[start] = (k + 1, e + n, t + tokens)
    return out


def minutes(row):
    return int((row.start.replace(tzinfo=UTC) - at(0)).total_seconds() // 60)


@pytest.mark.parametrize("kind", ["activity", "tpm"])
def test_bounded_windows_over_restarts(spark, tmp_path, kind):
    """Open windows are given, stay open and go on; the state holds the open ones alone."""
    source, base = str(tmp_path / "in"), str(tmp_path / "out")
    stream = lambda: S.stream_requests(spark, source, schema=LOG)
    width, slide = (60, 60) if kind == "activity" else (5, 1)
    run = {
        "activity": lambda: S.run_bounded(S.activity_stream(stream()), S.open_activity, "a", base),
        "tpm": lambda: S.run_bounded(S.tpm_stream(stream()), S.open_tpm, "t", base),
    }[kind]
    seen = []
    for minutes_ in (range(0, 600, 7), range(601, 660, 3), range(660, 1000, 11)):
        rows = log_rows(minutes_)
        deliver(spark, source, rows, LOG)
        seen += rows
        for _ in range(2):  # the second time there is nothing new
            found = {minutes(r): r for r in run().collect()}
            wanted = windows(seen, width, slide)
            if kind == "activity":
                assert {k: (r.requests, r.entities) for k, r in found.items()} == {k: v[:2] for k, v in wanted.items()}
            else:
                assert {k: (r.tokens, r.tokens_per_minute) for k, r in found.items()} == {k: (v[2], v[2] / 5) for k, v in wanted.items()}
        held = spark.read.format("statestore").load(f"{base}/checkpoint").count()
        assert 1 <= held <= 20 < len(found) or kind == "activity" and 1 <= held <= 2


def test_state_stays_small_as_the_past_grows(spark, tmp_path):
    """Deliveries of one day each: what the state store holds does not grow with them."""
    source, base = str(tmp_path / "in"), str(tmp_path / "out")
    held = []
    for day in range(4):
        deliver(spark, source, log_rows(range(1440 * day, 1440 * day + 1440, 5), f"d{day}-"), LOG)
        stream = S.activity_stream(S.stream_requests(spark, source, schema=LOG))
        query = (
            stream.writeStream.format("parquet").option("path", f"{base}/data").option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert max(held) <= 2


def lives(uses, ttl=900):
    out = []
    for key in {k for k, _ in uses}:
        times = sorted(t for k, t in uses if k == key)
        start, last, n = times[0], times[0], 1
        for t in times[1:]:
            if (t - last).total_seconds() > ttl:
                out.append((key, start, n - 1))
                start, n = t, 0
            last, n = t, n + 1
        out.append((key, start, n - 1))
    return sorted(out)


def test_sessions_over_restarts(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path / "out")
    uses = []
    for first in (0, 100, 200):
        new = [("a", at(first + m)) for m in (0, 10, 40, 55)] + [("b", at(first + 99))] + [(f"k{first}", at(first + 5))]
        deliver(spark, source, new, "key string, ts timestamp")
        uses += new
        for _ in range(2):
            stream = S.cache_stream(S.stream_requests(spark, source, schema="key string, ts timestamp"), "key")
            found = S.run_bounded(stream, lambda s: S.open_cache(s, "key"), "c", base).collect()
            assert sorted((r.key, r.start.replace(tzinfo=UTC), r.hits) for r in found) == lives(uses)
            assert all(r.misses == 1 for r in found)


def test_a_hot_session_is_merged_before_the_shuffle(spark, tmp_path):
    """A key with all uses of four files: each task sends its sessions, not its uses."""
    source, base = str(tmp_path / "in"), str(tmp_path / "out")
    uses = [("hot", at(0, second)) for second in range(4000)]
    deliver(spark, source, uses, "key string, ts timestamp", files=4)
    stream = S.cache_stream(S.stream_requests(spark, source, schema="key string, ts timestamp"), "key")
    rows, _ = shuffled(spark, lambda: S.run_available(stream, "c", base))
    assert rows <= 40
    state = spark.read.format("statestore").load(f"{base}/checkpoint")
    assert [(r.key, r.hits) for r in S.open_cache(state, "key").collect()] == [("hot", 3999)]


def test_first_delivery_is_kept_over_restarts(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id string, timestamp timestamp, status bigint"
    batches = [
        [("a", at(0), 1), ("a", at(1), 2), ("b", at(2), 3)],
        [("b", at(3), 4), ("c", at(1441), 5), (None, at(4), 6)],
        [("a", at(5), 7), ("c", at(1442), 8), ("d", None, 9), ("d", None, 9), (None, at(5), 10)],
        [],
        [("d", None, 11), ("c", at(1439), 12)],
    ]
    for batch in batches:
        deliver(spark, source, batch, schema)
        out = S.dedupe_available(S.stream_requests(spark, source, schema=schema), schema, path=base)
    found = {(r.id, r.status) for r in out.collect()}
    # Null ids are grouped within a batch and match nothing across batches.
    assert {x for x in found if x[0]} == {("a", 1), ("b", 3), ("c", 5), ("d", 9)} and out.columns == ["id", "timestamp", "status"]


def test_a_repeated_batch_replaces_what_it_wrote(spark, tmp_path):
    """A batch that failed after writing is run again from the checkpoint."""
    source, base = str(tmp_path / "in"), str(tmp_path / "out")
    deliver(spark, source, [(1,), (2,)], "id long")
    calls = []

    def each(batch, number):
        calls.append(number)
        if len(calls) == 1:
            batch.write.parquet(f"{base}/data/__batch={number}")
            raise RuntimeError("lost")
        return batch

    stream = lambda: S.stream_requests(spark, source, schema="id long")
    with pytest.raises(Exception, match="lost"):
        S.run_batches(stream(), each, "id long", "b", base)
    out = S.run_batches(stream(), each, "id long", "b", base)
    assert calls == [0, 0] and sorted(r.id for r in out.collect()) == [1, 2]


def test_a_hot_id_is_one_row_a_task(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id string, timestamp timestamp"
    rows = [("hot" if i % 3 == 0 else f"r{i}", at(0, i % 3000)) for i in range(6000)]
    deliver(spark, source, rows, schema, files=4)
    result = []
    sent, _ = shuffled(spark, lambda: result.append(S.dedupe_available(S.stream_requests(spark, source, schema=schema), schema, path=base)))
    assert result[0].count() == 4001
    # 4,000 ids once, the hot one for each of four tasks, and twice again at most for the look-up of earlier batches.
    assert sent <= 3 * 4001 + 50


def test_an_edit_of_targets_takes_effect_with_the_next_batch(spark, tmp_path):
    source, base, targets = (str(tmp_path / x) for x in ("in", "out", "targets"))
    schema = "id long, target_host string"
    out_schema = f"{schema}, target_id string, target_profile string, route string"
    version = lambda n, *ids: S.store_targets(
        spark.createDataFrame([(i, [f"{i}.example.com"], "p", True) for i in ids], S.TARGETS), targets, n
    )
    run = lambda: S.route_available(S.stream_requests(spark, source, schema=schema), targets, out_schema, path=base)
    version(1, "a")
    deliver(spark, source, [(1, "a.example.com"), (2, "b.example.com"), (3, None)], schema)
    assert {(r.id, r.target_id) for r in run().collect()} == {(1, "a"), (2, None), (3, None)}
    version(2, "b")
    deliver(spark, source, [(4, "a.example.com"), (5, "b.example.com")], schema)
    routed = run()
    assert {(r.id, r.target_id) for r in routed.collect()} == {(1, "a"), (2, None), (3, None), (4, None), (5, "b")}
    assert sorted(r.id for r in S.read_targets(spark, targets, 1).collect()) == ["a"]


def test_routing_a_batch_joins_by_key(spark):
    from hushlake.operators.routing import match_targets

    calls = spark.createDataFrame([(1, "a.example.com")], "id long, target_host string")
    known = spark.createDataFrame([("t", ["*.example.com"], "p", True)], S.TARGETS)
    plan = match_targets(calls, known)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nothing_delivered(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([], LOG).write.parquet(source)
    stream = S.stream_requests(spark, source, schema=LOG)
    assert S.dedupe_available(stream.select("id", "timestamp"), "id string, timestamp timestamp", path=str(tmp_path / "d")).count() == 0
