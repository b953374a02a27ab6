"""The cache of results: what is searched again, what is renewed, what has expired."""

import datetime as dt

import pytest
from measure import shuffled
from pyspark.sql import functions as F

from hushlake.operators.detection_cache import cache_runs, detect_cached, live_entries, read_cache, rules_key
from hushlake.operators.rules import Rule

RULES = [Rule("DIGITS", r"\d+"), Rule("AB", "ab")]
T0 = dt.datetime(2024, 1, 1, 12)


def texts(spark, *listed):
    return spark.createDataFrame(list(enumerate(listed)), "id long, text string")


def spans(found):
    return {r.id: [(s.start, s.end, s.type) for s in r.spans] for r in found.collect()}


def run(spark, path, seconds, *listed, rules=RULES, **more):
    return spans(detect_cached(texts(spark, *listed), rules, str(path), T0 + dt.timedelta(seconds=seconds), **more))


def searched(spark, path):
    return {r["at"] - int(T0.replace(tzinfo=dt.timezone.utc).timestamp()): (r.texts, r.searched) for r in cache_runs(spark, str(path)).collect()}


@pytest.mark.parametrize("limit", [0, 1 << 26])
def test_only_new_texts_are_searched(spark, tmp_path, limit):
    first = run(spark, tmp_path, 0, "ab 12", "ab 12", "none", None, "", limit=limit)
    assert first == {0: [(0, 2, "AB"), (3, 5, "DIGITS")], 1: [(0, 2, "AB"), (3, 5, "DIGITS")], 2: [], 3: [], 4: []}
    again = run(spark, tmp_path, 10, "none", "x 7", "ab 12", limit=limit)
    assert again == {0: [], 1: [(2, 3, "DIGITS")], 2: [(0, 2, "AB"), (3, 5, "DIGITS")]}
    assert searched(spark, tmp_path) == {0: (3, 3), 10: (3, 1)}


def test_known_texts_come_from_the_files(spark, tmp_path):
    """An entry that says otherwise than the text shows that the text is not searched."""
    run(spark, tmp_path, 0, "ab 12", "old 5")
    folder = f"{tmp_path}/rules={rules_key(RULES)}/at={int(T0.replace(tzinfo=dt.timezone.utc).timestamp())}"
    kept = [r.asDict(recursive=True) for r in read_cache(spark, str(tmp_path)).select("key", "spans", "fresh").collect()]
    for row in kept:
        row["spans"] = [{**s, "type": "FROM_CACHE"} for s in row["spans"]]
    schema = read_cache(spark, str(tmp_path)).select("key", "spans", "fresh").schema
    spark.createDataFrame(kept, schema).write.mode("overwrite").parquet(folder)
    assert run(spark, tmp_path, 5, "ab 12", "new 9") == {0: [(0, 2, "FROM_CACHE"), (3, 5, "FROM_CACHE")], 1: [(4, 5, "DIGITS")]}


def test_a_use_renews_the_expiry(spark, tmp_path):
    for seconds in (0, 800, 1600):  # each within the time to live of the one before
        run(spark, tmp_path, seconds, "ab")
    run(spark, tmp_path, 2501, "ab")  # a second too late
    assert {k: v[1] for k, v in searched(spark, tmp_path).items()} == {0: 1, 800: 0, 1600: 0, 2501: 1}
    assert live_entries(spark, str(tmp_path), RULES, T0 + dt.timedelta(seconds=2501 + 900)).count() == 1
    assert live_entries(spark, str(tmp_path), RULES, T0 + dt.timedelta(seconds=2501 + 901)).count() == 0


def test_other_rules_have_entries_of_their_own(spark, tmp_path):
    run(spark, tmp_path, 0, "ab 12")
    assert run(spark, tmp_path, 1, "ab 12", rules=RULES[:1]) == {0: [(3, 5, "DIGITS")]}
    assert run(spark, tmp_path, 2, "ab 12", rules=RULES[::-1])[0] == [(0, 2, "AB"), (3, 5, "DIGITS")]
    assert {v for v in searched(spark, tmp_path).values()} == {(1, 1)}
    assert run(spark, tmp_path, 3, "ab 12", rules=[]) == {0: []}


def test_old_folders_are_not_opened(spark, tmp_path):
    for seconds in (0, 5000):
        run(spark, tmp_path, seconds, "ab")
    plan = live_entries(spark, str(tmp_path), RULES, T0 + dt.timedelta(seconds=5001))
    files = plan.inputFiles()
    # Partition columns are pruned when the scan is planned.
    scanned = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(at" in scanned and len(files) >= 1


def test_copies_move_once(spark, tmp_path):
    """A long text in a third of all rows: it is shuffled once for each task at most."""
    long = "ab " * 20_000
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, long).otherwise(F.col("id").cast("string")).alias("text"))
    rows.repartition(8).write.parquet(f"{tmp_path}/texts")
    stored = spark.read.parquet(f"{tmp_path}/texts")
    found = []
    _, size = shuffled(spark, lambda: found.append(detect_cached(stored, [Rule("AB", "ab")], f"{tmp_path}/cache", T0).filter("size(spans) > 0").count()))
    assert found == [1000] and size < 3000 * 60_000 / 20


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, 0) == {}
