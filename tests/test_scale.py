"""Hot keys: one key with a third of all rows must neither change results nor end in one task."""

import datetime as dt
import random
from collections import Counter

import pytest
from measure import shuffled
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from hushlake.operators.cache import cache_sessions
from hushlake.operators.detect import detect_distinct
from hushlake.operators.mask import mask
from hushlake.operators.rules import Rule
from hushlake.operators.sides import split_by_keys
from hushlake.operators.vault import build_vault, islands_table, protect, restore, vault_collisions
from hushlake.plans.tables import RULES

WORDS = [Rule("WORD", r"[a-z]{6}")]


def test_restore_within_a_hot_scope(spark):
    """All texts share a scope; its four digits collide, and only clear placeholders come back."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = [(i, "hot" if i % 3 else f"s{i}", f"{word()} and {word()} 1") for i in range(900)]
    df = spark.createDataFrame(texts, "id long, scope string, text string")
    masked = mask(df, WORDS, "scope").select("id", "scope_id", "text")
    vault = build_vault(islands_table(df, WORDS, "scope"))
    ambiguous = {(r.scope_id, r.placeholder) for r in vault_collisions(vault).collect()}
    assert ambiguous
    values = {}
    for r in vault.collect():
        values.setdefault((r.scope_id, r.placeholder), set()).add(r.value)
    assert ambiguous == {k for k, v in values.items() if len(v) > 1}
    before = {r.id: (r.scope_id, r.text) for r in masked.collect()}
    for r in restore(masked, vault, ["id"]).collect():
        scope, text = before[r.id]
        for (s, p), found in values.items():
            if s == scope and len(found) == 1:
                text = text.replace(p, next(iter(found)))
        assert r.text == text


def test_restore_keeps_other_scopes_unknown_placeholders_and_nulls(spark):
    vault = spark.createDataFrame([("1", "<MASK_A:0000>", "A", "x"), ("1", "<MASK_A:0000>", "A", "x")],
                                  "scope_id string, placeholder string, type string, value string")
    df = spark.createDataFrame(
        [(1, "1", "<MASK_A:0000> <MASK_B:0000> <MASK_A:0000>"), (2, "2", "<MASK_A:0000>"), (3, "1", None), (4, None, "<MASK_A:0000>"), (5, "1", "plain")],
        "id long, scope_id string, text string",
    )
    assert {r.id: r.text for r in restore(df, vault, ["id"]).collect()} == {
        1: "x <MASK_B:0000> x", 2: "<MASK_A:0000>", 3: None, 4: "<MASK_A:0000>", 5: "plain",
    }


@pytest.mark.parametrize("ttl", [1, 30, 100, 5000])
def test_cache_of_a_hot_key_equals_brute_force(spark, ttl):
    rng = random.Random(9)
    uses = [(("hot" if i % 3 == 0 else f"k{rng.randint(0, 20)}"), rng.randint(0, 20000)) for i in range(2000)]
    df = spark.createDataFrame(uses, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    found = {r.k: (r.hits, r.misses) for r in cache_sessions(df, "k", ttl).collect()}
    expected = {}
    for key in {k for k, _ in uses}:
        times = sorted(s for k, s in uses if k == key)
        misses = sum(1 for i, t in enumerate(times) if i == 0 or t - times[i - 1] > ttl)
        expected[key] = (len(times) - misses, misses)
    assert found == expected


def test_gap_equal_to_the_ttl_is_a_hit(spark):
    df = spark.createDataFrame([("k", 0), ("k", 100), ("k", 201)], "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    assert tuple(cache_sessions(df, "k", 100).first())[1:3] == (1, 2)


def test_hot_text_is_detected_once_and_its_copies_are_split(spark):
    """A third of the rows are one text: the join back splits its partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        # Repeated hashes compress well: many small partitions make the hot one stand out.
        "spark.sql.shuffle.partitions": "64",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    hot = "a@b.org " * 20
    df = spark.range(0, 60000, 1, 8).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.concat(F.lit("t"), "id", F.lit(" c@d.org"))).alias("text")
    )
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        found = detect_distinct(df, RULES).select("id", F.size("spans").alias("n"))
        assert Counter(r.n for r in found.collect()) == {20: 20000, 1: 40000}
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_stored_log_is_pruned_by_date(spark, sf_dir, tmp_path):
    from hushlake.operators.audit import apply_retention, on_date, page
    from hushlake.operators.stats import audit_stats
    from hushlake.plans.tables import AS_OF, requests
    from hushlake.sources.writers import write_requests

    log = requests(spark, sf_dir)
    write_requests(log, str(tmp_path / "log"))
    schema = StructType([*log.schema.fields, StructField("date", DateType())])
    stored = spark.read.schema(schema).parquet(str(tmp_path / "log"))
    kept = apply_retention(stored, AS_OF, 7)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    assert kept.count() == apply_retention(log, AS_OF, 7).count()
    for tz in ("UTC", "Asia/Tokyo", "America/New_York"):
        day = on_date(stored, dt.date(2024, 1, 10), tz)
        assert "PartitionFilters: [isnotnull(date" in day._jdf.queryExecution().executedPlan().toString()
        assert day.count() == on_date(log, dt.date(2024, 1, 10), tz).count() > 0
    assert [r.id for r in page(stored, 5000).collect()] == [r.id for r in page(log, 5000).collect()]
    narrow = audit_stats(stored, "7d", AS_OF)
    assert narrow.collect() == audit_stats(log, "7d", AS_OF).collect()
    assert "raw_request" not in narrow._jdf.queryExecution().executedPlan().toString()


def test_detail_lookup_and_list_queries_prune(spark, tmp_path):
    from hushlake.operators.audit import request_detail, search_requests
    from hushlake.schemas import DETAIL
    from hushlake.sources.readers import read_requests

    path = str(tmp_path / "detail")
    spark.createDataFrame([], DETAIL).write.parquet(path)
    detail = read_requests(spark, path, detail=True)
    assert "EqualTo(id,r1)" in request_detail(detail, "r1")._jdf.queryExecution().executedPlan().toString()
    listed = search_requests(detail, "x").select("id", "path")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:string,upstream_id:string,model:string,target_host:string,path:string>" in listed


def test_protect_searches_once_and_keeps_raw_values_in_the_vault(spark, tmp_path):
    rows = [(1, 7, "a@b.org and a@b.org, c@d.org"), (2, 7, "a@b.org"), (3, 8, "nothing"), (4, None, None), (5, 9, "")]
    texts = spark.createDataFrame(rows, "id long, scope long, text string")
    rules = [Rule("EMAIL", r"[a-z]@[a-z]\.org")]
    before = set(_stage_ids(spark))
    masked, vault = protect(texts, rules, "scope", ["id"], f"{tmp_path}/p")
    assert len(set(_stage_ids(spark)) - before) == 1
    assert {r.value for r in vault.collect()} == {"a@b.org", "c@d.org"}
    assert build_vault(vault).count() == 2 and masked.columns == ["id", "scope_id", "text", "entities", "replacement_count"]
    everything = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/p/kind=masked")
    assert not any("@" in str(r) for r in everything.collect())
    for back in (restore(masked, vault, ["id"]), restore(masked, vault, ["id"], entities="entities")):
        assert {r.id: r.text for r in back.collect()} == {i: t for i, _, t in rows}


def _stage_ids(spark):
    from measure import _stages

    return _stages(spark)


def test_ambiguous_placeholders_stay_within_their_scope(spark):
    vault = spark.createDataFrame(
        [("1", "<A:0001>", "A", "x"), ("1", "<A:0001>", "A", "y"), ("2", "<A:0001>", "A", "z"), ("2", "<A:0001>", "A", "z")],
        "scope_id string, placeholder string, type string, value string",
    )
    df = spark.createDataFrame([(1, "1", "<A:0001>!"), (2, "2", "<A:0001>!")], "id long, scope_id string, text string")
    assert {r.id: r.text for r in restore(df, vault, ["id"]).collect()} == {1: "<A:0001>!", 2: "z!"}


def test_only_texts_with_outside_spans_are_shuffled(spark, tmp_path):
    """A detector found something in every hundredth text; its table is no small one as far as the plan knows."""
    wide = F.concat(F.col("id").cast("string"), F.lit(" some longer text with an a@b.org " * 20))
    spark.range(5000).select("id", wide.alias("text")).repartition(6).write.parquet(f"{tmp_path}/t")
    texts = spark.read.parquet(f"{tmp_path}/t")
    spans = spark.range(0, 5000, 100).selectExpr(
        "int(id) AS id", "0 AS start", "1 AS end", "'D' AS type", "'m' AS source", "0.5D AS confidence"
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = set(_stage_ids(spark))
        masked = mask(texts, [Rule("EMAIL", r"[a-z]@[a-z]\.org")], "id", external=spans, keys=["id"])
        assert set(_stage_ids(spark)) == before  # nothing runs while the plan is made
        rows = []
        sent, _ = shuffled(spark, lambda: rows.extend(masked.select("id", "replacement_count", "text").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.id: r.replacement_count for r in rows} == {i: 20 + (i % 100 == 0) for i in range(5000)}
    # The fifty texts; and of the detector, its fifty spans, twice, and the blocks of the filter.
    assert sent <= 50 + 3 * 50


def test_split_by_keys_loses_no_key(spark):
    df = spark.createDataFrame([(i, f"k{i % 50}") for i in range(1000)] + [(None, "k1"), (5, None)], "a long, b string")
    other = spark.createDataFrame([(i, f"k{i % 50}") for i in range(0, 1000, 7)] + [(None, "k1")], "a int, b string")
    wanted = {(i, f"k{i % 50}") for i in range(0, 1000, 7)}
    for bits in (1 << 29, 64):  # a filter that is full lets all pass
        some, none = split_by_keys(df, other, ["a", "b"], bits)
        found, rest = ({tuple(r) for r in x.collect()} for x in (some, none))
        assert wanted <= found and not found & rest and len(found | rest) == 1002
        assert bits == 64 or found == wanted | {(None, "k1")}
