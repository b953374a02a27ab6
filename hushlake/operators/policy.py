"""Policies, switches and configuration as tables.

Every operator works on many policies at once: ``keys`` name the columns that
tell them apart. Without keys there is one policy. Groups are reduced by
aggregates that combine before the shuffle, so a key with a third of all rows
is no heavier than the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlake.functions.labels import BUILT_IN_TYPES
from hushlake.functions.text import js_trim


def built_in_types(spark) -> DataFrame:
    """The built-in types in display order, all switched on."""
    return spark.createDataFrame(
        [(i, t, True) for i, t in enumerate(BUILT_IN_TYPES)], "pos int, type string, enabled boolean"
    )


def effective_types(types: DataFrame, keys: list[str] | None = None, built_in: list[str] = BUILT_IN_TYPES) -> DataFrame:
    """Built-in types and configured ones, each once, the first configured row deciding.

    ``pos`` orders the result: built-in types first, then others as configured.
    """
    keys = keys or []
    first = types.groupBy(*keys, "type").agg(
        F.min("pos").alias("__pos"), F.min_by("enabled", "pos").alias("__enabled")
    )
    listed = F.array(*[F.lit(t) for t in built_in])
    found = first.select(*keys, "type", "__pos", "__enabled")
    owners = types.select(*keys).distinct() if keys else types.sparkSession.range(1).select()
    base = owners.select(
        *keys,
        F.explode(listed).alias("type"),
        F.lit(None).cast("bigint").alias("__pos"),
        F.lit(None).cast("boolean").alias("__enabled"),
    )
    place = F.array_position(listed, F.col("type"))
    both = found.unionByName(base).groupBy(*keys, "type").agg(
        F.min("__pos").alias("__pos"), F.bool_and("__enabled").alias("__enabled")
    )
    return both.select(
        *keys,
        F.when(place > 0, place - 1).otherwise(F.col("__pos") + len(built_in)).cast("bigint").alias("pos"),
        "type",
        F.coalesce("__enabled", F.lit(True)).alias("enabled"),
    )


def active_labels(models: DataFrame, keys: list[str] | None = None, built_in: list[str] = BUILT_IN_TYPES) -> DataFrame:
    """Labels of the first active model, trimmed, without blanks and repeats; else the built-in types.

    ``models`` has pos, active and entity_types (map of label to type).
    """
    keys = keys or []
    chosen = models.groupBy(*keys).agg(
        F.min_by(F.map_values("entity_types"), F.when(F.col("active"), F.col("pos"))).alias("__values")
    )
    fallback = F.array(*[F.lit(t) for t in built_in])
    clean = F.array_distinct(F.filter(F.transform("__values", js_trim), lambda v: v != ""))
    values = F.when(F.coalesce(F.size("__values"), F.lit(0)) > 0, clean).otherwise(fallback)
    return chosen.select(*keys, F.explode(values).alias("value"))


def label_enabled(labels: DataFrame, types: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A label is on unless the first switch for it is off."""
    keys = keys or []
    first = types.groupBy(*keys, F.col("type").alias("value")).agg(F.min_by("enabled", "pos").alias("enabled"))
    return labels.join(first, [*keys, "value"], "left").withColumn("enabled", F.coalesce("enabled", F.lit(True)))


def set_switch(types: DataFrame, changes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Set switches: every row of a type takes the new state, absent types are added last.

    ``changes`` has the keys, type and enabled, one row for each type.
    """
    on = [*(keys or []), "type"]
    new = changes.select(*on, F.col("enabled").alias("__enabled"))
    # Two joins instead of a full one, which could not split a hot type.
    kept = types.join(new, on, "left").select(*on, "pos", F.coalesce("__enabled", "enabled").alias("enabled"))
    absent = new.join(types.select(*on).distinct(), on, "left_anti")
    added = absent.select(*on, F.lit(None).cast(types.schema["pos"].dataType).alias("pos"), F.col("__enabled").alias("enabled"))
    return kept.unionByName(added)


def patch_policy(current: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """Columns present (not null) in the patch win over the current ones."""
    fields = [c for c in current.columns if c not in keys]
    given = [c for c in fields if c in patch.columns]
    renamed = patch.select(*keys, *[F.col(c).alias(f"__{c}") for c in given])
    merged = {c: F.coalesce(f"__{c}", c) for c in given}
    return current.join(renamed, keys, "left").withColumns(merged).select(*current.columns)


def latest_version(history: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """The row with the highest version of each key; older answers are ignored."""
    fields = [c for c in history.columns if c not in keys]
    return history.groupBy(*keys).agg(F.max_by(F.struct(*fields), version).alias("__row")).select(*keys, "__row.*")


def config_snapshot(changes: DataFrame, keys: list[str], seq: str = "seq", op: str = "op") -> DataFrame:
    """Present entries of a history of put and delete operations."""
    return latest_version(changes, keys, seq).filter(F.col(op) != "delete").drop(op)


def clean_hosts(targets: DataFrame, text: str, into: str = "hosts") -> DataFrame:
    """Split lines, trim them and drop blank ones."""
    lines = F.transform(F.split(F.col(text), r"\r?\n", -1), js_trim)
    return targets.withColumn(into, F.filter(lines, lambda h: h != ""))


def validate_upstreams(upstreams: DataFrame, is_new: str = "is_new") -> DataFrame:
    """A provider needs id, URL and profile, and a key if it is new and managed."""

    def given(column: str):
        return F.coalesce(js_trim(F.col(column)), F.lit("")) != ""

    keyless = (F.col("credential_mode") == "managed") & F.col(is_new) & ~given("api_key")
    profile = F.coalesce(F.col("profile_id"), F.lit("")) != ""
    return upstreams.withColumn("valid", given("id") & given("base_url") & profile & ~keyless)


def validate_targets(targets: DataFrame) -> DataFrame:
    """A protected target needs id, profile and at least one host that is not blank."""
    named = (F.coalesce(F.col("id"), F.lit("")) != "") & (F.coalesce(F.col("profile_id"), F.lit("")) != "")
    host = F.coalesce(F.exists("hosts", lambda h: js_trim(h) != ""), F.lit(False))
    return targets.withColumn("valid", named & host)


def config_counts(rules: DataFrame, upstreams: DataFrame, targets: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Numbers of rules, providers and protected targets."""
    keys = keys or []
    kinds = {"rules": rules, "upstreams": upstreams, "targets": targets}
    tagged = None
    for kind, df in kinds.items():
        part = df.select(*keys, F.lit(kind).alias("__kind"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy(*keys).agg(
        *[F.count_if(F.col("__kind") == kind).alias(f"n_{kind}") for kind in kinds]
    )
