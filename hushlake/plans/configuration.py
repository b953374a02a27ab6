"""Policies and configuration of many tenants, derived from the event table.

Each user is a tenant and each event a line of that tenant's configuration or
of its history.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hushlake.functions.labels import BUILT_IN_TYPES
from hushlake.operators import policy
from hushlake.operators.rules import rule_counts, usable_rules
from hushlake.plans.registry import query
from hushlake.plans.tables import events, pages

_BUILT_IN = "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(BUILT_IN_TYPES)) + ") AS b(i, type)"

# Columns of the derived tables, the same formulas in both dialects.
_SWITCH_COLUMNS = [
    "user_id AS tenant",
    "event_id AS pos",
    "CASE WHEN event_id % 3 = 0 THEN 'URL' WHEN event_id % 3 = 1 THEN 'PERSON' "
    "ELSE concat('T', CAST(event_id % 4 AS STRING)) END AS type",
    "event_id % 5 <> 0 AS enabled",
]
_RULE_COLUMNS = [
    "user_id AS tenant",
    "event_id AS pos",
    "concat(event_type, '_', CAST(event_id % 3 AS STRING)) AS id",
    "CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE '[0-9]+' END AS pattern",
    "event_type <> 'error' AS enabled",
]
_HISTORY_COLUMNS = ["user_id AS tenant", "event_id AS version", "event_id % 2 = 0 AS enabled", "event_type AS note"]
_CHANGE_COLUMNS = [
    "concat('up', CAST(user_id AS STRING), '-', CAST(event_id % 3 AS STRING)) AS id",
    "event_id AS seq",
    "CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op",
    "concat('http://', event_type) AS base_url",
]
_SWITCHES, _RULES, _HISTORY, _CHANGES = (
    ", ".join(columns) for columns in (_SWITCH_COLUMNS, _RULE_COLUMNS, _HISTORY_COLUMNS, _CHANGE_COLUMNS)
)


def _from_events(spark, sf_dir, columns: list[str]):
    return events(spark, sf_dir).selectExpr(*columns)


def switches(spark, sf_dir):
    return _from_events(spark, sf_dir, _SWITCH_COLUMNS)


_FIRST = (
    f"switches AS (SELECT {_SWITCHES} FROM events), "
    "firsts AS (SELECT tenant, type, min(pos) AS pos, arg_min(enabled, pos) AS enabled FROM switches GROUP BY ALL)"
)


@query(
    "effective_types",
    f"""WITH {_FIRST}, base AS (SELECT DISTINCT tenant, i, b.type FROM switches, {_BUILT_IN})
SELECT coalesce(b.tenant, f.tenant) AS tenant, coalesce(CAST(b.i AS BIGINT), f.pos + {len(BUILT_IN_TYPES)}) AS pos,
       coalesce(b.type, f.type) AS type, coalesce(f.enabled, true) AS enabled
FROM base b FULL JOIN firsts f ON b.tenant = f.tenant AND b.type = f.type""",
)
def effective_types(spark, sf_dir):
    return policy.effective_types(switches(spark, sf_dir), ["tenant"])


def models(spark, sf_dir):
    """Models of each tenant; the labels of some active ones are empty or blank."""
    labels = F.when(F.col("event_id") % 20 == 0, F.from_json(F.lit("{}"), "map<string,string>")).otherwise(
        F.create_map(
            F.lit("0"), F.lit(" PERSON "), F.lit("1"), F.lit(" "), F.lit("2"), F.col("event_type"),
            F.lit("3"), F.concat("event_type", F.lit(" ")),
        )
    )
    return events(spark, sf_dir).select(
        F.col("user_id").alias("tenant"), F.col("event_id").alias("pos"), (F.col("event_id") % 5 == 0).alias("active"),
        labels.alias("entity_types"),
    )


_LABELS = f"""chosen AS (SELECT user_id AS tenant, min(event_id) FILTER (WHERE event_id % 5 = 0) AS pos FROM events GROUP BY 1),
labels AS (SELECT DISTINCT c.tenant, v.value FROM chosen c JOIN events e ON e.event_id = c.pos AND c.pos % 20 <> 0,
           LATERAL (SELECT unnest(['PERSON', e.event_type]) AS value) v
           UNION SELECT c.tenant, b.type FROM chosen c, {_BUILT_IN} WHERE c.pos IS NULL OR c.pos % 20 = 0)"""


@query("active_labels", f"WITH {_LABELS} SELECT tenant, value FROM labels")
def active_labels(spark, sf_dir):
    return policy.active_labels(models(spark, sf_dir), ["tenant"])


@query(
    "label_enabled",
    f"""WITH {_LABELS}, {_FIRST} SELECT l.tenant, l.value, coalesce(f.enabled, true) AS enabled
FROM labels l LEFT JOIN firsts f ON f.tenant = l.tenant AND f.type = l.value""",
)
def label_enabled(spark, sf_dir):
    labels = policy.active_labels(models(spark, sf_dir), ["tenant"])
    return policy.label_enabled(labels, switches(spark, sf_dir), ["tenant"])


@query(
    "set_switch",
    f"""WITH {_FIRST}, changes AS (SELECT user_id AS tenant, CASE WHEN event_type = 'view' THEN 'URL' ELSE 'NEW' END AS type,
  arg_max(event_id % 2 = 0, event_id) AS enabled FROM events GROUP BY ALL)
SELECT coalesce(s.tenant, c.tenant) AS tenant, coalesce(s.pos, -1) AS pos, coalesce(s.type, c.type) AS type, coalesce(c.enabled, s.enabled) AS enabled
FROM switches s FULL JOIN changes c ON s.tenant = c.tenant AND s.type = c.type""",
)
def set_switch(spark, sf_dir):
    changes = (
        events(spark, sf_dir)
        .selectExpr("user_id AS tenant", "event_id", "if(event_type = 'view', 'URL', 'NEW') AS type", "event_id % 2 = 0 AS enabled")
        .groupBy("tenant", "type")
        .agg(F.max_by("enabled", "event_id").alias("enabled"))
    )
    done = policy.set_switch(switches(spark, sf_dir), changes, ["tenant"])
    return done.withColumn("pos", F.coalesce("pos", F.lit(-1).cast("bigint")))


@query(
    "usable_rules",
    f"""WITH rules AS (SELECT {_RULES} FROM events) SELECT tenant, pos, upper(id) AS id, pattern FROM rules WHERE enabled AND trim(pattern) <> ''""",
)
def usable_rules_query(spark, sf_dir):
    return usable_rules(_from_events(spark, sf_dir, _RULE_COLUMNS)).select("tenant", "pos", "id", "pattern")


@query(
    "rule_counts",
    f"""WITH rules AS (SELECT {_RULES} FROM events) SELECT tenant, count(*) FILTER (WHERE enabled) AS enabled_rules, count(*) AS total_rules
FROM rules GROUP BY tenant""",
)
def rule_counts_query(spark, sf_dir):
    return rule_counts(_from_events(spark, sf_dir, _RULE_COLUMNS), ["tenant"])


@query(
    "latest_policy",
    f"""WITH history AS (SELECT {_HISTORY} FROM events) SELECT tenant, max(version) AS version, arg_max(enabled, version) AS enabled,
arg_max(note, version) AS note FROM history GROUP BY tenant""",
)
def latest_policy(spark, sf_dir):
    return policy.latest_version(_from_events(spark, sf_dir, _HISTORY_COLUMNS), ["tenant"])


@query(
    "patch_policy",
    f"""WITH history AS (SELECT {_HISTORY} FROM events),
current AS (SELECT tenant, max(version) AS version, arg_max(enabled, version) AS enabled, arg_max(note, version) AS note FROM history GROUP BY tenant),
patch AS (SELECT user_id AS tenant, CASE WHEN max(event_id) % 2 = 0 THEN false END AS enabled,
          CASE WHEN max(event_id) % 3 = 0 THEN 'patched' END AS note FROM events GROUP BY 1 HAVING max(event_id) % 5 <> 0)
SELECT tenant, c.version, coalesce(p.enabled, c.enabled) AS enabled, coalesce(p.note, c.note) AS note FROM current c LEFT JOIN patch p USING (tenant)""",
)
def patch_policy(spark, sf_dir):
    current = policy.latest_version(_from_events(spark, sf_dir, _HISTORY_COLUMNS), ["tenant"])
    last = events(spark, sf_dir).groupBy(F.col("user_id").alias("tenant")).agg(F.max("event_id").alias("last"))
    patch = last.filter("last % 5 <> 0").selectExpr(
        "tenant", "if(last % 2 = 0, false, null) AS enabled", "if(last % 3 = 0, 'patched', null) AS note"
    )
    return policy.patch_policy(current, patch, ["tenant"])


@query(
    "config_snapshot",
    f"""WITH changes AS (SELECT {_CHANGES} FROM events), latest AS (SELECT id, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(base_url, seq) AS base_url
FROM changes GROUP BY id) SELECT id, seq, base_url FROM latest WHERE op <> 'delete'""",
)
def config_snapshot(spark, sf_dir):
    return policy.config_snapshot(_from_events(spark, sf_dir, _CHANGE_COLUMNS), ["id"])


@query(
    "clean_hosts",
    """SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || ',*.example.com' AS hosts FROM pages""",
)
def clean_hosts(spark, sf_dir):
    lines = pages(spark, sf_dir).select(
        "page_id",
        F.concat(
            F.lit(" "), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1), F.lit(" \r\n\r\n \t\n *.example.com\n")
        ).alias("lines"),
    )
    return policy.clean_hosts(lines, "lines").select("page_id", F.array_join("hosts", ",").alias("hosts"))


_PROVIDER_COLUMNS = [
    "event_id",
    "CASE WHEN event_id % 7 = 0 THEN '  ' ELSE 'up' END AS id",
    "CASE WHEN event_id % 11 = 0 THEN '' ELSE 'http://u' END AS base_url",
    "CASE WHEN event_id % 13 = 0 THEN '' ELSE 'openai' END AS profile_id",
    "CASE WHEN event_id % 2 = 0 THEN 'managed' ELSE 'passthrough' END AS credential_mode",
    "CASE WHEN event_id % 3 = 0 THEN 'k' WHEN event_id % 3 = 1 THEN ' ' END AS api_key",
    "event_id % 5 <> 0 AS is_new",
]
_PROVIDERS = ", ".join(_PROVIDER_COLUMNS)


@query(
    "validate_upstreams",
    f"""WITH providers AS (SELECT {_PROVIDERS} FROM events) SELECT event_id, trim(id) <> '' AND base_url <> '' AND profile_id <> ''
AND NOT (credential_mode = 'managed' AND is_new AND coalesce(trim(api_key), '') = '') AS valid FROM providers""",
)
def validate_upstreams(spark, sf_dir):
    return policy.validate_upstreams(_from_events(spark, sf_dir, _PROVIDER_COLUMNS)).select("event_id", "valid")


@query(
    "validate_targets",
    """SELECT event_id, event_id % 7 <> 0 AND event_id % 3 <> 0 AND event_id % 5 <> 0 AS valid FROM events""",
)
def validate_targets(spark, sf_dir):
    targets = events(spark, sf_dir).selectExpr(
        "event_id", "if(event_id % 7 = 0, '', 't') AS id", "if(event_id % 5 = 0, null, 'openai') AS profile_id",
        "if(event_id % 3 = 0, array(' ', ''), array(' ', 'a.example.com')) AS hosts",
    )
    return policy.validate_targets(targets).select("event_id", "valid")


# Events stand in for the lines of three configuration tables.
_KINDS = ["event_type IN ('view', 'purchase')", "event_type IN ('click', 'signup')", "event_type NOT IN ('view', 'purchase', 'click', 'signup')"]


@query(
    "config_counts",
    "SELECT user_id AS tenant, " + ", ".join(
        f"count(*) FILTER (WHERE {kind}) AS {name}" for kind, name in zip(_KINDS, ("n_rules", "n_upstreams", "n_targets"), strict=True)
    ) + " FROM events GROUP BY 1",
)
def config_counts(spark, sf_dir):
    lines = events(spark, sf_dir).select(F.col("user_id").alias("tenant"), "event_type")
    return policy.config_counts(*[lines.filter(kind) for kind in _KINDS], ["tenant"])
