"""Routing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlake.operators.mask import Policy
from hushlake.operators.routing import match_targets, protection_mode, route_upstream, url_host
from hushlake.plans.registry import query
from hushlake.plans.tables import REQUESTS_SQL, pages, requests

# id, hosts, profile, enabled
_TARGETS = [
    ("t-com", ["*.example.com", " "], "openai", True),
    ("t-blog", ["*.tionsh.example.net", " BLOG.tiontion.example.com "], "generic", True),
    ("t-net", ["*.example.net:443", "example.net"], "openai", True),
    ("t-one", ["thther.example.org", "www.ththhe.example.com:8080"], "generic", True),
    ("t-two", ["www.ththhe.example.com"], "openai", True),
    ("t-a", ["www.ththhe.example.com", "*.ththhe.example.com"], "generic", True),
    ("t-off", ["*.example.org"], "openai", False),
]


def targets(spark, sf_dir) -> DataFrame:
    """Some fixed targets, and one for the host of every tenth page."""
    fixed = spark.createDataFrame(_TARGETS, "id string, hosts array<string>, profile_id string, enabled boolean")
    tenth = pages(spark, sf_dir).filter("page_id % 10 = 0").select(url_host(F.col("url")).alias("host")).distinct()
    own = tenth.select(
        F.concat(F.lit("u-"), "host").alias("id"), F.array("host").alias("hosts"),
        F.lit("generic").alias("profile_id"), F.lit(True).alias("enabled"),
    )
    return fixed.unionByName(own)


def as_calls(pages_: DataFrame) -> DataFrame:
    """Calls to the hosts of the pages, by turns with a port and without."""
    port = F.expr("CASE page_id % 3 WHEN 0 THEN ':443' WHEN 1 THEN ':8080' ELSE '' END")
    return pages_.select("page_id", F.concat(url_host(F.col("url")), port).alias("host"))


def calls(spark, sf_dir) -> DataFrame:
    return as_calls(pages(spark, sf_dir))


_ROWS = ", ".join(
    f"('{i}', [{', '.join(repr(h) for h in hosts)}], '{p}', {str(on).lower()})" for i, hosts, p, on in _TARGETS
)

# Brute force: every call against every pattern.
ROUTES_SQL = f"""calls AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS name,
  CASE page_id % 3 WHEN 0 THEN '443' WHEN 1 THEN '8080' ELSE '' END AS port FROM pages),
targets AS (SELECT * FROM (VALUES {_ROWS}) AS v(id, hosts, profile_id, enabled)
  UNION ALL SELECT DISTINCT 'u-' || name, [name], 'generic', true FROM calls WHERE page_id % 10 = 0),
lines AS (SELECT id, profile_id, lower(trim(unnest(hosts))) AS line FROM targets WHERE enabled),
patterns AS (SELECT id, profile_id, starts_with(line, '*.') AS wild, split_part(line, ':', 2) AS port,
  CASE WHEN starts_with(line, '*.') THEN substring(split_part(line, ':', 1), 2) ELSE split_part(line, ':', 1) END AS body FROM lines WHERE line <> ''),
matched AS (SELECT c.page_id, p.id, p.profile_id, row_number() OVER (PARTITION BY c.page_id ORDER BY p.wild, CASE WHEN p.wild THEN -len(p.body) ELSE 0 END, p.id) AS rank
  FROM calls c JOIN patterns p ON (p.port = '' OR p.port = c.port) AND CASE WHEN p.wild THEN ends_with(c.name, p.body) AND len(c.name) > len(p.body) ELSE c.name = p.body END),
routed AS (SELECT c.page_id, c.name || CASE WHEN c.port = '' THEN '' ELSE ':' || c.port END AS host, coalesce(m.id, '-') AS target_id,
  coalesce(m.profile_id, '-') AS target_profile, CASE WHEN m.id IS NULL THEN 'passthrough' ELSE 'protected' END AS route
  FROM calls c LEFT JOIN matched m ON m.page_id = c.page_id AND m.rank = 1)"""


def shown(routed: DataFrame) -> DataFrame:
    return routed.withColumns({c: F.coalesce(c, F.lit("-")) for c in ("target_id", "target_profile")})


@query("match_targets", f"WITH {ROUTES_SQL} SELECT * FROM routed")
def match_targets_query(spark, sf_dir):
    return shown(match_targets(calls(spark, sf_dir), targets(spark, sf_dir), "host"))


@query(
    "protection_mode",
    f"""WITH {ROUTES_SQL} SELECT page_id, CASE route WHEN 'protected' THEN 'redacted' ELSE 'passthrough' END AS mode, 'disabled' AS paused FROM routed""",
)
def protection_mode_query(spark, sf_dir):
    routed = match_targets(calls(spark, sf_dir), targets(spark, sf_dir), "host")
    governed = F.col("route") == "protected"
    return routed.select(
        "page_id", protection_mode(governed, Policy()).alias("mode"), protection_mode(governed, Policy(enabled=False)).alias("paused")
    )


_UPSTREAMS = [(f"up{i}", f"https://up{i}.example.com", "openai" if i % 2 else "generic", i != 3) for i in range(5)]
_UPSTREAM_ROWS = ", ".join(f"('{i}', '{u}', '{p}', {str(on).lower()})" for i, u, p, on in _UPSTREAMS)


@query(
    "route_upstream",
    f"""WITH {REQUESTS_SQL}, called AS (SELECT id, CASE WHEN event_id % 4 = 0 THEN path ELSE '/proxy/up' || user_id % 7 || path END AS path FROM requests),
upstreams AS (SELECT * FROM (VALUES {_UPSTREAM_ROWS}) AS v(uid, url, profile, enabled))
SELECT c.id, c.path, coalesce(u.uid, '-') AS routed_upstream, coalesce(u.url, '-') AS upstream_url, coalesce(u.profile, '-') AS upstream_profile
FROM called c LEFT JOIN upstreams u ON u.enabled AND u.uid = nullif(regexp_extract(c.path, '^/proxy/([^/]+)', 1), '')""",
)
def route_upstream_query(spark, sf_dir):
    upstreams = spark.createDataFrame(_UPSTREAMS, "id string, base_url string, profile_id string, enabled boolean")
    called = requests(spark, sf_dir).selectExpr(
        "id", "if(event_id % 4 = 0, path, concat('/proxy/up', user_id % 7, path)) AS path"
    )
    routed = route_upstream(called, upstreams)
    return routed.withColumns(
        {c: F.coalesce(c, F.lit("-")) for c in ("routed_upstream", "upstream_url", "upstream_profile")}
    )
