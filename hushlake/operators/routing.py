"""Which protected target or provider governs a request.

Requests are the large side. Distinct hosts are resolved by one equality join
with the table of patterns; no pattern is compared with every host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.functions.arrays import name
from hushlake.operators.mask import Policy


def url_host(url: Column) -> Column:
    """host[:port] of a URL, in lower case."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def host_patterns(targets: DataFrame) -> DataFrame:
    """Host patterns of enabled targets in normal form, each with its best target.

    ``*.example.com`` stands for subdomains of any depth, not for the domain
    itself; without a port any port matches. Equal patterns keep the lowest id.
    """
    lines = targets.filter("enabled").select(
        F.struct(F.col("id").alias("target_id"), "profile_id").alias("target"), F.explode("hosts").alias("line")
    )
    named = lines.select("target", F.lower(F.trim("line")).alias("pattern"))
    return named.filter(F.col("pattern") != "").groupBy("pattern").agg(F.min("target").alias("target"))


# For a host h: each pattern that could match it, with the number of labels it leaves open (0: exact).
_CANDIDATES = """flatten(transform(array(named_struct('name', regexp_replace(lower({h}), ':\\\\d+$', ''),
  'port', regexp_extract(lower({h}), ':\\\\d+$', 0), 'labels', split(regexp_replace(lower({h}), ':\\\\d+$', ''), '[.]', -1))),
  x -> flatten(transform(sequence(0, size(x.labels) - 1), i -> transform(if(x.port = '', array(''), array('', x.port)),
    p -> named_struct('open', i, 'pattern', concat(if(i = 0, x.name, concat('*.', array_join(slice(x.labels, i + 1, size(x.labels)), '.'))), p)))))))"""


def _candidates(host: str) -> Column:
    return F.expr(_CANDIDATES.format(h=name(host)))


def match_targets(requests: DataFrame, targets: DataFrame, host: str = "target_host") -> DataFrame:
    """Add target_id, target_profile and route to each request.

    An exact host wins over a wildcard, a longer suffix over a shorter one,
    then the lower target id. Requests without a match pass through.

    Every distinct host is resolved once: the patterns that could match it are
    made from its labels and looked up by one equality join. The answer is
    joined back by host, a join that adaptive execution can broadcast or split.
    A stream is routed batch by batch, see ``route_available``.
    """
    patterns = host_patterns(targets)
    hosts = requests.select(F.col(host).alias("__host")).filter("__host IS NOT NULL").distinct()
    tried = hosts.select("__host", F.inline(_candidates("__host")))
    found = tried.join(patterns, "pattern").groupBy("__host").agg(F.min(F.struct("open", "target")).alias("__found"))
    found = found.select("__host", F.col("__found.target").alias("__best"))
    out = requests.join(found, F.col(host) == F.col("__host"), "left")
    return out.select(
        *requests.columns,
        F.col("__best.target_id").alias("target_id"),
        F.col("__best.profile_id").alias("target_profile"),
        F.when(F.col("__best").isNull(), F.lit("passthrough")).otherwise(F.lit("protected")).alias("route"),
    )


def route_upstream(requests: DataFrame, upstreams: DataFrame, path: str = "path") -> DataFrame:
    """Provider named in ``/proxy/{id}/…``; without one, or if it is off, null."""
    enabled = upstreams.filter("enabled").select(
        F.col("id").alias("__id"), F.col("base_url").alias("upstream_url"), F.col("profile_id").alias("upstream_profile")
    )
    wanted = F.nullif(F.regexp_extract(F.col(path), r"^/proxy/([^/?#]+)", 1), F.lit(""))
    joined = requests.withColumn("__wanted", wanted).join(enabled, F.col("__wanted") == F.col("__id"), "left")
    return joined.withColumn("routed_upstream", F.col("__id")).drop("__wanted", "__id")


def protection_mode(governed: Column, policy: Policy) -> Column:
    """``disabled`` if the policy is off, ``passthrough`` if nothing governs, else ``redacted``."""
    if not policy.enabled:
        return F.lit("disabled")
    return F.when(governed, F.lit("redacted")).otherwise(F.lit("passthrough"))
