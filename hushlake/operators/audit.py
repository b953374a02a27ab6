"""Queries over the request log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushlake.functions.text import format_bytes, format_headers
from hushlake.operators.ranges import day_bounds, instant
from hushlake.operators.sides import measured

# Fixed value: requests on a page.
PAGE_SIZE = 50

# Ever finer units of time in which a page looks for its place, each with its length in microseconds.
_UNITS = [86_400_000_000, 60_000_000, 100_000, 1_000]


def request_detail(requests: DataFrame, request_id: str, date: dt.date | None = None) -> DataFrame:
    """One request with everything recorded about it.

    The filter reaches the scan; in a log that ``write_requests`` wrote, it
    leaves one row group. Who knows the UTC date opens one folder.
    """
    found = requests.filter(F.col("id") == request_id)
    return found.filter(F.col("date") == F.lit(date)) if date is not None and "date" in requests.columns else found


def dedupe_requests(requests: DataFrame, pos: str = "pos") -> DataFrame:
    """One row for each id: values of its last occurrence, position of its first.

    Occurrences are combined before the shuffle: a hot id is one row of each
    task. All columns given are kept together, so select those needed before.
    """
    fields = [c for c in requests.columns if c not in ("id", pos)]
    return (
        requests.groupBy("id")
        .agg(F.max_by(F.struct(*fields), pos).alias("__last"), F.min(pos).alias(pos))
        .select("id", "__last.*", pos)
    )


def matches_search(query: str) -> Column:
    """Provider, model, host and path, joined without a separator, contain the query."""
    if not query:
        return F.lit(True)
    joined = F.concat(*(F.coalesce(c, F.lit("")) for c in ("upstream_id", "model", "target_host", "path")))
    return F.contains(F.lower(joined), F.lit(query.lower()))


def is_on_date(date: dt.date | None, tz: str = "UTC", ts: str = "timestamp") -> Column:
    """The local calendar date of the request, as a range of instants that a scan can prune by."""
    if date is None:
        return F.lit(True)
    start, end = day_bounds(date, tz)
    return (F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end))


def is_unprotected() -> Column:
    """Mode or, failing that, operation says passthrough or disabled."""
    open_modes = ("passthrough", "disabled")
    mode = F.coalesce(F.col("protection_mode").isin(*open_modes), F.lit(False))
    operation = F.coalesce(F.col("operation_id").isin(*open_modes), F.lit(False))
    return mode | operation


def has_protection(which: str) -> Column:
    if which == "redacted":
        return ~is_unprotected()
    return is_unprotected() if which == "unredacted" else F.lit(True)


def search_requests(requests: DataFrame, query: str) -> DataFrame:
    return requests.filter(matches_search(query))


def on_date(requests: DataFrame, date: dt.date | None, tz: str = "UTC") -> DataFrame:
    """Requests of a local calendar date. A ``date`` column, if the log has one, prunes folders."""
    kept = requests.filter(is_on_date(date, tz))
    if date is None or "date" not in requests.columns:
        return kept
    start, end = day_bounds(date, tz)
    return kept.filter(F.col("date").between(F.lit(start.date()), F.lit(end.date())))


def by_protection(requests: DataFrame, which: str = "all") -> DataFrame:
    """``all``, ``redacted`` or ``unredacted`` requests."""
    return requests.filter(has_protection(which))


def filter_requests(
    requests: DataFrame, query: str = "", date: dt.date | None = None, tz: str = "UTC", which: str = "all"
) -> DataFrame:
    """Search, date and protection together."""
    return on_date(requests, date, tz).filter(matches_search(query)).filter(has_protection(which))


def page(requests: DataFrame, offset: int = 0, limit: int = PAGE_SIZE) -> DataFrame:
    """A page in order of time, newest first, with has_more and next_offset on each row.

    The place of the page is found first: requests are counted by day, then by
    minute within the day that holds the offset, and on to the millisecond. So
    the top-k below keeps the page and what shares its first millisecond, however
    deep the page lies. The window sees one row more than the page.
    """
    rest, skip = _from_place_of(requests, offset)
    ahead = rest.orderBy(F.col("timestamp").desc(), F.col("id")).offset(offset - skip).limit(limit + 1)
    everything = Window.partitionBy(F.lit(1))
    order = everything.orderBy(F.col("timestamp").desc(), F.col("id"))
    numbered = ahead.withColumn("__n", F.row_number().over(order)).withColumn(
        "has_more", F.count(F.lit(1)).over(everything) > limit
    )
    return (
        numbered.filter(F.col("__n") <= limit)
        .withColumn("next_offset", F.when(F.col("has_more"), F.lit(offset + limit)))
        .drop("__n")
    )


def _from_place_of(requests: DataFrame, offset: int) -> tuple[DataFrame, int]:
    """Requests from the millisecond on that holds the row at ``offset``, and how many are newer.

    Each step counts one unit of the step before, so it gives as many rows as
    that has parts (the first: days of the log). Rows without a time come last.
    """
    micros = F.unix_micros("timestamp")
    untimed = F.col("timestamp").isNull()
    inside, end, newer = requests.filter(~untimed), None, 0
    for unit in _UNITS:
        part = F.floor(micros / unit).cast("long")
        counted = inside.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("part").desc()).collect()
        for row in counted:
            if newer + row.n > offset:
                break
            newer += row.n
        else:
            return requests.filter(untimed), newer
        low, end = _instant(row.part * unit), _instant((row.part + 1) * unit)
        inside = _dated(requests, F.col("timestamp").between(F.lit(low), F.lit(end)) & (F.col("timestamp") < F.lit(end)), low, end)
    return _dated(requests, (F.col("timestamp") < F.lit(end)) | untimed, None, end), newer


def _instant(micros: int) -> dt.datetime:
    return dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=micros)


def _dated(requests: DataFrame, condition: Column, low: dt.datetime | None, end: dt.datetime) -> DataFrame:
    """Rows that meet the condition; folders by date outside its bounds are not opened."""
    kept = requests.filter(condition)
    if "date" not in requests.columns:
        return kept
    if low is None:
        return kept.filter((F.col("date") <= F.lit(end.date())) | F.col("date").isNull())
    return kept.filter(F.col("date").between(F.lit(low.date()), F.lit(end.date())))


def request_properties(requests: DataFrame) -> DataFrame:
    """What the detail view shows of a request. Missing token usage counts as zero."""
    disabled = F.coalesce(F.col("protection_mode") == "disabled", F.lit(False)) | F.coalesce(
        F.col("operation_id") == "disabled", F.lit(False)
    )
    usage = F.col("token_usage")
    used = {k: F.coalesce(usage[k], F.lit(0)) for k in ("input", "output", "total")}
    cached = F.when(usage["cached"] > 0, F.concat(F.lit(" · "), usage["cached"].cast("string"), F.lit(" cached tokens")))
    dash = F.lit("—")
    return requests.select(
        "id",
        F.coalesce(F.nullif("model", F.lit("")), dash).alias("model"),
        F.when(F.col("gateway_type") == "proxy_gateway", "Proxy gateway").otherwise("API gateway").alias("gateway"),
        F.coalesce(F.nullif("target_host", F.lit("")), dash).alias("target_host"),
        F.col("profile_id").alias("profile"),
        F.when(disabled, "disabled").when(is_unprotected(), "passthrough").otherwise("redacted").alias("protection"),
        "entity_count",
        F.concat(F.col("duration_ms").cast("string"), F.lit(" ms")).alias("duration"),
        F.concat(format_bytes(F.col("request_bytes")), F.lit(" → "), format_bytes(F.col("response_bytes"))).alias(
            "traffic"
        ),
        F.concat(
            used["input"].cast("string"),
            F.lit(" + "),
            used["output"].cast("string"),
            F.lit(" = "),
            used["total"].cast("string"),
            F.coalesce(cached, F.lit("")),
        ).alias("tokens"),
    )


def raw_exchange(detail: DataFrame) -> DataFrame:
    """Titles, header lines and bodies of requests that have both sides recorded."""
    request, response = F.col("raw_request"), F.col("raw_response")
    body = {side: F.coalesce(F.nullif(F.col(f"{side}.body"), F.lit("")), F.lit("—")) for side in ("raw_request", "raw_response")}
    return detail.filter(request.isNotNull() & response.isNotNull()).select(
        "id",
        F.concat(request["method"], F.lit(" "), request["url"]).alias("request_title"),
        format_headers(request["headers"]).alias("request_headers"),
        body["raw_request"].alias("request_body"),
        F.concat(F.lit("HTTP "), response["status"].cast("string")).alias("response_title"),
        format_headers(response["headers"]).alias("response_headers"),
        body["raw_response"].alias("response_body"),
    )


def field_counts(detail: DataFrame) -> DataFrame:
    """Fields of each request with their number of entities; requests without fields keep one row."""
    return detail.select("id", F.explode_outer("fields").alias("__field")).select(
        "id",
        F.col("__field.path").alias("path"),
        F.coalesce(F.size("__field.entities"), F.lit(0)).alias("n_entities"),
    )


def apply_retention(requests: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    """Keep what is no older than ``days`` days. Prunes when the log is laid out by date."""
    limit = instant(as_of) - dt.timedelta(days=days)
    kept = requests.filter(F.col("timestamp") >= F.lit(limit))
    return kept.filter(F.col("date") >= F.lit(limit.date())) if "date" in requests.columns else kept


# What each setting covers.
RECORDED = {"record_request_content": ["fields"], "record_raw_request": ["raw_request", "raw_response"]}


def apply_recording(detail: DataFrame, record_request_content: bool, record_raw_request: bool) -> DataFrame:
    """Keep field contents and raw exchanges only where recording them is on; the rest always stays."""
    on = {"record_request_content": F.lit(record_request_content), "record_raw_request": F.lit(record_raw_request)}
    return _recorded(detail, on)


def apply_recording_settings(detail: DataFrame, settings: DataFrame, tenant: str) -> DataFrame:
    """The same by a table of decoded settings, one row for each ``tenant``.

    A tenant without settings, and a flag that is null, record nothing but what
    always stays. What a query does not select is not read.
    """
    flags = settings.select(F.col(tenant).alias("__tenant"), *[F.col(f).alias(f"__{f}") for f in RECORDED])
    joined = detail.join(measured(flags), F.col(tenant) == F.col("__tenant"), "left")
    on = {f: F.coalesce(f"__{f}", F.lit(False)) for f in RECORDED}
    return _recorded(joined, on).select(*detail.columns)


def _recorded(detail: DataFrame, on: dict[str, Column]) -> DataFrame:
    return detail.withColumns({c: F.when(on[f], F.col(c)) for f, covered in RECORDED.items() for c in covered if c in detail.columns})
