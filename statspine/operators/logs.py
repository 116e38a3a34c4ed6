"""Audit log, usage and request-rate questions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statspine.functions.columns import nulls_last, ratio
from statspine.operators.aggregates import limit_offset

# fixed values: actions that count as security events
SECURITY_ACTIONS = ["LOGIN", "LOGOUT", "AUTH_FAIL", "ACCESS_DENIED", "PASSWORD_CHANGE"]
# fixed values: requests allowed per scope (minute, hour, day)
SCOPE_LIMITS = {
    "read": (60, 1000, 10000),
    "write": (30, 500, 5000),
    "admin": (120, 2000, 20000),
    "analytics": (100, 1500, 15000),
    "export": (200, 3000, 30000),
}
WINDOWS = ("minute", "hour", "day")
_WINDOW_SECONDS = {"minute": 60, "hour": 3600, "day": 86400}
SLOW_MS = 1000.0
DETAILS = T.MapType(T.StringType(), T.StringType())


def exact_mean(c: str | Column) -> Column:
    """Mean of a measured duration through its exact decimal sum."""
    c = F.col(c) if isinstance(c, str) else c
    return F.try_divide(F.sum(c.cast("decimal(20,6)")).cast("double"), F.count(c))


def between_times(df: DataFrame, start: datetime | None, end: datetime | None, column: str = "timestamp") -> DataFrame:
    dtype = df.schema[column].dataType
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast(dtype))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end).cast(dtype))
    return df


def _with_details(df: DataFrame) -> DataFrame:
    """Parsed details; missing or invalid JSON gives an empty map."""
    empty = F.create_map().cast(DETAILS)
    return df.withColumn("details", F.coalesce(F.from_json("details_json", DETAILS), empty)).drop("details_json")


def audit_logs(
    log: DataFrame,
    *,
    start: datetime | None = None,
    end: datetime | None = None,
    limit: int | None = 100,
    offset: int = 0,
    **equals,
) -> DataFrame:
    """Entries, newest first. ``equals`` are column values (user_id, action, success ...)."""
    rows = between_times(log, start, end)
    for name, value in equals.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return _with_details(limit_offset(rows, ["-timestamp", "-id"], limit, offset if limit else 0))


def audit_statistics(log: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    return between_times(log, start, end).agg(
        F.count("*").alias("total_events"),
        F.count_if("success").alias("successful_events"),
        F.count_if(~F.col("success")).alias("failed_events"),
        F.count_distinct("user_id").alias("unique_users"),
        F.count_distinct("action").alias("unique_actions"),
        F.count_distinct("resource_type").alias("unique_resource_types"),
        exact_mean("execution_time_ms").alias("avg_execution_time"),
        F.max("timestamp").alias("last_event_time"),
        F.min("timestamp").alias("first_event_time"),
    )


def action_columns() -> list[Column]:
    return [
        F.count("*").alias("event_count"),
        F.count_if("success").alias("success_count"),
        F.count_if(~F.col("success")).alias("failure_count"),
        exact_mean("execution_time_ms").alias("avg_execution_time"),
        F.max("timestamp").alias("last_occurrence"),
    ]


def action_summary(log: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    return (
        between_times(log, start, end)
        .groupBy("action", "resource_type")
        .agg(*action_columns())
        .orderBy(*nulls_last("-event_count", "action", "resource_type"))
    )


def user_activity(
    log: DataFrame, user_id, start: datetime | None = None, end: datetime | None = None, limit: int = 50
) -> DataFrame:
    rows = between_times(log.where(F.col("user_id") == user_id), start, end)
    newest = limit_offset(rows, ["-timestamp", "-id"], limit)
    return newest.select("action", "resource_type", "resource_id", "success", "timestamp", "error_message")


def security_events(
    log: DataFrame, start: datetime | None = None, end: datetime | None = None, limit: int | None = 100, actions=None
) -> DataFrame:
    """Named actions or failures, newest first; the time bounds hold for both kinds."""
    wanted = F.col("action").isin(list(actions or SECURITY_ACTIONS)) | ~F.col("success")
    rows = between_times(log.where(wanted), start, end)
    return _with_details(limit_offset(rows, ["-timestamp", "-id"], limit))


def usage_analytics(
    requests: DataFrame,
    group_by: str = "day",
    start: datetime | None = None,
    end: datetime | None = None,
    endpoint: str | None = None,
) -> DataFrame:
    """Requests, mean time and errors per day, week or month and endpoint."""
    if group_by not in ("day", "week", "month"):
        raise ValueError("group_by is day, week or month")
    rows = between_times(requests, start, end)
    if endpoint:
        rows = rows.where(F.col("endpoint") == endpoint)
    bucket = F.date_format(F.date_trunc(group_by, "timestamp"), "yyyy-MM-dd")
    return rows.groupBy(bucket.alias("date"), "endpoint").agg(
        F.count("*").alias("request_count"),
        exact_mean("execution_time_ms").alias("avg_response_time_ms"),
        F.count_if(~F.col("success")).alias("error_count"),
    )


def usage_summary(requests: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Totals, error rate and the endpoint used most (first by name among equals)."""
    per_endpoint = (
        between_times(requests, start, end)
        .groupBy("endpoint")
        .agg(
            F.count("*").alias("_n"),
            F.count("execution_time_ms").alias("_timed"),
            F.sum(F.col("execution_time_ms").cast("decimal(20,6)")).alias("_ms"),
            F.count_if(~F.col("success")).alias("_errors"),
        )
    )
    return per_endpoint.agg(
        F.sum("_n").alias("total_requests"),
        ratio(F.sum("_ms"), F.sum("_timed")).alias("avg_response_time_ms"),
        ratio(F.sum("_errors"), F.sum("_n")).alias("error_rate"),
        F.min(F.struct((-F.col("_n")).alias("n"), "endpoint"))["endpoint"].alias("most_used_endpoint"),
    )


def query_log_stats(log: DataFrame, slow_ms: float = SLOW_MS) -> DataFrame:
    """Per query type: count, total and mean time, share of cache hits, slow queries and errors."""
    return log.groupBy("query_type").agg(
        F.count("*").alias("count"),
        F.sum(F.col("execution_time_ms").cast("decimal(20,6)")).cast("double").alias("total_time"),
        exact_mean("execution_time_ms").alias("avg_time"),
        ratio(F.count_if("cache_hit"), F.count("*")).alias("cache_hit_rate"),
        ratio(F.count_if(F.col("execution_time_ms") > slow_ms), F.count("*")).alias("slow_share"),
        ratio(F.count_if(~F.col("success")), F.count("*")).alias("error_share"),
    )


def request_counts(requests: DataFrame, windows: tuple[str, ...] = WINDOWS) -> DataFrame:
    """Requests per identifier, endpoint and tumbling minute, hour and day.

    Every request counts in all windows: it is expanded into them and counted on the
    map side, one shuffle for all window types.
    """
    spans = F.array(
        *[
            F.struct(
                F.lit(w).alias("window_type"),
                F.date_trunc(w, "timestamp").cast(requests.schema["timestamp"].dataType).alias("window_start"),
            )
            for w in windows
        ]
    )
    return (
        requests.select("identifier", "endpoint", F.explode(spans).alias("w"))
        .select("identifier", "endpoint", "w.window_type", "w.window_start")
        .groupBy("identifier", "endpoint", "window_type", "window_start")
        .agg(F.count("*").alias("request_count"))
    )


def scope_limit(scope: str | Column, window_type: str | Column) -> Column:
    """Allowed requests of a scope in a window, from the fixed limit table."""
    scope, window_type = (F.col(c) if isinstance(c, str) else c for c in (scope, window_type))
    out = F.lit(None).cast("int")
    for name, limits in SCOPE_LIMITS.items():
        for w, n in zip(WINDOWS, limits, strict=True):
            out = F.when((scope == name) & (window_type == w), n).otherwise(out)
    return out


def limit_violations(counts: DataFrame, limit: Column) -> DataFrame:
    """Windows whose count is above the limit, and by how much."""
    return (
        counts.withColumn("limit_value", limit)
        .where("request_count > limit_value")
        .withColumn("exceeded_by", F.col("request_count") - F.col("limit_value"))
    )


# parts of a rolling window that are summed by tasks of their own
SPANS = 60


def rolling_request_count(requests: DataFrame, seconds: int = 3600, max_requests: int | None = None) -> DataFrame:
    """Requests of an identifier in the last ``seconds``, at each time it made one.

    Each time adds its requests to a running sum and takes them away again when the window has passed, so a row is read once
    however many the window holds. Time is cut into ``SPANS`` parts of a window; a part's sum starts from the totals of the
    parts before it, so a busy identifier is many tasks. The rows are dealt by identifier and part once: totals, running sums
    and the join of both use that. Exact to the microsecond.
    """
    size = seconds * 1_000_000
    part = max(1, size // SPANS)
    kind = requests.schema["timestamp"].dataType
    at = F.unix_micros(F.col("timestamp").cast("timestamp"))
    change = F.explode(
        F.array(
            F.struct(at.alias("us"), F.col("_n").alias("by"), F.col("timestamp").alias("own")),
            F.struct((at + size).alias("us"), (-F.col("_n")).alias("by"), F.lit(None).cast(kind).alias("own")),
        )
    ).alias("c")
    # a struct equals another one whose fields are NULL too, so that it can be dealt and joined by
    key = F.struct(F.col("identifier").alias("identifier")).alias("_key")
    steps = requests.withColumn("_n", F.lit(1)).select(key, change)
    dealt = steps.select("_key", F.floor(F.col("c.us") / part).alias("_part"), "c.*").repartition("_key", "_part")
    # a time that one request enters and another leaves is one row
    times = dealt.groupBy("_key", "_part", "us").agg(F.sum("by").alias("_by"), F.max("own").alias("timestamp"), F.sum(F.greatest("by", F.lit(0))).alias("request_count"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_key", "_part").agg(F.sum("by").alias("_total"))
    starts = totals.select("_key", "_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    upto = Window.partitionBy("_key", "_part").orderBy("us").rowsBetween(Window.unboundedPreceding, 0)
    sums = times.withColumn("_sum", F.sum("_by").over(upto)).where("timestamp IS NOT NULL")
    out = sums.join(starts, ["_key", "_part"]).select("_key.identifier", "timestamp", "request_count", (F.col("_start") + F.col("_sum")).alias("rolling_count"))
    return out if max_requests is None else out.withColumn("allowed", F.col("rolling_count") <= max_requests)


def rolling_from_panes(panes: DataFrame, panes_in_window: int, pane: str) -> DataFrame:
    """(identifier, border, rolling_count): requests of the ``panes_in_window`` panes that end at a border, from their counts.

    ``panes`` (identifier, window_start, request_count) are counts of windows of length ``pane``. A pane is in as many
    windows as these have panes; it is its count that is handed to them, not its requests.
    """
    steps = F.explode(F.sequence(F.lit(1), F.lit(panes_in_window))).alias("_k")
    each = panes.select("identifier", "window_start", "request_count", steps)
    border = F.col("window_start") + F.col("_k") * F.expr(f"INTERVAL {pane}")
    return each.groupBy("identifier", border.alias("border")).agg(F.sum("request_count").alias("rolling_count"))


def wider_windows(minutes: DataFrame, windows: tuple[str, ...] = WINDOWS) -> DataFrame:
    """``request_counts`` of all windows from those of minutes, which the wider ones are made of."""
    spans = F.array(*[F.struct(F.lit(w).alias("window_type"), F.date_trunc(w, "window_start").alias("window_start")) for w in windows])
    each = minutes.select("identifier", "endpoint", "request_count", F.explode(spans).alias("w"))
    return each.groupBy("identifier", "endpoint", "w.window_type", "w.window_start").agg(F.sum("request_count").alias("request_count"))


def expired_windows_removed(counts: DataFrame, now: datetime) -> DataFrame:
    """Window counters still open at ``now``."""
    start = F.col("window_start")
    ends = F.lit(None)
    for w, s in _WINDOW_SECONDS.items():
        ends = F.when(F.col("window_type") == w, start + F.expr(f"INTERVAL {s} SECONDS")).otherwise(ends)
    return counts.where(ends > F.lit(now).cast(counts.schema["window_start"].dataType))
