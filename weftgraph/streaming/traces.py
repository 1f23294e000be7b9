"""Trace spans: details, and tumbling windows per route, in batch or as a stream.

spans: name, kind, start and end (text of nanoseconds), attrs (map).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import duration, http_info, service_name

SPAN_SCHEMA = "name string, kind int, start string, end string, attrs map<string,string>"


def details(spans: DataFrame) -> DataFrame:
    """service, method, path, status, duration_ns, ts."""
    http = http_info(F.col("attrs"))
    at = F.timestamp_micros((F.col("start").try_cast("bigint") / 1000).cast("bigint"))
    return spans.select(service_name(F.col("attrs")).alias("service"), *[c.alias(n) for n, c in http.items()], duration(F.col("start"), F.col("end")).alias("duration_ns"), at.alias("ts"))


def windows(found: DataFrame, size: str = "1 minute", late: str = "10 minutes", by: tuple[str, ...] = ("method", "path")) -> DataFrame:
    """window_start, keys, spans, errors, mean and approximate 99th percentile of duration;
    on a stream spans later than the watermark are left out."""
    rows = found.withWatermark("ts", late) if found.isStreaming else found
    out = rows.groupBy(F.window("ts", size).alias("w"), *by).agg(
        F.count(F.lit(1)).alias("spans"),
        F.count_if(F.col("status").startswith("5")).alias("errors"),
        F.avg("duration_ns").alias("mean_ns"),
        F.percentile_approx("duration_ns", 0.99, 1000).alias("p99_ns"),
    )
    return out.select(F.col("w.start").alias("window_start"), *by, "spans", "errors", "mean_ns", "p99_ns")


def sessions(found: DataFrame, gap: str = "5 minutes", late: str = "10 minutes", by: tuple[str, ...] = ("service",)) -> DataFrame:
    rows = found.withWatermark("ts", late) if found.isStreaming else found
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("spans"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "spans")
