"""Explicit schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "tags": T.MapType(T.StringType(), T.StringType()),
}


def _struct(text: str) -> T.StructType:
    """``name type, ...`` without needing a session, so the schemas exist at import."""
    pairs = (field.split() for field in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


AD_EVENTS = _struct(
    "event_time timestamp, app_id string, geo_device_id string, advertiser_id string, "
    "ad_format string, is_filled int, is_impression int, is_click int, revenue double"
)
APPS = _struct("app_id string, category string, publisher_tier string")
ADVERTISERS = _struct("advertiser_id string, vertical string, campaign_type string")
GEO_DEVICE = _struct(
    "geo_device_id string, region string, country string, device_model string, os_version string"
)
ROLLUP_HOURLY = _struct(
    "event_hour timestamp, dim string, val string, events bigint, fills bigint, "
    "impressions bigint, clicks bigint, revenue double, event_date date"
)
ROLLUP_DAILY = _struct(
    "dim string, val string, events bigint, fills bigint, impressions bigint, clicks bigint, "
    "revenue double, event_date date"
)
ROLLUP_MANIFEST = _struct("grain string, dim string, total bigint, event_date date")
FIRINGS = _struct(
    "metric string, dim string, val string, day date, actual double, baseline double, "
    "pct double, sigma double, requests bigint"
)
WATCHES = _struct(
    "watch_id string, user_id string, metric string, dimension string, value string, "
    "baseline_impact double, note string, created_at timestamp, watermark date"
)
NOTIFICATIONS = _struct(
    "at timestamp, watch_id string, user_id string, metric string, dimension string, "
    "value string, day date, pct double, sigma double, requests_per_day bigint"
)
EVIDENCE = _struct(
    "id string, label string, value double, unit string, window_from date, window_to date, "
    "filters tags, share_pct double, query_hash string"
)
FINDINGS = _struct(
    "channel string, dimension string, value string, metric string, delta_abs double, "
    "delta_pct double, delta_pp double, revenue_impact double, sigma double, status string, "
    "residual double, share_pct double, note string"
)

# The telemetry columns whose values are counted per 15 minutes. The last eight log
# keys are resource attributes, counted under a prefixed name.
LOG_COLUMNS = (
    "SeverityText",
    "ServiceName",
    "ScopeName",
    "ScopeVersion",
    "ResourceSchemaUrl",
    "ScopeSchemaUrl",
)
LOG_ATTRIBUTE_PREFIX = "__hdx_materialized_"
LOG_ATTRIBUTES = (
    "k8s.cluster.name",
    "k8s.container.name",
    "k8s.deployment.name",
    "k8s.namespace.name",
    "k8s.node.name",
    "k8s.pod.name",
    "k8s.pod.uid",
    "deployment.environment.name",
)
TRACE_COLUMNS = (
    "ServiceName",
    "SpanName",
    "SpanKind",
    "StatusCode",
    "ScopeName",
    "ScopeVersion",
)
