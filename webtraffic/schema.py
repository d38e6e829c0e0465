"""Declared schemas: the raw hit payload and the derived traffic tables."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
TS = T.TimestampNTZType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# A tracked hit as posted by the browser snippet, plus what the collector adds
# (client address, arrival time, a hit id giving a total order with the arrival time).
HIT = _struct(
    ("visitorId", S),
    ("sessionId", S),
    ("isNewSession", B),
    ("type", S),
    ("page", _struct(("path", S), ("title", S), ("referrer", S))),
    ("browser", _struct(("userAgent", S), ("language", S))),
    ("screen", _struct(("width", I), ("height", I))),
    ("ip", S),
    ("forwarded_for", S),
    ("remote_addr", S),
    ("received_at", TS),
    ("hit_id", L),
)

# The same payload as JSON carries it: ids of any JSON type, times as text with or without a zone,
# sizes as any number.
JSON_HIT = T.StructType([
    T.StructField(f.name, {"visitorId": T.VariantType(), "sessionId": T.VariantType(), "received_at": S,
                           "screen": _struct(("width", D), ("height", D))}.get(f.name, f.dataType), True)
    for f in HIT.fields
])

VISITORS = _struct(
    ("id", L), ("visitor_id", S), ("ip_address", S), ("user_agent", S),
    ("created_at", TS), ("last_seen", TS),
)

SESSIONS = _struct(
    ("id", L), ("visitor_id", S), ("session_id", S), ("started_at", TS), ("ended_at", TS),
    ("duration", L), ("page_views", L), ("referrer", S), ("referrer_domain", S),
    ("utm_source", S), ("utm_medium", S), ("utm_campaign", S),
)

PAGE_VIEWS = _struct(
    ("id", L), ("session_id", S), ("visitor_id", S), ("page_path", S), ("page_title", S),
    ("viewed_at", TS), ("is_bounce", B),
)

VISITOR_DETAILS = _struct(
    ("id", L), ("visitor_id", S), ("country", S), ("country_code", S), ("city", S),
    ("region", S), ("latitude", D), ("longitude", D), ("timezone", S), ("browser", S),
    ("browser_version", S), ("device_type", S), ("device_brand", S), ("device_model", S),
    ("os", S), ("os_version", S), ("screen_width", I), ("screen_height", I), ("language", S),
    ("updated_at", TS),
)

EVENTS = _struct(
    ("id", L), ("session_id", S), ("visitor_id", S), ("event_type", S), ("event_name", S),
    ("event_data", S), ("page_path", S), ("created_at", TS),
)

# IPv4 range table for the geo lookup (inclusive bounds, addresses as unsigned 32-bit longs).
GEO_RANGES = _struct(
    ("ip_from", L), ("ip_to", L), ("country", S), ("region", S), ("city", S),
)

# IPv6 ranges (inclusive bounds, addresses as text).
GEO_RANGES_V6 = _struct(
    ("ip_from", S), ("ip_to", S), ("country", S), ("region", S), ("city", S),
)

# The time column each table is filtered and date-partitioned on.
TIME_COLUMN = {
    "visitors": "last_seen",
    "sessions": "started_at",
    "page_views": "viewed_at",
    "visitor_details": "updated_at",
    "events": "created_at",
}

TABLE_SCHEMAS = {
    "visitors": VISITORS,
    "sessions": SESSIONS,
    "page_views": PAGE_VIEWS,
    "visitor_details": VISITOR_DETAILS,
    "events": EVENTS,
}


def conform(df, schema: T.StructType):
    """Select ``schema``'s columns in order, adding absent ones as typed NULLs."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select([
        (F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ] + [c for c in df.columns if c == "dt"])
