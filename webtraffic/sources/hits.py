"""The hit source (JSON payloads), and a raw-hit fixture built from the driver's tables.

The fixture turns each ``events`` row into a tracked hit with a deterministic payload: page,
referrer URL, user agent, language, screen and client address chosen by rule from the event
and user ids, including the awkward cases (missing ids, empty strings, zero sizes, local,
malformed and IPv4-mapped addresses, referrers that are not URLs). ``geo_ranges`` is built
from ``nation``/``region``. The SQL twins feed the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import JSON_HIT
from .fixtures import read_table


def instant(text) -> Column:
    """A date-time text as UTC ``timestamp_ntz``, whatever the session's zone.

    ``T`` or a space between date and time, any fraction of a second; ``Z`` or an offset
    (``+02:00``, ``-0530``, ``+02``) is applied, no zone means UTC; a date alone is its midnight.
    Anything else is NULL.
    """
    form = r"^\s*(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)\s*([Zz]|[+-]\d{2}(?::?\d{2})?)?)?\s*$"
    t = F.col(text) if isinstance(text, str) else text
    day, clock, zone = (F.regexp_extract(t, form, k) for k in (1, 2, 3))
    local = F.concat(day, F.lit(" "), F.when(clock == "", F.lit("00:00:00"))
                     .when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(clock))
    digits = F.regexp_replace(F.substring(zone, 2, 5), ":", "")
    minutes = (F.substring(digits, 1, 2).try_cast("int") * 60
               + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0)))
    east = F.when(zone.startswith("+"), minutes).when(zone.startswith("-"), -minutes).otherwise(F.lit(0))
    utc = F.try_add(local.try_cast("timestamp_ntz"), F.make_dt_interval(mins=-east))
    return F.when(t.rlike(form), utc)


def _id(c: str) -> Column:
    """A payload id as text; the falsy values 0 and false count as missing, like null and ''."""
    v = F.col(c)
    text = F.try_variant_get(v, "$", "string")
    falsy = F.schema_of_variant(v).isin("BIGINT", "BOOLEAN", "DOUBLE", "DECIMAL(1,0)") & text.isin("0", "false", "0.0")
    return F.when(~F.coalesce(falsy, F.lit(False)), text)


def from_payload(df: DataFrame) -> DataFrame:
    """Rows read with ``JSON_HIT`` in the shape of ``HIT``; a time that cannot be read is NULL and
    is rejected by validation. Sizes are whole pixels, a fraction is cut."""
    size = lambda c: F.when(F.abs(F.col(c)) < 1e9, F.col(c)).cast("int").alias(c.split(".")[1])
    return df.withColumns({
        "visitorId": _id("visitorId"), "sessionId": _id("sessionId"), "received_at": instant("received_at"),
        "screen": F.struct(size("screen.width"), size("screen.height")),
    })


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines payloads with the declared schema (no inference); bad records keep
    NULL fields (PERMISSIVE) and are then rejected by validation."""
    return from_payload(spark.read.schema(JSON_HIT).option("mode", "PERMISSIVE").json(path))


# Fixed values of the raw-hit fixture (our own test inputs).
REFERRERS = [
    "https://www.google.com/search?q=spark",
    "https://WWW.BING.COM/",
    "http://user:pw@search.yahoo.com:8080/x",
    "https://m.facebook.com/",
    "https://t.co/abc",
    "https://x.com/home",
    "https://www.netflix.com/title/1",
    "https://[2001:db8::1]:443/p",
    "",
    None,
    "not a url",
    "about:blank",
    "  https://l.instagram.com/?u=1  ",
    "https://www.linkedin.com/feed",
    "https://news.example.org/a b|c",
    "//cdn.example.com/x",
]
USER_AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) "
    "Chrome/120.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) "
    "Version/17.1 Safari/605.1.15",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_1 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like "
    "Gecko) Version/17.1 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (iPad; CPU OS 16_6 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) "
    "Version/16.6 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (Linux; Android 13; SM-G991B) AppleWebKit/537.36 (KHTML, like Gecko) "
    "Chrome/119.0.0.0 Mobile Safari/537.36",
    "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) "
    "Chrome/120.0.0.0 Safari/537.36 Edg/120.0.0.0",
    "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)",
    "Mozilla/5.0 (Android 13; Mobile; rv:121.0) Gecko/121.0 Firefox/121.0",
    "",
    "curl/8.4.0",
    "Mozilla/5.0 (Linux; Android 12; Pixel 6) AppleWebKit/537.36 (KHTML, like Gecko) "
    "Chrome/119.0.0.0 Mobile Safari/537.36",
    "Mozilla/5.0 (Linux; Android 13; SM-X710) AppleWebKit/537.36 (KHTML, like Gecko) "
    "Chrome/119.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) "
    "Chrome/120.0.0.0 Safari/537.36 OPR/105.0.0.0",
]
# Expected families per agent above (browser, os, device class), hand-labelled: the oracle's
# independent answer for the rule set.
USER_AGENT_EXPECTED = [
    ("Chrome", "Windows", "desktop"),
    ("Safari", "Mac OS X", "desktop"),
    ("Mobile Safari", "iOS", "mobile"),
    ("Mobile Safari", "iOS", "tablet"),
    ("Chrome Mobile", "Android", "desktop"),
    ("Firefox", "Linux", "desktop"),
    ("Edge", "Windows", "desktop"),
    ("Googlebot", "Other", "desktop"),
    ("Firefox Mobile", "Android", "mobile"),
    ("Other", "Other", "desktop"),
    ("curl", "Other", "desktop"),
    ("Chrome Mobile", "Android", "desktop"),
    ("Chrome", "Android", "desktop"),
    ("Opera", "Windows", "desktop"),
]
LANGUAGES = ["en-US", "fr-FR", "", "de-DE", None]
WIDTHS = [1920, 412, 820, 0]
HEIGHTS = [1080, 915, 1180, 0, None]
GEO_SPAN = 3 * 65536  # each nation's range spans four /16 blocks, starting mid-block


def _pick(values, idx):
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (idx % len(values) + 1).cast("int"))


def fixture_raw_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_hits_from_events(read_table(spark, sf_dir, "events"))


def raw_hits_from_events(ev: DataFrame) -> DataFrame:
    """Stateless row mapping, so it applies to a streaming ``events`` read as well."""
    u, i, et = F.col("user_id"), F.col("event_id"), F.col("event_type")
    us = u.cast("string")
    is_err = et == "error"
    pub = F.concat_ws(".", (1 + u % 25).cast("string"), (u % 4).cast("string"),
                      ((u * 7) % 256).cast("string"), (u % 256).cast("string"))
    kind = u % 10
    ip = (F.when(kind == 0, F.lit("127.0.0.1"))
          .when(kind == 1, F.concat(F.lit("10.0."), (u % 256).cast("string"), F.lit(".1")))
          .when(kind == 2, F.concat(F.lit("192.168.1."), (u % 256).cast("string")))
          .when(kind == 3, F.concat(F.lit("172.16.0."), (u % 256).cast("string")))
          .when(kind == 4, F.concat(F.lit("::ffff:"), pub))
          .when(kind == 5, F.lit(""))
          .when(kind == 6, F.lit("999.1.2.3"))
          .otherwise(pub))
    return ev.select(
        F.when(is_err & (i % 97 == 0), F.lit(None))
         .when(is_err & (i % 97 == 1), F.lit(""))
         .otherwise(F.concat(F.lit("v"), us)).alias("visitorId"),
        F.when(is_err & (i % 89 == 2), F.lit(None))
         .when(is_err & (i % 89 == 3), F.lit(""))
         .otherwise(F.concat(F.lit("s"), us, F.lit("-"), F.to_date("ts").cast("string")))
         .alias("sessionId"),
        F.lit(None).cast("boolean").alias("isNewSession"),
        F.when(et == "view", F.lit("pageview")).otherwise(et).alias("type"),
        F.struct(
            F.when(i % 31 == 0, F.lit("")).otherwise(
                F.concat(F.lit("/p/"), (i % 23).cast("string"))).alias("path"),
            F.when(i % 29 == 0, F.lit(None)).otherwise(
                F.concat(F.lit("Page "), (i % 23).cast("string"))).alias("title"),
            _pick(REFERRERS, i).alias("referrer")).alias("page"),
        F.struct(_pick(USER_AGENTS, u).alias("userAgent"),
                 _pick(LANGUAGES, u).alias("language")).alias("browser"),
        F.struct(_pick(WIDTHS, u).cast("int").alias("width"),
                 _pick(HEIGHTS, u).cast("int").alias("height")).alias("screen"),
        ip.alias("ip"),
        F.when(kind == 5, pub).alias("forwarded_for"),
        F.lit(None).cast("string").alias("remote_addr"),
        F.col("ts").alias("received_at"),
        i.alias("hit_id"),
    )


def fixture_geo_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    start = (F.col("n_nationkey").cast("long") + 1) * 16777216 + 32768
    return (n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"), "left")
            .select(start.alias("ip_from"), (start + GEO_SPAN - 1).alias("ip_to"),
                    F.col("n_name").alias("country"), F.col("r_name").alias("region"),
                    F.concat(F.lit("city"), F.col("n_nationkey").cast("string")).alias("city")))


# Every second hit from an IPv6 address, written in three ways; the range of nation k lies in 2001:db8:k+1.
V6_LOW, V6_HIGH = 0x1234, 0xD00F


def with_ipv6(raw: DataFrame) -> DataFrame:
    i = F.col("hit_id")
    hexed = lambda c: F.lower(F.hex(c))
    third, fourth, last = 1 + i % 25, (i * 37) % 65536, i % 65536
    full = F.concat_ws(":", F.lit("2001:0DB8"), *[F.upper(F.lpad(hexed(x), 4, "0")) for x in (third, fourth)],
                       F.lit("0000:0000:0000"), F.upper(F.lpad(hexed(last), 4, "0")))
    head = F.concat_ws(":", F.lit("2001:db8"), hexed(third), hexed(fourth))
    dotted = F.concat_ws(".", F.lit("0.0"), F.floor(last / 256).cast("string"), (last % 256).cast("string"))
    text = (F.when(i % 50 == 0, F.lit("::1")).when(i % 3 == 0, F.concat(head, F.lit("::"), hexed(last)))
            .when(i % 3 == 1, full).otherwise(F.concat(head, F.lit(":0:0:"), dotted)))
    return raw.withColumn("ip", F.when(i % 2 == 0, text).otherwise(F.col("ip")))


def fixture_geo_ranges6(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    net = F.concat(F.lit("2001:db8:"), F.lower(F.hex(F.col("n_nationkey").cast("long") + 1)))
    return (n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"), "left")
            .select(F.concat(net, F.lit(f":{V6_LOW:x}::")).alias("ip_from"),
                    F.concat(net, F.lit(f":{V6_HIGH:x}:ffff:FFFF:ffff:8001")).alias("ip_to"),
                    F.col("n_name").alias("country"), F.col("r_name").alias("region"),
                    F.concat(F.lit("town"), F.col("n_nationkey").cast("string")).alias("city")))


# --- SQL twins for the oracle ----------------------------------------------------------------
def _sql_str(v):
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def _sql_list(values):
    return "[" + ", ".join(_sql_str(v) if not isinstance(v, int) else str(v) for v in values) + "]"


def _sql_pick(values, idx_sql):
    return f"({_sql_list(values)})[({idx_sql}) % {len(values)} + 1]"


_PUB = ("concat_ws('.', CAST(1 + user_id % 25 AS VARCHAR), CAST(user_id % 4 AS VARCHAR), "
        "CAST((user_id * 7) % 256 AS VARCHAR), CAST(user_id % 256 AS VARCHAR))")

RAW_HITS_SQL = f"""SELECT event_id AS hit_id, ts AS received_at, user_id,
 CASE WHEN event_type = 'error' AND event_id % 97 = 0 THEN NULL
      WHEN event_type = 'error' AND event_id % 97 = 1 THEN ''
      ELSE 'v' || CAST(user_id AS VARCHAR) END AS visitorId,
 CASE WHEN event_type = 'error' AND event_id % 89 = 2 THEN NULL
      WHEN event_type = 'error' AND event_id % 89 = 3 THEN ''
      ELSE 's' || CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) END AS sessionId,
 CASE WHEN event_type = 'view' THEN 'pageview' ELSE event_type END AS type,
 CASE WHEN event_id % 31 = 0 THEN '' ELSE '/p/' || CAST(event_id % 23 AS VARCHAR) END AS path,
 CASE WHEN event_id % 29 = 0 THEN NULL ELSE 'Page ' || CAST(event_id % 23 AS VARCHAR) END AS title,
 {_sql_pick(REFERRERS, 'event_id')} AS referrer,
 {_sql_pick(USER_AGENTS, 'user_id')} AS user_agent,
 {_sql_pick(LANGUAGES, 'user_id')} AS language,
 {_sql_pick(WIDTHS, 'user_id')} AS width,
 {_sql_pick(HEIGHTS, 'user_id')} AS height,
 CASE user_id % 10 WHEN 0 THEN '127.0.0.1'
   WHEN 1 THEN '10.0.' || CAST(user_id % 256 AS VARCHAR) || '.1'
   WHEN 2 THEN '192.168.1.' || CAST(user_id % 256 AS VARCHAR)
   WHEN 3 THEN '172.16.0.' || CAST(user_id % 256 AS VARCHAR)
   WHEN 4 THEN '::ffff:' || {_PUB}
   WHEN 5 THEN ''
   WHEN 6 THEN '999.1.2.3'
   ELSE {_PUB} END AS ip,
 CASE WHEN user_id % 10 = 5 THEN {_PUB} END AS forwarded_for
FROM events"""

GEO_RANGES_SQL = f"""SELECT (CAST(n_nationkey AS BIGINT) + 1) * 16777216 + 32768 AS ip_from,
 (CAST(n_nationkey AS BIGINT) + 1) * 16777216 + 32768 + {GEO_SPAN - 1} AS ip_to,
 n_name AS country, r_name AS region, 'city' || CAST(n_nationkey AS VARCHAR) AS city
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey"""

UA_EXPECTED_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({k}, {_sql_str(b)}, {_sql_str(o)}, {_sql_str(d)})"
    for k, (b, o, d) in enumerate(USER_AGENT_EXPECTED)) + ") AS t(idx, browser, os, device_type)"
